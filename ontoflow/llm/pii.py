"""Operator 11: personal data by rules, and by a bidirectional LSTM with CRF transitions for what rules miss.

The rules' matches are the labelled spans that the tagger learns from: windows around a bounded sample of them, and the same spans written another way (``at`` for @, blanks
around dots, no plus), which rules don't match. Overlapping windows of whole texts are decoded; each character's tag comes from the window that it is most central
in, and what the joined tags give is held against the rules' spans, which always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import map_batches
from ._tagger import Tagger, symbols

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match starts inside a run of digits, so trying its first digit is enough.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What a span holds at least one of; windows without any, and not beside one, are not decoded.
_SEED = re.compile(r"[0-9@]|[(\[]\x20?at\x20?[)\]]")
WIDTH, STRIDE = 96, 48
SPAN = "struct<kind:string,start:bigint,end:bigint,base:boolean,confidence:double>"


# --- rules ----------------------------------------------------------------------------------------------------


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From the earliest character of the run before each @ that no match has taken."""
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield begin, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(x != "" and int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in found.split("."))
    n = _digits(found)
    return {"card": 13 <= len(n) <= 19 and luhn(n), "phone": 9 <= len(n) <= 15}.get(kind, True)


def rule_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end (code points) of all that the rules match, by kind, then start."""
    out = [("email", s, e) for s, e in _emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        out += [(kind, *m.span()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return out


# --- examples -------------------------------------------------------------------------------------------------


def tags_of(spans: list[tuple[str, int, int]], begin: int, width: int) -> np.ndarray:
    """Tags of the window; where spans overlap, the kind listed first has the characters."""
    out = np.zeros(width, np.uint8)
    for kind, s, e in reversed(spans):
        k = KINDS.index(kind)
        lo, hi = max(s - begin, 0), min(e - begin, width)
        if lo < hi:
            out[lo:hi] = 2 + 2 * k
            if s >= begin:
                out[lo] = 1 + 2 * k
    return out


def _windows(text: str) -> Iterator[tuple[str, int]]:
    """Kind and begin of the windows of a text that are worth learning: around each span, and around numbers that are none."""
    spans, taken = rule_spans(text), set()
    for kind, s, e in spans:
        taken.update((s // STRIDE, e // STRIDE))
        room = max(WIDTH - (e - s), 1)
        yield kind, max(0, s - xxhash.xxh64_intdigest(f"{s}|{text[s:e]}") % room)
    # Numbers of a rule's shape that fail its check teach nothing: their shape doesn't tell.
    unsure = [m.span() for p in (_IP, _CARD, _PHONE) for m in p.finditer(text) if len(m[0]) > 6]
    for m in _SEED.finditer(text):
        begin = m.start() - m.start() % STRIDE
        if m.start() // STRIDE not in taken and not any(s < begin + WIDTH and begin < e for s, e in unsure):
            taken.add(m.start() // STRIDE)
            yield "none", begin
    if text:
        yield "plain", xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) % len(text)


def examples(docs: DataFrame, sample: int) -> DataFrame:
    """kind, text, tags: windows by the least hash of their text, at most ``sample`` of each kind, equal ones once.

    Each task sends the ``sample`` least of each kind; they meet by groups of tasks first.
    """

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        best: dict[str, dict[int, tuple[str, bytes]]] = {}
        for b in batches:
            for text in b.column(0).to_pylist():
                spans = None
                for kind, begin in _windows(text or ""):
                    spans = rule_spans(text) if spans is None else spans
                    window = text[begin : begin + WIDTH]
                    mine = best.setdefault(kind, {})
                    mine[xxhash.xxh64_intdigest(window.encode("utf-8", "surrogatepass")) >> 1] = window, tags_of(spans, begin, WIDTH).tobytes()
                    if len(mine) >= 4 * sample:
                        best[kind] = {h: mine[h] for h in sorted(mine)[:sample]}
        part = TaskContext.get().partitionId() // 64
        for kind, mine in best.items():
            at = sorted(mine)[:sample]
            columns = [pa.array([kind] * len(at)), pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array([mine[h][0] for h in at]), pa.array([mine[h][1] for h in at], pa.binary())]
            yield pa.record_batch(columns, ["kind", "part", "h", "text", "tags"])

    found = docs.transform(map_batches, pick, "kind string, part int, h bigint, text string, tags binary")
    for keys in (["kind", "part"], ["kind"]):
        order = Window.partitionBy(*keys).orderBy("h", "text", "tags")
        first = found.withColumn("copy", F.row_number().over(Window.partitionBy(*keys, "h").orderBy("text", "tags"))).filter("copy = 1")
        found = first.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= sample).drop("r", "copy")
    return found.select("kind", "h", "text", "tags")


#: Ways of writing that rules don't match: what stands for @, for the dots of a domain, and for the dots of an address.
_AT = (" @ ", " (at) ", "(at)", " [at] ", "[at]", " @")
_DOT = (".", " . ", " dot ", " (dot) ", "[dot]", ".")
_IP_DOT = ("[.]", " . ", "(.)", "[dot]", ". ")


def rewritten(kind: str, span: str, rng: np.random.Generator) -> str:
    """The span, written another way."""
    pick = lambda ways: ways[int(rng.integers(len(ways)))]
    if kind == "email":
        local, _, domain = span.rpartition("@")
        return local + pick(_AT) + domain.replace(".", pick(_DOT))
    if kind == "ip":
        return span.replace(".", pick(_IP_DOT))
    if kind == "card":
        n, gap = _digits(span), pick((".", "/", "_", "  ", " - "))
        return gap.join(n[k : k + 4] for k in range(0, len(n), 4))
    head = pick(("00", "tel ", "(+", "+ "))
    return (head + span[1:].replace(" ", ") ", 1) if head == "(+" else head + span[1:]).replace("-", pick(("-", "/", " ", ".")))


def vary(text: str, tags: np.ndarray, rng: np.random.Generator) -> tuple[str, np.ndarray]:
    """A window with its whole spans written another way, and its tags."""
    out, marks, k = "", [], 0
    while k < len(text):
        tag = int(tags[k])
        if tag % 2 == 1:
            end = k + 1
            while end < len(text) and tags[end] == tag + 1:
                end += 1
            span = text[k:end]
            new = rewritten(KINDS[tag // 2], span, rng) if end < len(text) or valid(KINDS[tag // 2], span) else span
            out, marks, k = out + new, [*marks, tag, *[tag + 1] * (len(new) - 1)], end
        else:
            out, marks, k = out + text[k], [*marks, tag], k + 1
    whole = np.zeros(WIDTH, np.uint8)
    whole[: min(len(marks), WIDTH)] = marks[:WIDTH]
    return out[:WIDTH], whole


def train(docs: DataFrame, sample: int = 200, steps: int = 240, hidden: int = 16, seed: int = 42) -> Tagger | None:
    """A tagger from at most 6 x ``sample`` windows of docs (text); None where rules find nothing."""
    rows = sorted(examples(docs, sample).collect(), key=lambda r: (r["kind"], r["h"], r["text"]))  # bounded by sample
    if not any(r["kind"] in KINDS for r in rows):
        return None
    rng, texts, gold = np.random.default_rng(seed), [], []
    for r in rows:
        tags = np.frombuffer(r["tags"], np.uint8)
        texts.append(r["text"])
        gold.append(tags)
        for _ in range(4 if r["kind"] in KINDS else 0):
            text, mine = vary(r["text"], tags, rng)
            texts.append(text)
            gold.append(mine)
    sym = np.stack([symbols(t, 0, WIDTH) for t in texts])
    return Tagger(len(KINDS), hidden, seed).fit(sym, np.stack(gold).astype(np.int64), steps, seed=seed)


# --- finding --------------------------------------------------------------------------------------------------


def _begins(text: str) -> list[int]:
    """Windows with a seed, and those beside them."""
    last = max(0, -(-(len(text) - WIDTH) // STRIDE))
    near: set[int] = set()
    for m in _SEED.finditer(text):
        k = m.start() // STRIDE
        near.update(range(k - 2, k + 2))
    return [k * STRIDE for k in sorted(near) if 0 <= k <= last]


def plausible(kind: str, found: str) -> bool:
    """Whether a span of the tagger can be what it says: the digits or parts that the rule asks for."""
    if kind == "email":
        return bool(re.search(r"@|\bat\b", found) and re.search(r"\.|\bdot\b", found) and re.match(r"[A-Za-z0-9]", found) and re.search(r"[A-Za-z0-9]$", found))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", found)
        return len(parts) == 4 and all(len(x) < 4 and int(x) <= 255 for x in parts)
    return valid(kind, found) and not re.search(r"[A-Za-z]{4}", found)


def joined(text: str, begins: list[int], tags: np.ndarray, sure: np.ndarray, base: list[tuple[str, int, int]], least: float) -> list[tuple[str, int, int, float]]:
    """Spans from the tags (windows, width) of a text's windows: each character as in the window in which it is most central.

    A span is kept if its least probable character reaches ``least``, if it's plausible, and if it touches no rule's span.
    """
    quarter, out = (WIDTH - STRIDE) // 2, []
    chars: list[tuple[int, int, float]] = []
    for k, begin in enumerate(begins):
        lo = 0 if k == 0 or begins[k - 1] != begin - STRIDE else quarter
        hi = WIDTH if k + 1 == len(begins) or begins[k + 1] != begin + STRIDE else quarter + STRIDE
        at = np.flatnonzero(tags[k, lo:hi]) + lo
        chars += zip((at + begin).tolist(), tags[k, at].tolist(), sure[k, at].tolist())
    spans: list[list] = []
    for at, tag, p in chars:
        kind = (tag - 1) // 2
        if spans and spans[-1][2] == at and spans[-1][0] == kind and tag % 2 == 0:
            spans[-1][2], spans[-1][3] = at + 1, min(spans[-1][3], p)
        else:
            spans.append([kind, at, at + 1, p])
    for kind, s, e, p in spans:
        found = text[s:e]
        s, e = s + len(found) - len(found.lstrip()), s + len(found.rstrip())
        if p >= least and e > s and plausible(KINDS[kind], text[s:e]) and not any(s < be and bs < e for _, bs, be in base):
            out.append((KINDS[kind], s, e, p))
    return out


def tag_texts(model: Tagger, texts: list[str], base: list[list[tuple[str, int, int]]], least: float, chunk: int = 256) -> list[list[tuple[str, int, int, float]]]:
    """The tagger's spans of each text that touch none of its base spans."""
    begins = [_begins(t) for t in texts]
    where = [(i, b) for i, mine in enumerate(begins) for b in mine]
    tags: dict[int, list[np.ndarray]] = {}
    sure: dict[int, list[np.ndarray]] = {}
    out: list[list] = [[] for _ in texts]
    for k in range(0, len(where), chunk):
        part = where[k : k + chunk]
        scores = model.scores(np.stack([symbols(texts[i], b, WIDTH) for i, b in part]))
        best = model.decode(scores)
        some = best.any(axis=1)
        p = np.ones(best.shape)
        if some.any():
            p[some] = np.take_along_axis(model.marginals(scores[some]), best[some][:, :, None], 2)[:, :, 0]
        for j, (i, _) in enumerate(part):
            tags.setdefault(i, []).append(best[j].astype(np.uint8))
            sure.setdefault(i, []).append(p[j].astype(np.float32))
            if len(tags[i]) == len(begins[i]):
                out[i] = joined(texts[i], begins[i], np.stack(tags.pop(i)), np.stack(sure.pop(i)), base[i], least)
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 200, steps: int = 240, least: float = 0.5) -> DataFrame:
    """doc_id, spans: one row for each input row; spans are structs (kind, start, end, base, confidence) by kind, then start.

    Start and end count code points, end is exclusive. base tells the rules' spans, all of which are there (confidence 1); the tagger's spans touch none of them. The tagger learns from at most
    6 x ``sample`` windows of the texts themselves; where rules find nothing, there is none. A null text is empty and has no spans; null or repeated ids and repeated rows are judged each; an empty table gives
    an empty result; other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(docs.select("text"), sample, steps))  # some tens of kilobytes

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("confidence", pa.float64())]))
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            base = [rule_spans(t) for t in texts]
            more = tag_texts(model.value, texts, base, least) if model.value else [[] for _ in texts]
            spans = []
            for sure, extra in zip(base, more):
                every = [(k, s, e, True, 1.0) for k, s, e in sure] + [(k, s, e, False, float(p)) for k, s, e, p in extra]
                every.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
                spans.append([dict(zip(("kind", "start", "end", "base", "confidence"), x)) for x in every])
            yield pa.record_batch([b.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.transform(map_batches, judge, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<{SPAN}>")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (the rules' spans), base_sha256, spans (as text), n_added."""
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    added = F.size(F.filter("spans", lambda x: ~x["base"])).cast("bigint")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), added.alias("n_added"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span's characters replaced by its kind in angle brackets; of overlapping spans the first one stands."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["end"] > b["end"], -1).otherwise(1))
    zero = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))

    def step(state: Column, x: Column) -> Column:
        more = F.concat(state["done"], F.substring(text, state["at"] + 1, x["start"] - state["at"]), F.lit("<"), x["kind"], F.lit(">"))
        return F.when(x["start"] < state["at"], state).otherwise(F.struct(more.alias("done"), x["end"].alias("at")))

    return F.aggregate(ordered, zero, step, lambda s: F.concat(s["done"], F.substring(text, s["at"] + 1, F.length(text))))
