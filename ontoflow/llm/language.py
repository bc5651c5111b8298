"""Operator 1: language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text tells where a longest match ends. A text is parsed from
left to right into the longest phrases that occur in that language's text; a phrase costs about the logarithm
of the reference's length, so phrases x log2(reference) / characters estimates the cross entropy. The language
that needs least wins. Each language has an alphabet of its own, of all letters of its labelled text. Blocks of long texts are parsed side by side and
then once more from the states in which their predecessors really end, so phrases cross blocks as in one pass.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ._bpe import slices
from ._common import map_batches

UNKNOWN = "und"
#: Symbols of a text after folding: 0 is a letter that the language's text doesn't have, 1 anything but a letter.
OTHER, BREAK = 0, 1
BLOCK, WARM = 256, 48
POINTS = 0x110000


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of each state (symbol -> state) of the automaton whose paths from state 0 spell the substrings of symbols."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return go


class Table:
    """Transitions in one array, whatever the alphabet's size: those of state s and symbol c are at place base[s] + c, if that place is s's."""

    def __init__(self, go: list[dict[int, int]], width: int):
        self.base = np.zeros(len(go), np.int64)
        places: dict[int, int] = {}  # place -> owner and next state in one number
        free = end = width
        # Wide states first, each at the first place that fits; states of one symbol fill the gaps.
        for s in sorted(range(len(go)), key=lambda s: -len(go[s])):
            if not go[s]:
                continue
            while free in places:
                free += 1
            least, at = min(go[s]), free
            if len(go[s]) > 1:
                offsets = [c - least for c in go[s]]
                # Beyond some tries a state goes to the end, so that packing takes linear time.
                for tries in range(50):
                    if not any(at + o in places for o in offsets):
                        break
                    at += 1
                else:
                    at = end
            self.base[s] = at - least
            for c, to in go[s].items():
                places[at - least + c] = s << 32 | to
            end = max(end, at - least + max(go[s]) + 1)
        self.place = np.full(end + width + 1, -1, np.int64)
        self.place[list(places)] = list(places.values())

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is none."""
        found = self.place[self.base[state] + c]
        return np.where(found >> 32 == state, found & 0xFFFFFFFF, -1)


@functools.cache
def _letters() -> np.ndarray:
    """For each code point the lower-case letter that it stands for (itself where that has several characters), 0 for anything but letters."""
    out = np.zeros(POINTS, np.uint32)
    for point in range(POINTS):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            out[point] = ord(low) if len(low) == 1 else point
    return out


def letters(text: str) -> np.ndarray:
    """The letters of a text in lower case; runs of anything else as one 0."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _letters()[points]
    keep = s != 0
    keep[1:] |= s[:-1] != 0
    return s[keep]


def parse(blocks: np.ndarray, sizes: np.ndarray, table: Table, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that end in each block (columns of symbols x blocks, longest block first) parsed from the given states, and the states at its end."""
    state, count = state.copy(), np.zeros(blocks.shape[1], np.int64)
    active = np.searchsorted(-sizes, -np.arange(len(blocks)), side="left")
    for k in range(len(blocks)):
        n = active[k]
        c = blocks[k, :n]
        to = table.step(state[:n], c)
        ended = to < 0
        if ended.any():
            # The phrase before this symbol ends; one of the symbol alone begins, or ends too where it is unknown.
            fresh = table.step(np.zeros(n, np.int64), c)
            count[:n] += ended & (state[:n] > 0)
            count[:n] += ended & (fresh < 0)
            to = np.where(ended, np.maximum(fresh, 0), to)
        state[:n] = to
    return count, state


def phrases(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray, first: np.ndarray, table: Table) -> np.ndarray:
    """Phrases that end in each block of flat (blocks of a text follow each other; first marks each text's first), the last one of a text with its end."""

    def run(begin: np.ndarray, sizes: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count, end = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        order = np.argsort(-sizes, kind="stable")
        for k in range(0, len(order), 16384):
            at = order[k : k + 16384]
            # Beyond a block's end anything may stand: it isn't read.
            blocks = flat[np.minimum(begin[at] + np.arange(sizes[at].max(initial=0))[:, None], len(flat) - 1)]
            count[at], end[at] = parse(blocks, sizes[at], table, state[at])
        return count, end

    # A block's start is guessed from the symbols before it, where phrases mostly fall into step.
    warm = np.where(first, 0, WARM)
    start = run(begin - warm, warm, np.zeros(len(begin), np.int64))[1]
    count, end = run(begin, sizes, start)
    while True:
        # Blocks whose predecessor ends in another state are parsed again, until all agree.
        real = np.where(first, 0, np.concatenate([[0], end[:-1]]))
        at = np.flatnonzero(real != start)
        if not len(at):
            last = np.concatenate([first[1:], [True]])
            return count + (last & (end > 0))
        start[at] = real[at]
        count[at], end[at] = run(begin[at], sizes[at], real[at])


class Model:
    """A language's automaton and alphabet each."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        self.symbols, self.tables, self.bits = [], [], []
        for language in self.languages:
            said = np.concatenate([np.append(letters(t), 0) for t in samples[language]]).astype(np.uint32)
            alphabet = np.unique(said[said > 0])
            symbol = np.zeros(POINTS, np.uint16 if len(alphabet) < 65_000 else np.int32)
            symbol[0] = BREAK
            symbol[alphabet] = np.arange(len(alphabet)) + 2
            self.symbols.append(symbol)
            self.tables.append(Table(suffix_automaton(symbol[said]), len(alphabet) + 2))
            self.bits.append(float(np.log2(len(said) + 1)))

    def costs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character (texts x languages), and whether a text has letters."""
        folded = [letters(t) if t else np.zeros(0, np.uint32) for t in texts]
        has = np.array([bool(x.any()) for x in folded], bool)
        size = np.array([len(x) for x in folded], np.int64)
        pieces = -(-size // BLOCK)
        of = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        sizes = np.minimum(size[of] - nth * BLOCK, BLOCK)
        begin = (np.cumsum(size) - size)[of] + nth * BLOCK
        out = np.zeros((len(texts), len(self.languages)))
        if len(of):
            flat = np.concatenate(folded)
            for k, (symbol, table) in enumerate(zip(self.symbols, self.tables)):
                out[:, k] = np.bincount(of, phrases(symbol[flat], begin, sizes, nth == 0, table), len(texts)) * self.bits[k]
        return out / np.maximum(size, 1)[:, None], has

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text, and its score: how far the next best one's cost is above the best, 0 to 1."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        cost, has = self.costs(texts)
        best = cost.argmin(axis=1)
        two = np.partition(cost, 1, axis=1)[:, :2] if cost.shape[1] > 1 else np.hstack([cost, cost * 2])
        score = np.where(has, 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9), 0.0)
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, has)], np.clip(score, 0.0, 1.0)


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def samples(labelled: DataFrame, characters: int, piece: int = 400, most_languages: int = 1000) -> dict[str, list[str]]:
    """About ``characters`` of text for each language, in pieces of whole texts chosen by a hash of the text.

    labelled has text and lang, neither null. The hash's range is set by each language's number of distinct texts, so the
    driver gets about twice characters / piece pieces for a language, however large the corpus; equal texts count once.
    Languages that still lack pieces are asked again with a wider range, up to all their texts. More than ``most_languages`` labels are an error.
    """
    spark, h = labelled.sparkSession, F.xxhash64("text")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct(h, 0.02).alias("n")).limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"over {most_languages} languages; clean the labels or raise most_languages")
    want = 2 * -(-characters // piece)
    shares = {language: min(1.0, want / max(n, 1)) for language, n in counts.items()}
    at = F.pmod(F.xxhash64(F.lit(1), "text"), F.greatest(F.length("text") - piece + 1, F.lit(1))).cast("int") + 1
    out: dict[str, list[str]] = {}
    while shares:
        asked = F.broadcast(spark.createDataFrame(list(shares.items()), "lang string, share double"))  # a row for each language
        picked = labelled.select("lang", "text", h.alias("h")).join(asked, "lang").filter(F.col("h") / 2.0**64 + 0.5 < F.col("share"))
        picked = picked.select("lang", "h", F.substr("text", at, F.lit(piece)).alias("t")).distinct().collect()
        out |= {language: [] for language in shares}
        for r in sorted(picked, key=lambda r: (r["lang"], r["h"], r["t"])):
            have = out[r["lang"]]
            if len(have) * piece < characters and any(c.isalpha() for c in r["t"]):
                have.append(r["t"])
        shares = {k: min(1.0, 4 * x) for k, x in shares.items() if x < 1 and len(out[k]) * piece < characters}
    return {k: v for k, v in out.items() if v}


_FITTED: dict[str, Model] = {}


def _fitted(key: str, texts: dict[str, list[str]]) -> Model:
    """The last model of this Python worker, which serves many tasks."""
    if key not in _FITTED:
        _FITTED.clear()
        _FITTED[key] = Model(texts)
    return _FITTED[key]


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", characters: int = 24_000) -> DataFrame:
    """All columns of docs, and held_out, lang_pred, score (columns of these names are replaced); cases as for identify."""
    docs = docs.drop("held_out", "lang_pred", "score").withColumn("held_out", held_out(F.col(id_col)))
    usable = F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) > 0)
    labelled = docs.filter(~F.col("held_out") & usable).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(samples(labelled, characters))  # texts; each worker builds its automata from them
    key, at = uuid.uuid4().hex, docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = _fitted(key, model.value)
        for b in batches:
            for part in slices(b, at, 1 << 20):
                language, score = fitted.predict(part.column(at).to_pylist())
                yield pa.record_batch([*part.columns, pa.array(language, pa.string()), pa.array(score)], [*part.schema.names, "lang_pred", "score"])

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.transform(map_batches, predict, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", characters: int = 24_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each input row.

    Automata are fitted on about ``characters`` of text for each language (documented bound) of rows that are not
    held out and have a label. A null text, or one without letters, is ``und`` with score 0; so is every text if no
    row is labelled. A null id hashes as an empty string; ids may repeat; an empty table gives an empty result; other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return annotate(docs, characters=characters).select("doc_id", "held_out", "lang_pred", "score")
