"""Operators 11 to 13: the tagger and rules, clusters, and the audit of sources, each against brute force."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ontoflow.llm import clustering, divergence, pii
from ontoflow.llm._tagger import Tagger, symbols

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_rules(text):
    return [(k, *m.span()) for k, r in RULES.items() for m in re.finditer(r, text) if (all(int(x) <= 255 for x in m[0].split(".")) if k == "ip" else pii.valid(k, m[0]))]


def test_rules_are_the_plain_patterns():
    rng = np.random.default_rng(0)
    for _ in range(20000):
        text = "".join(rng.choice(list("a1 .@+-(_0259é"), int(rng.integers(1, 40))))
        assert pii.rule_spans(text) == plain_rules(text), text
    assert pii.rule_spans("card 4111 1111 1111 1111, ip 1.2.3.256 or 10.0.0.1") == [("ip", 42, 50), ("card", 5, 24)]


def test_rules_on_very_long_runs():
    for text in ("a" * 300_000, "1" * 300_000, "+1" * 100_000, "1." * 100_000 + "x", "a@" * 100_000, "+1" + "(" * 300_000):
        pii.rule_spans(text)


def test_gradient_and_decoding():
    rng, model = np.random.default_rng(0), Tagger(2, hidden=4)
    sym, gold = rng.integers(0, 130, (3, 7)).astype(np.uint8), np.array([[0, 1, 2, 0, 3, 4, 4], [0, 0, 0, 1, 2, 2, 0], [3, 4, 0, 0, 1, 1, 2]])
    model.p = {k: x.astype(np.float64) for k, x in model.p.items()}
    _, gradient = model.loss(sym, gold)
    for name, x in model.p.items():
        for _ in range(20):
            at = tuple(int(rng.integers(n)) for n in x.shape)
            old, both = x[at], []
            for d in (1e-4, -1e-4):
                x[at] = old + d
                both.append(model.loss(sym, gold)[0])
            x[at] = old
            assert abs((both[0] - both[1]) / 2e-4 - gradient[name][at]) < 2e-3, name
    scores, step = model.scores(sym), model.p["step"] + model.never
    for b, found in enumerate(model.decode(scores)):
        best = max(itertools.product(range(5), repeat=7), key=lambda t: scores[b, 0, t[0]] + model.p["start"][t[0]] + sum(step[t[k - 1], t[k]] + scores[b, k, t[k]] for k in range(1, 7)))
        assert tuple(found) == best
    assert np.allclose(model.marginals(scores).sum(axis=2), 1, atol=1e-3)


def _people(n, seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abdeilmnorstu"), int(rng.integers(2, 8))))
    out = []
    for k in range(n):
        digits = [int(x) for x in rng.integers(0, 10, 15)]
        card = next(c for c in ("".join(map(str, [4, *digits[:14], last])) for last in range(10)) if pii.luhn(c))
        spans = [f"{word()}.{k}@{word()}.example.com", ".".join(map(str, rng.integers(0, 256, 4))), card, f"+1 ({rng.integers(100, 999)}) 555-{rng.integers(1000, 9999)}"]
        rng.shuffle(spans)
        out.append(" ".join(x for s in spans for x in [*(word() for _ in range(int(rng.integers(15, 30)))), s]) + f" in {rng.integers(1900, 2030)} {word()}.")
    return out


def test_tagger_finds_what_rules_miss(spark):
    learned = spark.createDataFrame([(t,) for t in _people(150, 1)], "text string")
    model, rng = pii.train(learned, sample=150, steps=200), np.random.default_rng(5)
    hit = total = false = 0
    for text in _people(40, 2):
        spans = sorted(pii.rule_spans(text), key=lambda x: x[1])
        new, gold, at = "", [], 0
        for kind, s, e in spans:
            new += text[at:s]
            other = pii.rewritten(kind, text[s:e], rng)
            gold.append((kind, len(new), len(new) + len(other)))
            new, at = new + other, e
        new += text[at:]
        base = pii.rule_spans(new)
        found = [x[:3] for x in pii.tag_texts(model, [new], [base], 0.5)[0]]
        gold = [g for g in gold if not any(g[1] < e and s < g[2] for _, s, e in base)]
        hit, total, false = hit + sum(g in found for g in gold), total + len(gold), false + sum(f not in gold for f in found)
    assert total > 60 and hit / total > 0.7 and false <= 0.1 * total, (hit, total, false)
    # Clean texts stay clean, and what windows cut is found whole.
    assert pii.tag_texts(model, ["plain words in 1987 and 12 more, room 4"], [[]], 0.5) == [[]]


def test_pii_rows(spark):
    texts = [*_people(30, 3), None, "", "no data", "x" * 200_000 + " me@host.example.com", "é me@a.b"]
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(None, "1.2.3.4", "clash"), (0, texts[0], "clash")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    found = pii.find(docs, sample=40, steps=30)
    got = pii.digest(found).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            base = plain_rules(texts[r.doc_id] or "")
            listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
            assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(Counter(k for k, _, _ in base)[k] for k in pii.KINDS)
            assert set(listed.split(",")) <= set(r.spans.split(",")) if listed else r.n_added == (len(r.spans.split(",")) if r.spans else 0)
    red = found.join(docs.select("doc_id", "text"), "doc_id").filter("doc_id = 34").select(pii.redact(F.col("text"), F.col("spans")).alias("t")).first()
    assert red.t == "é <email>"
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert pii.find(empty).count() == 0
    assert pii.digest(pii.find(spark.createDataFrame([(1, "no data")], "doc_id bigint, text string"))).first().spans == ""


def _lloyd(x, ids, k=8, rounds=10):
    order = sorted(range(len(ids)), key=lambda j: hashlib.sha256(f"3:{ids[j]}".encode()).hexdigest())[:k]
    c = x[order].copy()
    for r in range(rounds + 1):
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        near = d.argmin(1)
        if r < rounds:
            for j in range(len(c)):
                if (near == j).any():
                    c[j] = [sum(col) // int((near == j).sum()) for col in x[near == j].T.tolist()]
    return near, d[np.arange(len(x)), near], c


@pytest.mark.parametrize("scale, big", [(1.0, False), (60.0, False), (9000.0, True)])
def test_clusters_against_lloyd(spark, scale, big):
    rng = np.random.default_rng(int(scale))
    centres = rng.standard_normal((12, 64)) * scale
    v = centres[rng.integers(0, 12, 300)] + rng.standard_normal((300, 64)) * scale * 0.4
    v[250:260] = v[0]  # ties
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    odd = [(900, None), (901, [0.5] * 63), (902, [0.1] * 63 + [None]), (903, [0.1] * 63 + [float("nan")]), (904, [0.1] * 63 + [float("inf")]), (905, [])]
    df = spark.createDataFrame([(i, x, "z") for i, x in rows + odd], "vec_id bigint, embedding array<double>, cluster string")
    got = {r.vec_id: r for r in clustering.cluster(df).collect()}
    x = np.floor(v * 1024).astype(np.int64)
    assert (np.abs(x).max() > clustering._EXACT) == big
    near, d, c = _lloyd(x, list(range(300)))
    assert set(got) == set(range(300))
    for k, r in got.items():
        assert (r.cluster, r.distance, r.cluster_inertia, r.inertia) == (near[k], d[k], d[near == near[k]].sum(), d.sum())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[near[k]].tolist())).encode()).hexdigest()


def test_bounds_spare_scans():
    rng = np.random.default_rng(0)
    centres = rng.integers(-2000, 2000, (8, 64))
    x = centres[rng.integers(0, 8, 2000)] + rng.integers(-100, 100, (2000, 64))
    first = clustering.Round(centres + 3, None)
    near, upper, lower, _ = first.scan(x)
    after, _, _, _, scanned = clustering.Round(centres, centres + 3).assign(x, near, upper, lower, False)
    assert (after == ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)).all() and scanned.mean() < 0.01


def test_clusters_of_few_and_none(spark):
    assert clustering.cluster(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    few = spark.createDataFrame([(1, [0.5] * 64), (1, [0.5] * 64), (None, [0.25] * 64)], "vec_id bigint, embedding array<float>")
    assert sorted(r.distance for r in clustering.cluster(few).collect()) == [0, 0, 0]
    with pytest.raises(Exception, match="no squared distance"):
        clustering.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id bigint, embedding array<double>")).collect()


def _audit(rows, least, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        groups.add((lang, source))
        count[lang, source].update(words)
        count[lang].update(words)
        docs[lang].update(set(words))
    kept, out = {g[0]: [t for t, n in docs[g[0]].items() if n >= least] for g in groups}, set()

    def share(c, lang):
        total, v = sum(c[t] for t in kept[lang]), len(kept[lang])
        return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * v) for t in kept[lang]}

    p, q = {g: share(count[g], g[0]) for g in groups}, {lang: share(count[lang], lang) for lang in kept}
    for lang, source in groups:
        found = [(-sum(abs(p[lang, source][t] - p[lang, b][t]) for t in kept[lang]), b.encode()) for a, b in groups if a == lang and b != source]
        out |= {(lang, source, "pair", b.decode(), -v, k) for k, (v, b) in enumerate(sorted(found), 1)}
        found = [(q[lang][t] - p[lang, source][t], t.encode()) for t in kept[lang] if count[lang, source][t] and p[lang, source][t] > q[lang][t]]
        out |= {(lang, source, "term", b.decode(), -v, k) for k, (v, b) in enumerate(sorted(found)[:top], 1)}
    return out


@pytest.mark.parametrize("bits", [21, 6])  # a sketch that tells, and one that lets all pass
def test_audit_against_brute_force(spark, bits):
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)] + ["Été", "ÉTÉ", "a", "日本"]
    rows = []
    for k in range(400):
        lang = ["en", "en", "fr", None][k % 4]
        text = " ".join(rng.choice(words, int(rng.integers(0, 30)), p=None)) + [".", " X-y_Z9z", "\x00\n", ""][k % 4 - 1]
        rows.append((lang, [f"s{int(rng.integers(4))}", "s0", None][int(rng.integers(3))], text))
    rows += [("xx", "only", "rare words"), ("xx", "other", None), ("en", "silent", "123"), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "lang string, source string, text string, value int, term string").repartition(5)
    got = {tuple(r) for r in divergence.audit(docs, least=10, top=7, bits=bits).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == _audit(rows, 10, 7)


def test_audit_of_very_long_text_and_none(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string"), bits=8).count() == 0
    long = "word " * 300_000 + "Tail" * 200_000
    assert sum(len(t) for t in divergence._terms(long.encode())) == 300_001
    rows = [("en", "a", long), ("en", "b", "word")]
    assert {(r.source, r.item) for r in divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string"), least=2, bits=8).collect()} == {("a", "b"), ("b", "a")}
