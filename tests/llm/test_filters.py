import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ontoflow.llm import decontaminate, language, sharding, urls, warc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_decontamination_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(12)] + ["Über", "naïve"]
    bench = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 12, 13, 14, 30]) if i < 9 else rng.randint(13, 30)))) for i in range(14)]
    bench[0] = (0, "rareword")
    bench[1] = (1, "rare2 rare3")
    bench += [(20, None), (21, "..."), (22, bench[9][1])]
    docs = []
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            w[10:10] = bench[rng.randrange(14)][1].split()
        docs.append((i, ", ".join(w)))
    docs += [(100, None), (101, ""), (102, "rareword"), (103, bench[10][1].upper()), (103, bench[10][1])]
    grams = {(i, tuple(w[k : k + n])) for i, w in ((i, words(t)) for i, t in bench) if w for n in [min(13, len(w))] for k in range(len(w) - n + 1)}

    def judge(text):
        w, hit, items = words(text), set(), set()
        for i, g in grams:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    items.add(str(i))
        return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)

    df, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string")
    found = sorted(tuple(r)[:6] for r in decontaminate.contamination(df, b).collect())
    assert found == sorted((i, *judge(t)) for i, t in docs)
    assert decontaminate.contamination(df, b.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination(df.limit(0), b).count() == 0


def test_warc_round_trip(spark):
    nasty = "a\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nüñ"
    pages = [(1, "http://a.com/x", nasty), (2, "http://a.com/y", nasty), (3, None, None), (4, "u\r\nv", ""), (5, "http://b/", "only"), (9, "http://b/", nasty), (None, "http://c/", "null id")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id bigint, url string, html string, digest string")
    captures = warc.round_trip(df, with_payload=True)
    found = {r.page_id: r for r in warc.digests(captures).collect()}
    for i, _, html in pages:
        raw = (html or "").encode()
        assert found[i].payload_bytes == len(raw)
        assert found[i].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        last = max((p for p, _, h in pages if (h or "") == (html or "") and p), default=None)
        assert (found[i].record_type, found[i].refers_to) == (("response", None) if last in (i, None) else ("revisit", last))
    whole = {r.page_id: r for r in captures.collect()}
    assert bytes(whole[9].response.payload).decode() == nasty and whole[1].response.payload is None
    assert whole[5].target_uri == "http://b/" and whole[3].target_uri is None and all(r.request and r.metadata for r in whole.values())
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_of_long_and_shuffled_pages(spark, tmp_path):
    html = {i: f"<p>{i % 5}</p>" if i % 3 else "x" * (40_000 * (i % 7) + i % 2) for i in range(60)} | {99: "long " * 2_000_000}
    pages = spark.createDataFrame([(i, f"http://h/{i}", t) for i, t in html.items()], "page_id bigint, url string, html string")
    found = {r.page_id: r for r in warc.digests(warc.round_trip(pages.orderBy("html").repartition(5))).collect()}
    last = {t: max(i for i, u in html.items() if u == t) for t in html.values()}
    assert {i: (r.payload_bytes, r.refers_to) for i, r in found.items()} == {i: (len(t), last[t] if last[t] != i else None) for i, t in html.items()}
    warc.write_warc(pages, str(tmp_path / "w"))
    assert max(len(warc._inflate(f.read_bytes())) for f in (tmp_path / "w").glob("*.gz")) < 11 << 20
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_url_rules(spark):
    rows = [(1, "https://WWW.Example.COM/en/1?q"), (2, "http://m.example.com/en/"), (3, "http://x.net/es/a#b"), (4, "http://shop.com"), (5, "http://shop.com/"), (6, None), (7, "no scheme"), (8, "a://b?x://y/"), (9, "http://notexample.com/en/")]
    found = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert (found[1].host, found[1].path, found[1].rule, found[1].verdict) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert (found[2].rule, found[2].verdict) == ("example.com/en/", "block") and found[3].rule == "net/es/" and found[4].rule is None and found[5].rule == found[9].rule == "com/"
    assert found[6].host == found[6].path == found[7].host == "" and found[8].host == "b" and all(r.verdict in ("allow", "block") for r in found.values())
    assert urls.judge(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_markov_is_a_distribution():
    m = urls.Markov(3, alphabet=8).fit(["abcab", "abd", ""])
    chars = ["a", "b", "c", "d", "\x03"]
    for context in ("\x02\x02\x02", "cab", "zzz", "ab"):
        seen = sum(np.exp(m.log_p(context, c)) for c in chars)
        assert seen < 1 + 1e-9 and abs(seen + (8 - len(chars)) * np.exp(m.log_p(context, "q")) - 1) < 1e-9


def test_urls_against_brute_force(spark):
    rng = random.Random(9)
    good, bad = ["docs", "wiki", "about", "news"], ["casino", "win", "xxx", "loan"]
    host = lambda words, end: ".".join(rng.choice(words) for _ in range(2)) + end
    rows = [(f"http://{host(good, '.com')}/{rng.choice(good)}{rng.randrange(9)}") for _ in range(60)] + [f"https://{host(bad, '.net')}/{rng.choice(['es', 'fr'])}/{rng.choice(bad)}" for _ in range(60)]
    rows += [f"http://{host(good + bad, '.org')}/{rng.choice(good + bad)}?q" for _ in range(60)] + [None, "", "no scheme", "http://é.org/ü"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id bigint, url string")
    found = {r.page_id: r for r in urls.judge(pages, order=2).collect()}
    ruled = sorted({(r.verdict, r.host + r.path) for r in found.values() if r.rule})
    held = {t for (t,) in spark.createDataFrame(ruled, "v string, t string").filter("pmod(xxhash64(43, t), 4) = 0").select("t").collect()}
    learn = {v: ["\x02\x02" + t + "\x03" for w, t in ruled if w == v and t not in held] for v in ("allow", "block")}

    def log_p(texts, context, char):
        p = 1 / 256
        for n in range(3):
            tail = context[2 - n :]
            after = Counter(t[k] for t in texts for k in range(2, len(t)) if t[k - n : k] == tail)
            if not after:
                break
            p = (after[char] + len(after) * p) / (after.total() + len(after))
        return np.log(p)

    def score(text):
        t = "\x02\x02" + text + "\x03"
        return np.mean([log_p(learn["allow"], t[k - 2 : k], t[k]) - log_p(learn["block"], t[k - 2 : k], t[k]) for k in range(2, len(t))])

    known = [(score(t), v == "allow") for v, t in ruled if t in held]
    balanced = lambda x: sum(s >= x for s, g in known if g) / sum(g for _, g in known) + sum(s < x for s, g in known if not g) / sum(not g for _, g in known)
    best, unruled = max(balanced(s) for s, _ in known), [r for r in found.values() if not r.rule]
    assert len(found) == len(rows) and len(unruled) == 64
    for r in unruled:
        assert abs(r.score - score(r.host + r.path)) < 1e-9
    # One threshold parts them, and it is one of the best.
    low, high = max([r.score for r in unruled if r.verdict == "block"], default=-9), min([r.score for r in unruled if r.verdict == "allow"], default=9)
    assert low < high and any(low < x <= high and balanced(x) == best for x in [s for s, _ in known] + [high])


def test_automaton_and_phrases_against_brute_force():
    rng = np.random.default_rng(0)
    reference = "".join(map(str, rng.integers(2, 5, 400)))

    def phrases(t):
        k = n = 0
        while k < len(t):
            e = k
            while e < len(t) and t[k : e + 1] in reference:
                e += 1
            k, n = max(e, k + 1), n + 1
        return n

    table = language.Table(language.suffix_automaton(np.array(list(map(int, reference)))), 7)
    # Short texts, texts of many blocks, and parts of the reference itself, whose phrases are longer than blocks.
    texts = ["".join(map(str, rng.integers(2, 7 if k % 3 else 5, n))) for k, n in enumerate(rng.integers(1, 60, 100))]
    texts += ["".join(map(str, rng.integers(2, 5, 3000))), reference * 5, reference[7:300] + reference[1:399], "2" * 2000]
    flat = np.array(list(map(int, "".join(texts))), np.uint16)
    size = np.array([len(t) for t in texts])
    pieces = -(-size // language.BLOCK)
    of = np.repeat(np.arange(len(texts)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    found = language.phrases(flat, (np.cumsum(size) - size)[of] + nth * language.BLOCK, np.minimum(size[of] - nth * language.BLOCK, language.BLOCK), nth == 0, table)
    assert np.bincount(of, found).astype(int).tolist() == [phrases(t) for t in texts]


def test_scripts_of_many_letters(spark):
    rng = random.Random(2)
    ranges = {"el": (0x3B1, 24), "ru": (0x430, 32), "ja": (0x3041, 80), "ko": (0xAC00, 900), "zh": (0x4E00, 2000), "hi": (0x905, 50), "ar": (0x628, 30)}
    words = {g: ["".join(chr(a + rng.randrange(n)) for _ in range(rng.randint(2, 7))) for _ in range(300)] for g, (a, n) in ranges.items()}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(rng.choice([8, 30, 400]))), g) for i in range(420) for g in [list(ranges)[i % 7]]]
    found = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert [found[i] for i, _, _ in rows] == [g for _, _, g in rows]


def test_too_many_labels_are_an_error(spark):
    rows = spark.range(30).selectExpr("'some text' as text", "cast(id as string) as lang")
    with pytest.raises(ValueError, match="over 20 languages"):
        language.samples(rows, 100, most_languages=20)


def test_language_identification(spark):
    rng = random.Random(1)
    kinds = {"xx": ["lorem", "ipsum", "dolor", "sit"], "yy": ["über", "straße", "während", "groß"]}
    rows = [(i, " ".join(rng.choice(kinds[g]) for _ in range(30)), g) for i in range(200) for g in ["xx" if i % 2 else "yy"]]
    rows += [(1000, None, "xx"), (1001, "123 %%", "yy"), (1002, "", None), (None, "lorem ipsum dolor", None), (1003, "日本語", None)]
    found = {r.doc_id: r for r in language.identify(spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, lang string, score double")).collect()}
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows if i is not None)
    assert all(found[i].lang_pred == g for i, _, g in rows[:200]) and found[None].lang_pred == "xx"
    assert [found[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and found[1003].lang_pred in kinds and all(0 <= r.score <= 1 for r in found.values())
    assert language.identify(spark.createDataFrame([], "doc_id bigint, text string, lang string")).count() == 0


def test_sharding(spark):
    rows = [(i, "x" * (i % 50)) for i in range(1000)] + [(5, "same"), (5, "same"), (None, None)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)).collect()
    count = Counter(r.shard for r in found)
    assert len(found) == len(rows) and sorted(count) == list(range(24)) and max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(count[s]))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sharding.shard(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_matrix_adds_up_and_is_unbiased():
    rows, shards = [50, 0, 120, 30], [67, 67, 66]
    total = np.zeros((4, 3))
    for seed in range(400):
        m = sharding.communication_matrix(rows, shards, seed)
        assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).tolist() == shards and (m >= 0).all()
        total += m
    assert np.abs(total / 400 - np.outer(rows, shards) / 200).max() < 1.0


def test_inversion_follows_the_law():
    from math import comb

    rng = np.random.default_rng(0)
    for good, bad, n in ((7, 5, 6), (3, 40, 20), (30, 2, 31), (5, 5, 10), (1, 1, 1)):
        seen = Counter(sharding.inversion(rng, good, bad, n) for _ in range(20_000))
        for k in range(max(0, n - bad), min(n, good) + 1):
            p = comb(good, k) * comb(bad, n - k) / comb(good + bad, n)
            assert abs(seen.pop(k, 0) / 20_000 - p) < 5 * (p * (1 - p) / 20_000) ** 0.5 + 1e-9
        assert not seen


def test_huge_matrices():
    rng = np.random.default_rng(1)
    good, bad, n = 10**10, 3 * 10**10, 10**9
    draws = np.array([sharding.inversion(rng, good, bad, n) for _ in range(300)], np.float64)
    deviation = (n * 0.25 * 0.75 * (good + bad - n) / (good + bad - 1)) ** 0.5
    assert abs(draws.mean() - n / 4) < 4 * deviation / 300**0.5 and 0.85 < draws.std() / deviation < 1.15
    rows, shards = [1_299_999_000, 2_700_000_000, 1000], [1_300_000_000, 1_350_000_000, 1_350_000_000]
    m = sharding.communication_matrix(rows, shards, 3)
    assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).tolist() == shards and (m >= 0).all()


def test_language_sample_counts_copies_once(spark):
    rows = [(f"text number {k} of the language", "aa") for k in range(70)] + [("one text that many rows repeat", "aa")] * 20_000 + [("autre chose", "bb")] * 3000
    out = language.samples(spark.createDataFrame(rows, "text string, lang string"), 24_000)
    assert len(out["aa"]) == 60 and out["bb"] == ["autre chose"]


def test_url_models_learn_from_all_ruled_urls(spark):
    """More ruled URLs than a sample would hold, a long one among them: scores are those of models of all of them, the threshold that of all held."""
    rng = np.random.default_rng(1)
    texts = {f"a{rng.integers(10**9)}.com/x{k}": "allow" for k in range(9000)} | {f"b.net/{('es', 'fr')[k % 2]}/{rng.integers(10**9)}": "block" for k in range(9000)} | {"long.com/" + "q" * 3000: "allow"}
    asked = ["q.org/qqqq", "c.org/es/12", "d.org/x7", ""]
    rows = [(k, f"http://{t}") for k, t in enumerate([*texts, *asked])]
    found = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string"), order=2).collect()}
    df = spark.createDataFrame(list(texts.items()), "text string, verdict string").selectExpr("text", "verdict", "pmod(xxhash64(43, text), 4) = 0 held")
    parts = [(r.text, r.verdict, r.held) for r in df.collect()]
    allowed, blocked = (urls.Markov(2).fit([t for t, v, held in parts if v == verdict and not held]) for verdict in ("allow", "block"))
    held = [(urls.ratio(allowed, blocked, t), v == "allow") for t, v, h in parts if h]
    least = urls.calibrate(np.array([s for s, _ in held]), np.array([g for _, g in held]))
    assert len(found) == len(rows)
    for k, text in enumerate(asked, len(texts)):
        score = urls.ratio(allowed, blocked, text)
        assert abs(found[k].score - score) < 1e-9 and found[k].verdict == ("allow" if score >= least else "block")
    spread = [(float(s), bool(g)) for s, g in zip(rng.normal(size=500).round(2), rng.random(500) < 0.4)]
    df = spark.createDataFrame([("allow" if g else "block", s) for s, g in spread], "verdict string, score double")
    assert abs(urls.threshold(df, 7) - urls.calibrate(np.array([s for s, _ in spread]), np.array([g for _, g in spread]))) < 1e-12
