import random

import numpy as np
import xxhash

from ontoflow.llm import embeddings, lines, simhash


def brute_fingerprint(text, n=3):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_masks_cover():
    rng = random.Random(0)
    for radius in (1, 2, 4):
        masks = simhash.covering(list(range(64)), radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(500):
            errors = sum(1 << p for p in rng.sample(range(64), radius))
            assert any(not m & errors for m in masks)


def test_simhash_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    docs = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        docs.append((4 * i, " ".join(base)))
        for c in range(3):
            copy = list(base)
            if c and copy:
                copy[rng.randrange(len(copy))] = "new"
            docs.append((4 * i + c + 1, " ".join(copy).upper() if c == 2 else "\t".join(copy)))
    docs += [(1000, None), (1001, "\n \x0b"), (1002, "\xa0a\u2003b")]
    found = {r.doc_id: r for r in simhash.simhash(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    prints = {i: brute_fingerprint(t) for i, t in docs}
    assert {i: int(r.fingerprint, 16) for i, r in found.items()} == prints
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {i: r.component_id for i, r in found.items()} == groups(list(prints), linked)
    assert simhash.simhash(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_hot_tables_split_without_loss(spark):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    prints = list({base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)})
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), 2, hot=5).collect()
    want = groups(signed, [(a, b) for k, a in enumerate(signed) for b in signed[:k] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2])
    assert groups(signed, [(r.a, r.b) for r in edges]) == want


def test_keep_one(spark):
    text = " ".join(f"w{k}" for k in range(200))
    rows = [(1, text, "a"), (2, text, "b"), (3, text.replace("w7 ", "x "), "c"), (4, "something else", "d"), (5, None, "e"), (6, "", "f"), (None, text, "g")]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert {1, 4, 5, None} <= kept and not kept & {2, 6}


def keep_brute(rows, n=5, similarity=0.8):
    """Ids that stay: the least of each group that links of all pairs of texts make."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    linked = [(a, b) for a, s in sets.items() for b, o in sets.items() if a < b and ((not s and not o) or len(s & o) >= similarity * len(s | o) > 0)]
    return {i for i, g in groups(list(sets), linked).items() if i == g}


def test_keep_one_takes_every_near_copy(spark):
    text = " ".join(f"w{k}" for k in range(200))
    rows = [(1, text), (2, text), (3, text.replace("w7 ", "x ")), (4, "something else")]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == {1, 4}


def test_keep_one_against_brute_force(spark):
    rng = random.Random(5)
    rows, common = [], "a line that many of the texts have in common with others".split()
    for i in range(40):
        base = [f"v{rng.randrange(300)}" for _ in range(rng.choice([1, 3, 5, 12, 60, 150]))] + common * (i % 2)
        for c in range(6):
            copy = list(base)
            for _ in range(c * len(copy) // 90):  # chains of copies of copies on either side of 0.8
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            rows.append((rng.randrange(10**9), " ".join(copy)))
            base = copy if i % 3 == 0 else base
    rows += [(k, " ".join(common)) for k in range(3)] + [(10, ""), (11, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for most, few, block in ((200_000, 16, 512), (0, 2, 4)):
        kept = {r.doc_id for r in simhash.keep_one(docs, most=most, few=few, block=block).collect()}
        assert kept == keep_brute(rows)


def test_keep_one_splits_a_hot_group_without_loss(spark):
    rng = random.Random(6)
    base, rows = [f"v{k}" for k in range(40)], []
    for i in range(120):  # copies of one text, most of them more than 0.8 apart from each other, some linked through others
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.choice([0, 13, 26, 39])] = rng.choice("xyz")
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for block in (5, 50):
        assert {r.doc_id for r in simhash.keep_one(docs, block=block).collect()} == keep_brute(rows)


def test_keep_one_with_odd_tables(spark):
    assert simhash.keep_one(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    rows = [(1, "a b c", 5, 6, 7), (2, "A b\tc", 8, 9, 10), (2, "A b c", 8, 9, 10), (None, "a b c", 1, 2, 3), (4, "long " * 200_000, 0, 0, 0)]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, id int, _id int, c int"))
    assert out.columns == ["doc_id", "text", "id", "_id", "c"] and sorted(r.id for r in out.collect()) == [0, 1, 5]


def test_histograms_bound_what_is_shared():
    rng = np.random.default_rng(7)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(0, 300))) for _ in range(2))
        assert simhash.most_shared(simhash.histogram(a), simhash.histogram(b)) >= len(np.intersect1d(a, b))


def test_patience():
    assert lines.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert lines.patience([1, 9, 2, 9, 3], [7, 2, 8, 3]) == [(2, 1), (4, 3)]
    assert list(lines.blocks([(0, 0), (1, 1), (3, 2)])) == [(0, 2), (2, 3)]
    assert lines.patience([], [1]) == []


def test_line_dedup(spark):
    passage = ["the quick brown fox jumps over the lazy dog every single morning", "and then it sleeps until the evening comes around once more in town"]
    first = "\n".join(["alpha one", *passage, "omega"])
    second = "\n".join(["other start of it", *passage, "beta end"])
    rows = [(1, first), (2, second), (3, first), (4, "tiny"), (5, "tiny"), (6, None), (7, ""), (None, second), (8, "a line\n" + passage[0] + "\nanother")]
    out = {r.doc_id: r for r in lines.line_dedup(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, n_cut int")).collect()}
    assert out[1].text == first and out[1].n_cut == 0
    assert out[2].text == "other start of it\nbeta end" and out[2].n_cut == 2
    assert out[3].text == "" and out[3].n_cut == out[3].n_lines == 4
    assert out[4].text == out[5].text == "tiny" and out[6].text is None and out[7].text == "" and out[None].text == second
    assert out[8].n_cut == 0  # twelve words are fewer than least_words
    assert lines.line_dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def lines_brute(rows, least=20):
    """id -> text: lines with words go that a common block of an earlier text holds, all pairs of texts compared line by line."""
    first = {}
    for i, t in sorted(rows):
        first.setdefault(t, i)
    out = {}
    for i, t in rows:
        every = t.split("\n")
        words = [len(x.split()) for x in every]
        if first[t] < i and sum(words) >= least:
            out[i] = ""
            continue
        at = [k for k, n in enumerate(words) if n]
        mine, gone = [every[k].rstrip(" ") for k in at], set()
        for o, j in first.items():
            other = [x.rstrip(" ") for x in o.split("\n") if x.split()] if j < first[t] else []
            for p in range(len(mine)):
                for q in range(len(other)):
                    if (p and q and mine[p - 1] == other[q - 1]) or mine[p] != other[q]:
                        continue
                    e = 0
                    while p + e < len(mine) and q + e < len(other) and mine[p + e] == other[q + e]:
                        e += 1
                    if sum(words[at[k]] for k in range(p, p + e)) >= least:
                        gone |= {at[k] for k in range(p, p + e)}
        before = lambda k: max((x for x in at if x <= k), default=at[0] if at else -1)
        out[i] = "\n".join(x for k, x in enumerate(every) if before(k) not in gone)
    return out


def deduped(spark, rows):
    return {r.doc_id: r.text for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}


def test_line_dedup_loses_no_passage(spark):
    a, b, c, d, p, q = (" ".join(f"{x}{k}" for k in range(n)) for x, n in zip("abcdpq", (8, 8, 8, 8, 60, 50)))
    short = [" ".join(f"s{x}w{k}" for k in range(6)) for x in range(12)]
    # Lines whose earliest holders are spread over other documents, in one block of two later ones.
    spread = [(k + 1, x) for k, x in enumerate((a, b, c, d))] + [(5, "\n".join((a, b, c, d))), (6, "\n".join(("start", a, b, c, d)))]
    # A passage twice in a document; two passages in another order; short lines against a long one.
    twice = [(11, "\n".join(("x", p, "y", p, "z"))), (12, "\n".join(("u", p, "v"))), (13, "\n".join(("k", p, "l", p, "m")))]
    moved = [(21, "\n".join([q, *short])), (22, "\n".join([*short, q])), (23, "\n".join([short[0], q, short[1]]))]
    rows = spread + twice + moved
    found = deduped(spark, rows)
    assert found == lines_brute(rows)
    assert found[6] == "start" and found[12] == "u\nv" and found[13] == "k\nl\nm" and found[22] == "" and found[23] == f"{short[0]}\n{short[1]}"


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(8)
    pool = [" ".join(f"l{i}w{k}" for k in range(rng.choice([3, 5, 9, 14, 25]))) for i in range(14)] + ["", "", "  "]
    rows = []
    for i in range(120):
        kept = [rng.choice(pool) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 12))]
        if rows and rng.random() < 0.6:
            old = rng.choice(rows)[1].split("\n")
            k = rng.randrange(len(old))
            kept[rng.randint(0, len(kept)) : 0] = old[k : k + rng.randint(1, 8)]
        rows.append((rng.randrange(10**6), "\n".join(kept)))
    rows = list(dict(rows).items())
    assert deduped(spark, rows) == lines_brute(rows)


def test_line_dedup_keeps_columns_of_any_name(spark):
    text = "\n".join(" ".join(f"w{j}x{k}" for k in range(30)) for j in range(3))
    docs = spark.createDataFrame([(1, text, 1, 2, 3, 4), (2, text, 5, 6, 7, 8)], "doc_id bigint, text string, c0 int, print int, _row int, `a.b` int")
    out = lines.line_dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_cut"]
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, text, 1, 2, 3, 4, 3, 0), (2, "", 5, 6, 7, 8, 3, 3)]


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(60):
        base = rng.normal(size=8)
        for c in range(3):
            rows.append((len(rows), [float(x) for x in base + rng.normal(size=8) * 0.12 * c], int(i % 3)))
    rows += [(500, rows[0][1], 0), (501, [2 * x for x in rows[0][1]], 0), (502, rows[0][1], None), (503, None, 0), (504, [0.0] * 8, 0), (505, [float("nan")] * 8, 0), (506, [None] * 8, 0), (507, [], 0), (508, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    for block in (1024, 16, 3):
        found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, block=block).collect()}
        good = [(i, np.array(v), g) for i, v, g in rows if i < 502]
        linked = [(a, b) for a, v, g in good for b, w, h in good if a != b and g == h and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98]
        component = groups([r[0] for r in rows], linked)
        n = {i: sum(a == i for a, _ in linked) for i in component}
        assert found == {i: (n[i], component[i], component[i] == i) for i in component}


def test_embeddings_of_equal_projections_and_sizes_of_all_kinds(spark):
    rng = np.random.default_rng(2)
    rows = [[float(x) for x in np.eye(16)[i % 16] * 10.0 ** (i % 7 * 60 - 150)] for i in range(64)]  # one-hot, very small and very large
    rows += [[float(x) for x in rng.choice([-1, 1], 16)] for _ in range(40)]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)] + [(200 + i, v[:15], 0) for i, v in enumerate(rows[:3])], "vec_id bigint, embedding array<double>, label int")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df, block=5).collect()}
    scaled = np.array([np.array(v) / np.abs(v).max() for v in rows])
    scaled /= np.linalg.norm(scaled, axis=1, keepdims=True)
    linked = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and scaled[i] @ scaled[j] >= 0.98]
    component = groups(range(len(rows)), linked)
    assert {i: x for i, x in found.items() if i < 200} == {i: (sum(a == i for a, _ in linked), component[i]) for i in range(len(rows))}
    # An id that several vectors share has the links of all of them.
    twice = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.01, 1.0], 0), (3, [1.0, 0.01], 0)], "vec_id bigint, embedding array<double>, label int")
    assert {r.component_id for r in embeddings.near_duplicates(twice).collect()} == {1}


def test_error_bound_holds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, scale, norm, error = embeddings.quantise(x)
    decoded = codes * scale[:, None]
    assert (np.abs(x @ x.T - decoded @ decoded.T) <= norm[:, None] * error + error[:, None] * norm + error[:, None] * error + 1e-12).all()


def test_only_aligned_lines_go(monkeypatch):
    """Blocks that moved, that repeat, and whose lines aren't unique; and nothing goes that patience diff doesn't align."""
    rng = np.random.default_rng(1)
    for round_ in range(300):
        kinds = int(rng.integers(3, 40))
        h, weight = rng.integers(-(2**62), 2**62, kinds), rng.integers(1, 9, kinds)
        earlier, later = rng.integers(0, kinds, int(rng.integers(1, 40))), rng.integers(0, kinds, int(rng.integers(1, 40)))
        for _ in range(int(rng.integers(0, 4))):
            k, n, at = int(rng.integers(0, len(earlier))), int(rng.integers(1, 12)), int(rng.integers(0, len(later)))
            later = np.concatenate([later[:at], earlier[k : k + n], later[at:]])
        cut = np.zeros(len(later), bool)
        for i in range(len(earlier)):
            for j in range(len(later)):
                n = 0
                while i + n < len(earlier) and j + n < len(later) and earlier[i + n] == later[j + n]:
                    n += 1
                if weight[later[j : j + n]].sum() >= 20:
                    cut[j : j + n] = True
        args = h[earlier], weight[earlier], h[later], weight[later], 20
        assert (lines.common_lines(*args) == cut).all()
        if cut.any():
            with monkeypatch.context() as m:
                m.setattr(lines, "patience", lambda a, b: [])
                assert not lines.common_lines(*args).any()
