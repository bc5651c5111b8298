import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from ontoflow.llm import _bpe, packing, token_counts
from ontoflow.llm._common import tokenizer_path

ALPHABET = ["a", "b", "Z", "é", "ß", "1", "²", " ", " ", "\n", "\t", "'", "'s", "'ll", "!", "\x85", "\xa0", "\x1c", "<|endoftext|>", "<|", "ɏ", "日", "\x00", "ª", "·", "İ", "\r", "the", " of", "  ", " \n", "\u3000", "\u2019", "\u200b", "\u2028", "中文字", "x" * 70]
DOCS = [(1, "the cat sat"), (2, None), (3, ""), (4, "x " * 3000), (5, "the cat sat"), (None, "a\n\nb  c <|endoftext|> d"), (7, "日本 ünder")]


def test_encoder_is_the_library():
    library, rng = _bpe.Library(tokenizer_path()), random.Random(5)
    encoder, table = _bpe.Encoder(library), _bpe.Lengths(["the", "of", "a", "日", "b\n"], library)
    encoder.MOST = 3000
    for _ in range(30):
        texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(200)]
        ids, n = encoder.encode(pa.array(texts))
        assert list(encoder.lengths(pa.array(texts))) == list(n) == list(encoder.lengths(pa.array(texts), table))
        at = np.cumsum(n) - n
        assert [list(ids[a : a + k]) for a, k in zip(at, n)] == [library.text(t) for t in texts]


def test_token_counts(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in DOCS], "doc_id bigint, text string, n_tokens string")
    library = _bpe.Library(tokenizer_path())
    found = sorted(map(tuple, token_counts.token_counts(docs).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), len(library.text(t or "")), len(library.text(t or "")) > 1024) for i, t in DOCS), key=str)
    assert found == want
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def best_fit(histogram, capacity):
    import bisect

    rooms: list[int] = []
    for s in sorted(histogram, reverse=True):
        for _ in range(histogram[s]):
            k = bisect.bisect_left(rooms, s)
            bisect.insort(rooms, (rooms.pop(k) if k < len(rooms) else capacity) - s)
    return len(rooms)


def test_plan_is_valid_and_tight():
    rng = random.Random(1)
    draws = [lambda: rng.randint(1, 1023), lambda: min(1023, int(rng.expovariate(1 / 150)) + 1), lambda: rng.choice([341, 342, 171, 700]), lambda: 5]
    for draw in draws:
        histogram = Counter(draw() for _ in range(3000))
        used, at = Counter(), defaultdict(list)
        for size, a, b, first, each, offset in packing.plan(histogram, 1024):
            used[size] += b - a
            for k in range((b - a) // each):
                at[first + k].append((offset, size * each))
        assert used == histogram
        for held in at.values():
            end = 0
            for offset, n in sorted(held):
                assert offset == end
                end += n
            assert end <= 1024
        assert len(at) <= best_fit(histogram, 1024) * 1.005 + 1
    assert packing.plan({}, 1024) == []


def test_pack_documents(spark):
    docs = spark.createDataFrame([(i, t, 9) for i, t in DOCS], "doc_id bigint, text string, piece int")
    rows = packing.pack_documents(docs, with_ids=True).collect()
    library, at, ids = _bpe.Library(tokenizer_path()), defaultdict(list), defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
        ids[r.doc_id].append((r.start, r.ids))
        assert r.length == len(r.ids) <= 1024
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for held in at.values():
        end = 0
        for offset, n in sorted(held):
            assert offset == end
            end += n
        assert end <= 1024
    for i, t in DOCS:
        assert [x for _, p in sorted(ids[i]) for x in p] == library.text(t or "") + [2]
    assert sorted(r.length for r in rows if r.doc_id == 4) == sorted([1024] * (len(library.text("x " * 3000)) // 1024) + [(len(library.text("x " * 3000)) + 1) % 1024])
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_most_large_pieces_are_placed_by_grouping(monkeypatch):
    """Of uniform, lognormal and exponential lengths; and few sequences more than the tokens need."""
    from collections import Counter

    import numpy as np

    from ontoflow.llm import packing

    rng, n, plain = np.random.default_rng(0), 20_000, packing._substituted
    placed = [0]

    def counted(large, *rest):
        before = sum(large.values())
        runs = plain(large, *rest)
        placed[0] += before - sum(large.values())
        return runs

    monkeypatch.setattr(packing, "_substituted", counted)
    for x in (rng.integers(1, 1024, n), rng.lognormal(5.5, 0.9, n), rng.exponential(300, n)):
        x, placed[0] = np.clip(x.astype(int), 1, 1023), 0
        histogram = {int(s): int(m) for s, m in Counter(x.tolist()).items()}
        rows = packing.plan(histogram, 1024)
        used, room = Counter(), Counter()
        for s, a, z, first, each, at in rows:
            used[s] += z - a
            for k in range(-(-(z - a) // each)):
                room[first + k] += s * min(each, z - a - k * each)
        assert used == histogram and max(room.values()) <= 1024
        assert placed[0] / (x >= 204).sum() > 0.5
        assert len(room) <= 1.005 * x.sum() / 1024
