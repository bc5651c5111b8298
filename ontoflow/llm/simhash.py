"""Operator 2: SimHash near-duplicates by covering locality-sensitive hashing.

Each bit position gets a non-zero vector of r + 1 bits; mask v (a non-zero vector) selects the positions
whose vector has an odd product with v. For any r positions there is a v orthogonal to all their vectors,
so two fingerprints that differ in r bits or fewer agree on some mask: they collide in some table, always.

Equal fingerprints are one node from the start. Tables with more than ``hot`` fingerprints are split by a
second covering over the positions that their mask leaves out, which keeps the guarantee and bounds a
table by 2^(positions left out of both).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_batches, settle
from ._graph import components, forest

BITS = 64
#: Ids are broadcast up to so many (under 10 MB), and joined by shuffle beyond.
MOST_BROADCAST = 200_000


def covering(positions: list[int], radius: int) -> list[int]:
    """Masks over the positions: any ``radius`` of them are missed by one mask at least."""
    if len(positions) <= radius:
        return [0]
    vectors = [1 + k % (2 ** (radius + 1) - 1) for k in range(len(positions))]
    return sorted({sum(1 << p for p, a in zip(positions, vectors) if (a & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))})


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BLANK = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))


def shingles(text: str | None, n: int) -> list[str]:
    """The n-word shingles in order; of fewer words the whole sequence. Words are runs without white space of ASCII."""
    words = [w for w in (text or "").translate(_LOWER | _BLANK).split(" ") if w]
    return [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []


def fingerprint(text: str | None, n: int = 3, seed: int = 42) -> int:
    """A bit is set if it is set in over half the shingles' XXH64; zero for a text without words."""
    parts = shingles(text, n)
    if not parts:
        return 0
    digest, chunk = xxhash.xxh64_digest, 1 << 16
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(parts), chunk):
        raw = np.frombuffer(b"".join([digest(s, seed) for s in parts[k : k + chunk]]), np.uint8)
        ones += _column_sums(raw.reshape(-1, 8))
    return int.from_bytes(np.packbits(2 * ones > len(parts)).tobytes(), "big")


def _column_sums(rows: np.ndarray) -> np.ndarray:
    """Ones in each bit column of rows of 8 bytes, most significant first."""
    return np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, n: int, seed: int) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of docs (doc_id, text)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), n, seed) for x in b.column(1)], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.transform(map_batches, compute, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _pairs(values: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for k in range(0, len(values), 512):
        near = np.bitwise_count(values[k : k + 512, None] ^ values[None, k:]) <= radius
        i, j = np.nonzero(near)
        keep = j > i
        yield values[k + i[keep]], values[k + j[keep]]


def _masked(fp, masks: list[int]):
    """(table, bits under its mask) of every table, as one array."""
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    return F.array(*[F.struct(F.lit(k).alias("t"), fp.bitwiseAND(F.lit(m)).alias("b")) for k, m in enumerate(signed)])


def links(fps: DataFrame, radius: int, hot: int = 2048) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) at ``radius`` bits or fewer; in each table a spanning forest of them."""
    masks = covering(list(range(BITS)), radius)
    keyed = settle(fps.select("fp", F.explode(_masked(F.col("fp"), masks)).alias("k")).select("fp", "k.t", "k.b"))
    many = settle(keyed.groupBy("t", "b").agg(F.count("*").alias("n")).filter("n > 1"))
    calm = keyed.join(many.filter(F.col("n") <= hot), ["t", "b"], "left_semi").select("fp", "t", "b", F.lit(0).alias("t2"), F.lit(0).cast("long").alias("b2"))
    inner = [covering([p for p in range(BITS) if not m >> p & 1], radius) for m in masks]
    second = reduce(lambda out, k: out.when(F.col("t") == k, _masked(F.col("fp"), inner[k])), range(1, len(masks)), F.when(F.col("t") == 0, _masked(F.col("fp"), inner[0])))
    split = keyed.join(many.filter(F.col("n") > hot), ["t", "b"], "left_semi").select("fp", "t", "b", F.explode(second).alias("k")).select("fp", "t", "b", F.col("k.t").alias("t2"), F.col("k.b").alias("b2"))
    tables = calm.union(split).groupBy("t", "b", "t2", "b2").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x in batch.column(0):
                values = np.array(x.as_py(), np.int64).view(np.uint64)
                root: dict = {}
                for i, j in _pairs(values, radius):
                    root = forest(i.view(np.int64).tolist(), j.view(np.int64).tolist(), root)
                for v, r in root.items():
                    if v != r:
                        a.append(v)
                        b.append(r)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return tables.select("fps").transform(map_batches, link, "a bigint, b bigint")


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each input row.

    component_id is the smallest doc_id reachable over links of ``radius`` bits or fewer. A null or blank text
    has fingerprint zero and links like any other; rows with a null id get a fingerprint and their group's id, but
    never name a group; repeated rows stay; an empty table gives an empty result; other columns are not read.
    """
    docs = settle(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), words, seed))
    fps = settle(docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    nodes = components(links(fps, radius))
    linked = fps.join(nodes, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    group = settle(settle(linked).join(settle(least), "component").select(F.col("fp").alias("_fp"), "component_id"))
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return docs.join(group, F.col("fp") == F.col("_fp")).select("doc_id", text.alias("fingerprint"), "component_id")


def shingle_hashes(words: list[str], n: int) -> np.ndarray:
    """A hash of each n-word shingle (of fewer words the whole sequence): a sum of the words' XXH64, each times an odd number of its position."""
    if not words:
        return np.zeros(0, np.uint64)
    known = {w: xxhash.xxh64_intdigest(w, 42) for w in set(words)}
    h = np.array([known[w] for w in words], np.uint64)
    m = max(1, len(words) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(min(n, len(words))):
        out += h[k : k + m] * np.uint64(xxhash.xxh64_intdigest(str(k), 1) | 1)
    return out


def _words(text: str | None) -> list[str]:
    return [w for w in (text or "").translate(_LOWER | _BLANK).split(" ") if w]


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The sorted hashes of a text's distinct n-word shingles."""
    return np.unique(shingle_hashes(_words(text), n).view(np.int64))


def hashed_fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of shingle hashes: a bit is set if it is set in over half of them."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += _column_sums(hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8))
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def prefix(parts: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first len - ceil(similarity x len) + 1 of a set in the order of (count, hash), where only hashes in the sorted ``common`` have counts.

    Two sets of that Jaccard similarity share a member of their prefixes, whatever the order.
    """
    if not len(parts):
        return parts
    rank = np.zeros(len(parts), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, parts), len(common) - 1)
        rank = np.where(common[at] == parts, counts[at], 0)
    # The tolerance lets rounding lengthen a prefix, never shorten it.
    return parts[np.lexsort((parts, rank))[: len(parts) - int(np.ceil(similarity * len(parts) - 1e-6)) + 1]]


def _common(docs: DataFrame, words: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a sixteenth of the texts (id, text), at most ``most``, sorted, and their counts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                parts = [shingle_set(x.as_py(), words) for x in b.column(0).slice(k, 256)]
                yield pa.record_batch([pa.array(np.concatenate([np.zeros(0, np.int64), *parts]))], ["t"])

    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(16)) == 0).select("text").distinct()
    top = some.transform(map_batches, each, "t bigint").groupBy("t").agg(F.count("*").alias("n")).filter("n > 2").orderBy(F.desc("n"), "t").limit(most).toArrow()
    t, n = (top.column(k).to_numpy() for k in (0, 1))
    order = np.argsort(t)
    return t[order], n[order]


#: Classes of a set's histogram: the sum of two histograms' minima bounds how many members the sets share.
CLASSES = 64


def histogram(parts: np.ndarray) -> np.ndarray:
    """How many of a set's hashes fall into each class."""
    return np.bincount(parts & (CLASSES - 1), minlength=CLASSES).astype(np.uint32)


def most_shared(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many members sets of these histograms (last axis: classes) can share at most."""
    return np.minimum(one, two).sum(axis=-1, dtype=np.int64)


def may_reach(similarity: float, one: np.ndarray, na: np.ndarray, two: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether sets of na and nb members with these histograms can have that Jaccard similarity; rounding never loses a pair."""
    return most_shared(one, two) >= similarity / (1 + similarity) * (na + nb) - 1e-6


def _histograms(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, CLASSES)


class _Links:
    """Pairs of texts whose sets have a Jaccard similarity, and the components they make, found in steps.

    rows has id and text, sizes has id, n (members of the set), h (its histogram) and first (its prefix).
    """

    def __init__(self, rows: DataFrame, sizes: DataFrame, words: int, similarity: float):
        self.rows, self.sizes, self.words, self.similarity = rows, sizes, words, similarity
        self.kind = rows.schema["id"].dataType.simpleString()
        self.found = self.component = None

    def sets(self, ids: DataFrame) -> DataFrame:
        """id, s: the shingle sets of the texts of ids (settled: few, as only likely pairs need them)."""
        ids = F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids
        words = self.words

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(0, b.num_rows, 256):
                    part = b.slice(k, 256)
                    yield pa.record_batch([part.column(0), pa.array([shingle_set(x.as_py(), words) for x in part.column(1)], pa.list_(pa.int64()))], ["id", "s"])

        return settle(self.rows.join(ids, "id", "left_semi").transform(map_batches, whole, f"id {self.kind}, s array<bigint>"))

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those whose sizes, histograms and prefixes allow the similarity; settled."""
        side = lambda x: self.sizes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("h").alias(f"h{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("na", "nb") >= F.lit(self.similarity) * F.greatest("na", "nb") - 1e-6)
        similarity = self.similarity

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                able = may_reach(similarity, _histograms(x.column(3)), x.column(2).to_numpy(), _histograms(x.column(5)), x.column(4).to_numpy())
                yield pa.record_batch([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(able))

        able = settle(both.select("a", "b", "na", "ha", "nb", "hb").transform(map_batches, keep, f"a {self.kind}, b {self.kind}"))
        # What two prefixes share bounds what the sets share: the prefix that ends first misses only the rest of its set.
        side = lambda x: self.sizes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("first").alias(f"f{x}"))
        both = able.join(side("a"), "a").join(side("b"), "b")
        most = F.size(F.array_intersect("fa", "fb")) + F.greatest(F.col("na") - F.size("fa"), F.col("nb") - F.size("fb"))
        return settle(both.filter(most >= F.lit(similarity / (1 + similarity)) * (F.col("na") + F.col("nb")) - 1e-6).select("a", "b"))

    def add(self, pairs: DataFrame) -> None:
        """Compare the whole sets of pairs (a, b), and join those alike into components."""
        pairs = self.likely(pairs)
        sets = self.sets(settle(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()))
        side = lambda x: sets.select(F.col("id").alias(x), F.col("s").alias(f"s{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        meet = F.size(F.array_intersect("sa", "sb"))
        alike = both.filter(meet >= F.lit(self.similarity) * (F.size("sa") + F.size("sb") - meet)).select("a", "b")
        self.found = settle(alike if self.found is None else self.found.union(alike))
        self.component = settle(components(self.found))

    def mark(self, rows: DataFrame) -> DataFrame:
        """rows (with id) and c, the component that each is in so far."""
        known = self.component.select(F.col("node").alias("_node"), F.col("component").alias("_c"))
        return rows.join(known, F.col("id") == F.col("_node"), "left").withColumn("c", F.coalesce("_c", "id")).drop("_node", "_c")

    def apart(self, shared: DataFrame, few: int, block: int) -> DataFrame:
        """Pairs (a, b) with a common t in shared (t, id, n) that no component holds yet, as far as sizes allow the similarity.

        A t of ``few`` texts or less names their pairs. The texts of others are dealt into blocks of about ``block``, which are held against each
        other by twos. A component with more texts has blocks of its own, and these aren't held against each other: near copies of one text cost nothing here.
        """
        at = settle(self.mark(shared.select("t", "id", "n")))
        several = at.groupBy("t").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("m")).filter("low <> high")
        at = settle(at.join(several.select("t", "m"), "t"))
        one, two = (at.filter(F.col("m") <= few).select("t", F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("c").alias(f"c{x}")) for x in "ab")
        pairs = one.join(two, "t").filter("a < b and ca <> cb").filter(F.least("na", "nb") >= F.lit(self.similarity) * F.greatest("na", "nb") - 1e-6).select("a", "b").distinct()
        return pairs.union(self._blocks(at.filter(F.col("m") > few).select("t", "id", "c"), block)).distinct()

    def _blocks(self, at: DataFrame, block: int) -> DataFrame:
        sizes = settle(at.groupBy("t", "c").agg(F.count("*").alias("m")))
        rest = sizes.filter(F.col("m") <= block).groupBy("t").agg(F.sum("m").alias("rest"))
        sizes = sizes.join(rest, "t", "left").select("t", "c", "m", F.coalesce("rest", F.lit(0)).alias("rest"))
        own = F.col("m") > block
        among = lambda x, n: F.pmod(F.xxhash64(x), F.greatest(F.ceil(F.col(n) / block), F.lit(1))).cast("int")
        at = at.join(sizes, ["t", "c"]).select("t", "id", "c", F.when(own, F.col("c")).alias("g"), F.when(own, among("id", "m")).otherwise(among("c", "rest")).alias("k"))
        at = at.join(self.sizes.select("id", "n", "h"), "id")
        blocks = at.groupBy("t", "g", "k").agg(*[F.collect_list(x).alias(f"{x}s") for x in ("id", "c", "n", "h")])
        blocks = settle(blocks).withColumn("no", F.monotonically_increasing_id())
        one, two = blocks.select("t", "g", "no").alias("x"), blocks.select("t", "g", "no").alias("y")
        tiles = one.join(two, F.col("x.t") == F.col("y.t")).filter("x.no <= y.no and (x.g is null or y.g is null or x.g <> y.g)").select(F.col("x.no").alias("no"), F.col("y.no").alias("no2"))
        lists = ["ids", "cs", "ns", "hs"]
        tiles = tiles.join(blocks.select("no", *lists), "no").join(blocks.select(F.col("no").alias("no2"), *[F.col(x).alias(f"{x}2") for x in lists]), "no2")
        similarity = self.similarity

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    same = batch.column(0)[r] == batch.column(1)[r]
                    ids, cs, ns, ids2, cs2, ns2 = (np.array(batch.column(k)[r].as_py()) for k in (2, 3, 4, 6, 7, 8))
                    hs, hs2 = _histograms(batch.column(5)[r].values), _histograms(batch.column(9)[r].values)
                    a, b = [ids[:0]], [ids2[:0]]
                    for k in range(0, len(ids), 32):
                        z = slice(k, k + 32)
                        i, j = np.nonzero((cs[z, None] != cs2) & (np.minimum(ns[z, None], ns2) >= similarity * np.maximum(ns[z, None], ns2) - 1e-6))
                        i += k
                        if same:
                            i, j = i[i < j], j[i < j]
                        for c in range(0, len(i), 1 << 14):
                            p, q = i[c : c + (1 << 14)], j[c : c + (1 << 14)]
                            able = may_reach(similarity, hs[p], ns[p], hs2[q], ns2[q])
                            a.append(ids[p[able]])
                            b.append(ids2[q[able]])
                    a, b = np.concatenate(a), np.concatenate(b)
                    yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        return tiles.select("no", "no2", *lists, *[f"{x}2" for x in lists]).transform(map_batches, compare, f"a {self.kind}, b {self.kind}")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 3, most: int = 200_000, few: int = 16, block: int = 256) -> DataFrame:
    """The rows of docs, all their columns, with one row of each group of near-duplicates: that of the least id (an integer).

    Rows link if their sets of ``words``-word shingles have a Jaccard similarity of ``similarity`` or more, and a group is what links join.
    Candidates come first from the covering tables of the shingles' SimHash (``radius`` bits), then, for links that are further apart, from an
    exact prefix filter, so that no link is missed; each is verified on the whole sets. ``most`` bounds the list of frequent shingles that
    the prefixes avoid, ``few`` the texts of a shingle whose pairs are named, and ``block`` the texts that a task holds against others; none changes the result.

    Null and blank texts are alike. Rows with a null id stay; rows that share an id fare alike; an empty table stays empty; other columns, whatever their names, are kept.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    kind = rows.schema["id"].dataType.simpleString()
    known = docs.sparkSession.sparkContext.broadcast(_common(rows, words, most))

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                keys, fps, sizes, first, classes = [], [], [], [], []
                for x in part.column(1):
                    said = _words(x.as_py())
                    hashes = shingle_hashes(said, words)
                    parts = np.unique(hashes.view(np.int64))
                    keys.append(xxhash.xxh128_digest(" ".join(said).encode("utf-8", "surrogatepass")))
                    fps.append(hashed_fingerprint(hashes))
                    sizes.append(len(parts))
                    first.append(prefix(parts, similarity, *known.value))
                    classes.append(histogram(parts).tobytes())
                columns = [part.column(0), pa.array(keys, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(first, pa.list_(pa.int64())), pa.array(classes, pa.binary())]
                yield pa.record_batch(columns, ["id", "key", "fp", "n", "first", "h"])

    base = settle(rows.transform(map_batches, sketches, f"id {kind}, key binary, fp bigint, n int, first array<bigint>, h binary"))
    # Texts of equal words are one from the start.
    firsts = settle(base.groupBy("key").agg(F.min("id").alias("least")))
    copies = base.select("id", "key").join(firsts, "key").filter("id > least").select("id")
    kinds = settle(base.drop("key").join(firsts, F.col("id") == F.col("least"), "left_semi"))

    # Shingles that the prefixes of several texts hold.
    tokens = kinds.select("id", "n", F.size("first").alias("size"), F.explode("first").alias("t"))
    several = settle(tokens.groupBy("t").agg(F.count("*").alias("m")).filter("m > 1").select("t"))
    shared = settle(tokens.join(several, "t", "left_semi"))

    # The covering tables' links between fingerprints, each fingerprint by the first text that has it.
    fps = settle(kinds.groupBy("fp").agg(F.min("id").alias("a")))
    same = kinds.join(fps, "fp").filter("id <> a").select("a", F.col("id").alias("b"))
    near = links(fps, radius).withColumnsRenamed({"a": "fa", "b": "fb"}).distinct()
    near = near.join(fps.withColumnsRenamed({"fp": "fa"}), "fa").join(fps.select(F.col("fp").alias("fb"), F.col("a").alias("b")), "fb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    near = same.union(near)

    found = _Links(rows, kinds.select("id", "n", "h", "first"), words, similarity)
    # Each shared shingle's most typical text (the fewest shingles of its own), held against the others that have it.
    typical = F.struct((F.col("size") - F.col("k")).alias("u"), "id")
    counts = shared.groupBy("id").agg(F.count("*").alias("k"))
    heads = shared.join(settle(counts), "id").groupBy("t").agg(F.min(typical).alias("head")).select("t", F.col("head.id").alias("head"))
    others = settle(shared.select("t", "id", "n").join(settle(heads), "t").filter("id <> head"))
    star = others.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))
    found.add(settle(near.union(star).distinct()))

    # Whatever else shares a shingle and still isn't in one component.
    found.add(settle(found.apart(others, few, block)))
    gone = copies.union(found.component.filter("node > component").select("node"))
    name = "id"
    while name in docs.columns:
        name += "_"
    return docs.join(gone.select(F.col("id").alias(name)).distinct(), F.col(id_col) == F.col(name), "left_anti")
