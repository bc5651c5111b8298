"""Operator 8: embedding near-duplicates by int8 tile products with rigorous error bounds.

Equal vectors of a label are one representative. Representatives are quantised once, and cut into blocks of equal numbers in order of their
projection on a fixed direction (ties by id); two unit vectors of cosine t or more are sqrt(2 - 2t) apart at most, and so are their
projections, so block pairs further apart are skipped. Only int8 codes travel to the tiles; vectors follow for tiles with doubtful pairs. A tile multiplies the codes of two blocks; with
x = x^ + e, the true product differs from that of the codes by |x^||f| + |e||y^| + |e||f| at most. Pairs above the threshold by more than
this bound are links, pairs below it by more are none, and only the rest is computed in double precision from the vectors themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ._common import map_batches, settle
from ._graph import components, forest


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes of unit vectors, the scale of each, the norm of each decoded vector and a bound of each error's norm."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    decoded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(decoded, axis=1), np.linalg.norm(x - decoded, axis=1) + 1e-12


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one (by their greatest component first, so that nothing overflows)."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def tile_pairs(a: tuple, b: tuple, threshold: float, rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index arrays (i, j) of rows of two quantised blocks whose cosine may reach the threshold, and whether it surely does."""
    (qa, sa, na, ea), (qb, sb, nb, eb) = a, b
    # Products of int8 codes are exact in float32 up to 1040 dimensions, and in float64 beyond.
    kind = np.float32 if 127 * 127 * qa.shape[1] < 2**24 else np.float64
    turned = qb.astype(kind).T
    for k in range(0, len(qa), rows):
        part = slice(k, k + rows)
        product = (qa[part].astype(kind) @ turned).astype(np.float64) * (sa[part, None] * sb)
        bound = na[part, None] * eb + ea[part, None] * nb + ea[part, None] * eb + 1e-9
        i, j = np.nonzero(product + bound >= threshold)
        yield i + k, j, product[i, j] - bound[i, j] >= threshold


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _projected(kinds: DataFrame) -> DataFrame:
    """kinds with dim and p, the projection of the unit vector v on a fixed direction of signs."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(b.schema.get_field_index("v"))
            size, p = pc.list_value_length(v).to_numpy(), np.zeros(b.num_rows)
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                sign = np.random.default_rng(dim).choice([-1.0, 1.0], dim)
                p[at] = unit(_matrix(v.take(pa.array(at)), dim)) @ sign / math.sqrt(dim)
            yield pa.record_batch([*b.columns, pa.array(size, pa.int32()), pa.array(p)], [*b.schema.names, "dim", "p"])

    return kinds.transform(map_batches, project, StructType([*kinds.schema.fields, StructField("dim", IntegerType()), StructField("p", DoubleType())]))


def _blocks(kinds: DataFrame, block: int) -> DataFrame:
    """no, label, dim, low, high, reps, ns, codes, scales, norms, errors, vectors: a row for each block of ``block`` representatives at most.

    Rows are dealt by ranges of (label, dim, projection, id), so that neither a hot label nor equal projections meet in one task.
    """
    order = ["label", "dim", "p", "k"]
    sorted_ = kinds.select(*order, "rep", "n", "v").repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["label", "dim", "low", "high", "reps", "ns", "codes", "scales", "norms", "errors", "vectors"]

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        held = pa.Table.from_batches(parts).combine_chunks()
        dim, p = held.column("dim")[0].as_py(), held.column("p").to_numpy()
        whole = unit(_matrix(held.column("v").chunk(0), dim))
        sides = *quantise(whole), whole
        lists = [pa.array([held.column(x).to_numpy()], pa.list_(pa.int64())) for x in ("rep", "n")]
        raw = [pa.array([x.tobytes()], pa.binary()) for x in sides]
        return pa.record_batch([held.column("label").chunk(0)[:1], pa.array([dim], pa.int32()), pa.array([p.min()]), pa.array([p.max()]), *lists, *raw], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, have, key = [], 0, None
        for b in batches:
            label, dim = b.column(0).dictionary_encode().indices.to_numpy(), b.column(1).to_numpy()
            ends = [*(np.flatnonzero((label[1:] != label[:-1]) | (dim[1:] != dim[:-1])) + 1).tolist(), b.num_rows]
            at = 0
            while at < b.num_rows:
                new = (b.column(0)[at].as_py(), int(dim[at]))
                if parts and (new != key or have == block):
                    yield flush(parts)
                    parts, have = [], 0
                key, end = new, min(next(e for e in ends if e > at), at + block - have)
                parts.append(b.slice(at, end - at))
                have, at = have + end - at, end
        if parts:
            yield flush(parts)

    label = kinds.schema["label"].dataType.simpleString()
    schema = f"label {label}, dim int, low double, high double, reps array<bigint>, ns array<bigint>, codes binary, scales binary, norms binary, errors binary, vectors binary"
    return settle(sorted_.transform(map_batches, cut, schema)).withColumn("no", F.monotonically_increasing_id())


def _count(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, count: dict, root: dict) -> dict:
    """Add links a - b of na and nb equal vectors to the numbers of links by end; the forest root with them."""
    for at, n in ((a, nb), (b, na)):
        who, where = np.unique(at, return_inverse=True)
        for w, m in zip(who.tolist(), np.bincount(where, n).tolist()):
            count[w] = count.get(w, 0) + int(m)
    return forest(a.tolist(), b.tolist(), root)


def _summed(root: dict, count: dict) -> pa.RecordBatch:
    """rep, root, links of a forest and the numbers of links."""
    return pa.record_batch([pa.array(list(root), pa.int64()), pa.array(list(root.values()), pa.int64()), pa.array([count[w] for w in root], pa.int64())], ["rep", "root", "links"])


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    block: int = 1024,
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each input row.

    Vectors link within a label, at the threshold or above. Rows with a null id, a null label or a vector that is
    null, empty, zero or holds nulls or non-finite numbers link with nothing: no links, their own component.
    Vectors of different dimensions don't link. Repeated rows are different vectors, linked with each other; vectors
    that share an id share its links. An empty table gives an empty result; other columns are not read.
    """
    v = F.col("v")
    sound = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(v, lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    good = rows.filter("sound").select("vec_id", "label", "v")
    kinds = good.groupBy("label", "v").agg(F.min("vec_id").cast("long").alias("rep"), F.count("*").alias("n"))
    # Each kind of vector has a number of its own, as vectors may share an id.
    kinds = settle(_projected(kinds)).withColumn("k", F.monotonically_increasing_id())
    blocks = _blocks(kinds, block)
    reach = math.sqrt(2 - 2 * threshold) + 1e-6
    ends = blocks.select("label", "dim", "no", "low", "high")
    other = ends.select("label", "dim", F.col("no").alias("no2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    pairs = ends.join(other, ["label", "dim"]).filter((F.col("no") <= F.col("no2")) & (F.col("low2") <= F.col("high") + reach) & (F.col("low") <= F.col("high2") + reach))
    side = ["dim", "reps", "ns", "codes", "scales", "norms", "errors"]
    tiles = pairs.select("no", "no2").join(blocks.select("no", *side), "no").join(blocks.select(F.col("no").alias("no2"), *[F.col(x).alias(f"{x}2") for x in side]), "no2")

    def coded(batch: pa.RecordBatch, r: int, first: int) -> tuple:
        dim = batch.column(first)[r].as_py()
        codes, *rest = (batch.column(first + k)[r].as_buffer() for k in range(3, 7))
        return np.frombuffer(codes, np.int8).reshape(-1, dim), *(np.frombuffer(x) for x in rest)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for batch in batches:
            for r in range(batch.num_rows):
                ra, ca, rb, cb = (batch.column(k)[r].values.to_numpy() for k in (3, 4, 10, 11))
                no, no2 = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                count: dict = {}
                root: dict = {}
                a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i, j, sure in tile_pairs(coded(batch, r, 2), coded(batch, r, 9), threshold):
                    if no == no2:
                        i, j, sure = i[i < j], j[i < j], sure[i < j]
                    a.append(i[~sure])
                    b.append(j[~sure])
                    i, j = i[sure], j[sure]
                    root = _count(ra[i], rb[j], ca[i], cb[j], count, root)
                yield pa.record_batch([*_summed(root, count).columns, *(pa.nulls(len(root), x) for x in (pa.int64(), pa.int64(), ints, ints))], columns)
                if any(map(len, a)):
                    doubt = (pa.array([np.concatenate(x).astype(np.int32)], ints) for x in (a, b))
                    yield pa.record_batch([*(pa.nulls(1, pa.int64()) for _ in range(3)), pa.array([no]), pa.array([no2]), *doubt], columns)

    # Rows with links are what tiles are sure of (a tree of each tile's links, and their number by end); the others are tiles with their doubtful pairs.
    columns = ["rep", "root", "links", "no", "no2", "i", "j"]
    tiled = tiles.select("no", "no2", *side, *[f"{x}2" for x in side]).transform(map_batches, link, "rep bigint, root bigint, links bigint, no bigint, no2 bigint, i array<int>, j array<int>")
    tiled = settle(tiled)
    held = ["dim", "reps", "ns", "vectors"]
    doubtful = tiled.filter("links is null").select("no", "no2", "i", "j").join(blocks.select("no", *held), "no")
    doubtful = doubtful.join(blocks.select(F.col("no").alias("no2"), *[F.col(x).alias(f"{x}2") for x in held[1:]]), "no2")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                i, j, ra, ca, rb, cb = (batch.column(k)[r].values.to_numpy() for k in (1, 2, 3, 4, 6, 7))
                va, vb = (np.frombuffer(batch.column(k)[r].as_buffer()).reshape(-1, batch.column(0)[r].as_py()) for k in (5, 8))
                count: dict = {}
                root: dict = {}
                for k in range(0, len(i), 1 << 16):
                    p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                    true = np.einsum("nd,nd->n", va[p], vb[q]) >= threshold
                    root = _count(ra[p[true]], rb[q[true]], ca[p[true]], cb[q[true]], count, root)
                yield _summed(root, count)

    checked = doubtful.select("dim", "i", "j", "reps", "ns", "vectors", "reps2", "ns2", "vectors2").transform(map_batches, verify, "rep bigint, root bigint, links bigint")
    linked = tiled.filter("links is not null").select("rep", "root", "links").union(settle(checked))
    graph = components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = linked.groupBy(F.col("rep").alias("node")).agg(F.sum("links").alias("links"))
    found = graph.join(links, "node").select("node", "component", "links")
    ends = kinds.select("label", "v", "rep", "n").join(found, F.col("rep") == F.col("node"), "left")
    ends = settle(ends.select(F.col("label").alias("_label"), F.col("v").alias("_v"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = good.join(ends, (F.col("label") == F.col("_label")) & (v == F.col("_v"))).select("vec_id", "n_links", "component_id")
    rest = rows.filter("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
