"""Operator 12: clusters around centroids, by Lloyd's rounds with Hamerly's bounds, in exact integers.

Each vector's row carries an upper bound of the distance to its centroid and a lower bound of the distance to any other one. A round loosens
both by how far the centroids moved; where they still tell the nearest centroid apart, nothing is computed. Other vectors first get the exact distance to their
own centroid, and if that doesn't settle it, a full scan in exact integers. Each round reads the rows and their bounds from a table in the shared folder and writes
the next one; each task adds its vectors up for the new centroids, and only these sums meet.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_batches, remove, shared_dir

#: What bounds are loosened by for rounding, far above that of doubles.
_SLACK = 1e-12
#: Integers up to here have squared distances of 64 components that double precision holds exactly.
_EXACT = 1 << 22

_ROWS = "x binary, cluster int, upper double, lower double, distance bigint, n bigint, sums array<bigint>"


def limit(dim: int) -> int:
    """The largest absolute component for which any squared distance is a long."""
    return math.isqrt((2**62) // dim) // 2


def quantise(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles (n, dim) as longs."""
    with np.errstate(over="ignore"):
        v = np.floor(x * scale)
    if v.size and np.abs(v).max() > limit(v.shape[1]):
        raise ValueError(f"a component beyond {limit(v.shape[1]) / scale:g} has no squared distance that a long holds")
    return v.astype(np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (n, k) of integer vectors (n, dim) and (k, dim)."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= _EXACT and x.shape[1] <= 64:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], axis=1)


class Round:
    """Centroids of a round, how far they moved, and half the distance of each to its nearest neighbour."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.c, k = centroids, len(centroids)
        apart = np.sqrt(squares(centroids, centroids).astype(np.float64))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(axis=1) / 2 * (1 - _SLACK) if k > 1 else np.full(k, np.inf)
        self.moved = None
        if before is not None:
            self.moved = np.sqrt(((centroids - before) ** 2).sum(1).astype(np.float64)) * (1 + _SLACK)
            # The farthest that any other centroid moved.
            order = np.argsort(self.moved)
            self.others = np.full(k, self.moved[order[-1]])
            self.others[order[-1]] = self.moved[order[-2]] if k > 1 else 0.0

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """cluster, upper, lower, squared distance by a full scan; of equal distances the smaller number."""
        d = squares(x, self.c)
        near = d.argmin(axis=1)
        best = d[np.arange(len(x)), near]
        d[np.arange(len(x)), near] = np.iinfo(np.int64).max
        second = np.sqrt(d.min(axis=1).astype(np.float64)) * (1 - _SLACK) if len(self.c) > 1 else np.full(len(x), np.inf)
        return near, np.sqrt(best.astype(np.float64)) * (1 + _SLACK), second, best

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """cluster, upper, lower, squared distance (of all if last, else of those computed), and which vectors got a full scan."""
        upper = (upper + self.moved[cluster]) * (1 + _SLACK)
        loose = self.others[cluster]
        with np.errstate(invalid="ignore"):
            lower = lower - loose - _SLACK * (np.where(np.isinf(lower), 0, lower) + loose)
        bound = np.maximum(lower, self.half[cluster])
        distance = np.zeros(len(x), np.int64)
        doubt = np.flatnonzero((upper >= bound) | last)
        own = self._own(x[doubt], cluster[doubt])
        distance[doubt], upper[doubt] = own, np.sqrt(own.astype(np.float64)) * (1 + _SLACK)
        doubt = doubt[upper[doubt] >= bound[doubt]]
        scanned = np.zeros(len(x), bool)
        scanned[doubt] = True
        cluster = cluster.copy()
        cluster[doubt], upper[doubt], lower[doubt], distance[doubt] = self.scan(x[doubt])
        return cluster, upper, lower, distance, scanned

    def _own(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        return ((x - self.c[cluster]) ** 2).sum(1)


def _pack(x: np.ndarray) -> list[bytes]:
    """Each vector in two bytes a component where that holds it, else in four or eight."""
    size = np.abs(x).max(axis=1, initial=0)
    out: list[bytes] = [b""] * len(x)
    for kind, rows in (("<i2", size < 1 << 15), ("<i4", (size >= 1 << 15) & (size < 1 << 31)), ("<i8", size >= 1 << 31)):
        at = np.flatnonzero(rows)
        raw, step = x[at].astype(kind).tobytes(), x.shape[1] * int(kind[2])
        for j, i in enumerate(at.tolist()):
            out[i] = raw[j * step : j * step + step]
    return out


def _unpack(column: pa.Array, dim: int) -> np.ndarray:
    rows = column.to_pylist()
    size = np.fromiter(map(len, rows), np.int64, len(rows)) // dim
    x = np.zeros((len(rows), dim), np.int64)
    for width in (2, 4, 8):
        at = np.flatnonzero(size == width)
        if len(at):
            x[at] = np.frombuffer(b"".join(rows[i] for i in at.tolist()), f"<i{width}").reshape(-1, dim)
    return x


def _rows(ids: pa.Array, x: np.ndarray, cluster, upper, lower, distance) -> pa.RecordBatch:
    n = len(x)
    none = pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))
    columns = [ids, pa.array(_pack(x), pa.binary()), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.array(distance, pa.int64()), *none]
    return pa.record_batch(columns, ["vec_id", "x", "cluster", "upper", "lower", "distance", "n", "sums"])


class _Sums:
    """A task's number and componentwise sum of each cluster's vectors (of the distances, in the last round)."""

    def __init__(self, k: int, width: int):
        self.n, self.sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)

    def add(self, cluster: np.ndarray, values: np.ndarray) -> None:
        for k in range(len(self.n)):
            mine = cluster == k
            self.n[k] += mine.sum()
            self.sums[k] += values[mine].sum(axis=0)

    def rows(self, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(self.n)
        if len(at):
            m = len(at)
            none = [pa.nulls(m, id_type), pa.nulls(m, pa.binary()), pa.array(at, pa.int32()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.int64())]
            yield pa.record_batch([*none, pa.array(self.n[at]), pa.array(self.sums[at].tolist(), pa.list_(pa.int64()))], ["vec_id", "x", "cluster", "upper", "lower", "distance", "n", "sums"])


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 8,
    rounds: int = 10,
    dim: int = 64,
    scale: int = 1024,
    salt: str = "3:",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row for each kept vector.

    Kept are vectors of exactly ``dim`` components, none of them null, NaN or infinite; the others are left out. Components become floor(scale * x). Centroids start as
    the vectors with the least SHA-256 of salt and id (all kept vectors, if there are fewer than k; of a repeated id's rows the lesser vectors come first; a null id counts as an empty
    text). Ties in distance go to the smaller centroid. Repeated rows count each time; an empty table gives an empty result; other columns are not read. A component so large that
    its squared distance is no long (beyond ``limit(dim) / scale``, 131072 here) is an error.

    A round's rows stand as Parquet in the shared folder until the next round's are written; the last ones stay, as the result reads them.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float("inf"))))
    kept = vectors.filter((F.size("v") == dim) & sound)
    start = kept.withColumn("h", F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)).orderBy("h", "v").limit(k).collect()
    out = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    kind = kept.schema["vec_id"].dataType.simpleString()
    if not start:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    centroids, before = quantise(np.array([r["v"] for r in start], np.float64), scale), None
    folder = f"{shared_dir(spark)}/clusters-{uuid.uuid4().hex}"
    schema = f"vec_id {kind}, {_ROWS}"
    state = kept
    for r in range(rounds + 1):
        last = r == rounds
        assign = _first(centroids, scale, last) if r == 0 else _next(centroids, before, dim, last)
        state.transform(map_batches, assign, schema).write.parquet(f"{folder}/{r}")
        table = spark.read.schema(schema).parquet(f"{folder}/{r}")
        if r:
            remove(spark, f"{folder}/{r - 1}")
        state = table.filter("x is not null").select("vec_id", "x", "cluster", "upper", "lower")
        sums = table.filter("sums is not null").select("cluster", "n", F.posexplode("sums").alias("i", "value"))
        whole = sums.groupBy("cluster", "i").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
        totals = {(s["cluster"], s["i"]): (int(s["value"]), int(s["n"])) for s in whole.collect()}  # k x dim numbers
        if not last:
            before, centroids = centroids, centroids.copy()
            for (c, i), (value, n) in totals.items():
                centroids[c, i] = value // n
    own = {c: value for (c, _), (value, _) in totals.items()}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values: F.element_at(F.create_map(*(F.lit(x) for c in sorted(own) for x in (c, values[c]))), F.col("cluster"))
    found = table.filter("x is not null").select("vec_id", "cluster", "distance")
    return found.withColumns({"cluster_inertia": of(own).cast("bigint"), "inertia": F.lit(sum(own.values())).cast("bigint"), "centroid_sha256": of(shas)}).select(*out)


def _first(centroids: np.ndarray, scale: int, last: bool):
    """The first round: vectors to integers, all of them scanned."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, ids = Round(centroids, None), _Sums(len(centroids), 1 if last else centroids.shape[1]), pa.int64()
        for b in batches:
            x = quantise(b.column("v").flatten().to_numpy().reshape(b.num_rows, -1), scale) if b.num_rows else np.zeros((0, centroids.shape[1]), np.int64)
            near, upper, lower, distance = now.scan(x)
            sums.add(near, distance[:, None] if last else x)
            ids = b.column("vec_id").type
            yield _rows(b.column("vec_id"), x, near, upper, lower, distance)
        yield from sums.rows(ids)

    return assign


def _next(centroids: np.ndarray, before: np.ndarray, dim: int, last: bool):
    """A later round, from the rows and bounds of the one before."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, ids = Round(centroids, before), _Sums(len(centroids), 1 if last else dim), pa.int64()
        for b in batches:
            x = _unpack(b.column("x"), dim)
            near, upper, lower, distance, _ = now.assign(x, *(b.column(c).to_numpy() for c in ("cluster", "upper", "lower")), last)
            sums.add(near, distance[:, None] if last else x)
            ids = b.column("vec_id").type
            yield _rows(b.column("vec_id"), x, near, upper, lower, distance)
        yield from sums.rows(ids)

    return assign
