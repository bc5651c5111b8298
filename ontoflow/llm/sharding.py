"""Operator 10: a uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

Had all rows been permuted at random and cut into shards, the numbers of rows that each partition gives to
each shard would follow a multivariate hypergeometric law. These numbers are drawn first; then every
partition permutes its rows and deals them out accordingly, rows are exchanged by shard, and each shard is
permuted again. The law of sizes is ``rows``: shard counts differ by one at most.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import settle

#: Rows of the matrix at most (of more partitions, several share one); a block of the slots' numbering holds about so many rows.
MOST_PARTS, BLOCK_ROWS = 16_384, 50_000


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Of a uniform permutation: how many rows each partition gives to each shard. Rows and columns add up exactly."""
    rng, left = np.random.Generator(np.random.PCG64(seed)), np.array(shards, np.int64)
    out = np.zeros((len(rows), len(shards)), np.int64)
    for k, n in enumerate(rows):
        total = int(left.sum())
        for s in range(len(shards) - 1):  # one hypergeometric draw a shard
            if not n:
                break
            here, total = int(left[s]), total - int(left[s])
            got = _hypergeometric(rng, here, total, n)
            out[k, s], n = got, n - got
        out[k, -1] += n
        left -= out[k]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws from good and bad are good. numpy draws from up to 10^9 of a kind, inversion from more."""
    if not n or not good:
        return 0
    if not bad:
        return n
    return int(rng.hypergeometric(good, bad, n)) if max(good, bad) < 1_000_000_000 else inversion(rng, good, bad, n)


def inversion(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw from the probabilities around the mode, each from its neighbour's by their exact ratio.

    What lies 12 standard deviations off weighs under 10^-30, so the law is exact up to the rounding of doubles.
    """
    total = good + bad
    least, most = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (total + 2), least), most)
    width = int(12 * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1)))) + 64
    low, high = max(least, mode - width), min(most, mode + width)
    up, down = np.arange(mode, high, dtype=np.float64), np.arange(mode, low, -1, dtype=np.float64)
    rise = np.log(good - up) + np.log(n - up) - np.log(up + 1) - np.log(up + (bad - n + 1))
    fall = np.log(down) + np.log(down + (bad - n)) - np.log(good - down + 1) - np.log(n - down + 1)
    weight = np.exp(np.concatenate([np.cumsum(fall)[::-1], [0.0], np.cumsum(rise)]))
    sums = np.cumsum(weight)
    return low + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def shard(
    docs: DataFrame,
    n_shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 42,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: where each row goes.

    A null text has size 8 and the CRC of no bytes; ids may be null or repeat, as rows are dealt, not ids;
    an empty table gives an empty result; with fewer rows than shards some shards stay empty. Other
    columns are not read. The same partitions and seed give the same result; a lost executor changes nothing.
    """
    spark = docs.sparkSession
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = settle(rows).withColumns({"_part": F.pmod(F.spark_partition_id(), F.lit(MOST_PARTS)), "_row": F.monotonically_increasing_id()})
    counts = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect())  # MOST_PARTS rows at most
    total = sum(n for _, n in counts)
    capacity = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([n for _, n in counts], capacity, seed)
    ends = [(p, m.cumsum().tolist()) for (p, _), m in zip(counts, matrix)]
    ends = spark.createDataFrame(ends, "_part int, _ends array<bigint>")  # MOST_PARTS x n_shards numbers at most
    # Permute locally: within its partition, a row's place is its rank by a hash.
    local = F.row_number().over(Window.partitionBy("_part").orderBy(F.xxhash64(F.lit(seed), "_row"), "_row"))
    dealt = rows.withColumn("_local", local).join(F.broadcast(ends), "_part")
    dealt = dealt.withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_local"))))
    # Permute again: slots follow a second hash, whose leading part makes blocks that are numbered apart.
    blocks = max(1, -(-total // n_shards // BLOCK_ROWS))
    again = F.xxhash64(F.lit(seed + 1), "_row")
    dealt = dealt.withColumn("_hash", again).withColumn("_block", F.floor((F.col("_hash") / 2.0**64 + 0.5) * blocks).cast("long"))
    dealt = settle(dealt.select("doc_id", "size", "text_crc32", "shard", "_block", "_hash", "_row"))
    before = dealt.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = before.select("shard", "_block", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_block")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_hash", "_row")) - 1
    out = dealt.withColumn("_place", place).join(before, ["shard", "_block"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_before") + F.col("_place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
