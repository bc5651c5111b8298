"""Operator 4: token counts by a map-side two-tier lookup.

Tier one is a compact hash table from the corpus's most frequent pieces (what stands between spaces: a pre-token, or a few) to their numbers of tokens. The pieces
come from a frequent-items sketch over all texts (only sketches move, no pre-token is shuffled); the table holds at
most ``table_size`` entries of 10 bytes whatever the corpus's size, and is broadcast. Tier two is a bounded cache in
each Python worker, which encodes what the table lacks and serves all tasks of the worker. Both tiers only save work: every count is the library's, unless two
different pieces share a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bpe
from ._common import map_batches, tokenizer_path


def frequent_pretokens(docs: DataFrame, text_col: str = "text", table_size: int = 8192) -> list[str]:
    """The most frequent space-led pre-tokens (at most table_size, without the space) over all texts."""
    words = docs.select(F.explode(F.split(F.col(text_col), " ")).alias("w"), F.pmod(F.spark_partition_id(), F.lit(64)).alias("part"))
    items = 2 * table_size
    sketches = words.filter(f"length(w) <= {_bpe.LONGEST}").groupBy("part").agg(F.expr(f"approx_top_k_accumulate(w, {items})").alias("s"))
    # Sketches merge in a tree of eights; a group at the top too, as an aggregate without one fails on a task that has no rows.
    for parts in (8, 1):
        sketches = sketches.groupBy(F.pmod("part", F.lit(parts)).alias("part")).agg(F.expr(f"approx_top_k_combine(s, {items})").alias("s"))
    top = sketches.select(F.expr(f"approx_top_k_estimate(s, {table_size})").alias("t"))
    found = top.select(F.expr("transform(t, x -> x.item)").alias("t")).first()
    return list((found and found.t) or [])


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    limit: int = 1024,
    table_size: int = 8192,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each input row.

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows are counted each;
    an empty table gives an empty result; columns other than id_col and text_col are not read.
    """
    spark, path = docs.sparkSession, tokenizer or tokenizer_path()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    frequent = [w for w in frequent_pretokens(docs, "text", table_size) if w]
    table = spark.sparkContext.broadcast(_bpe.Lengths(frequent, _bpe.Library(path)))  # table_size entries at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _bpe.encoder(path)
        for whole in batches:
            for b in _bpe.slices(whole, 1):
                texts = _bpe.strings(b.column(1))
                size = pc.binary_length(texts).cast(pa.int64())
                yield pa.record_batch([b.column(0), size, pa.array(encoder.lengths(texts, table.value))], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.transform(map_batches, count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
