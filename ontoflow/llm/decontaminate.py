"""Operator 6: benchmark decontamination with a broadcast set of normalised test n-grams.

Every window of n words holds, at some multiple of n - a + 1, the start of an a-word anchor. Each document's
anchors at these places are looked up in a bit set of all benchmark anchors, so that the scan keeps only the
windows around likely places; these join the broadcast set of windows, which verifies them word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, settle

ANCHOR = 4
#: The set of windows is broadcast up to so many rows (about 100 bytes each); a larger benchmark joins by shuffle.
MOST_BROADCAST = 2_000_000


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none. Fixed value: the contract's word pattern."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def gram(array: Column, at: Column, n: int) -> Column:
    return F.concat_ws(" ", F.slice(array, at + 1, n))


def windows(items: DataFrame, n: int) -> DataFrame:
    """item_id, k, gram: the distinct windows of items (item_id, w); k words each, n or all of a shorter item."""
    items = items.filter(F.size("w") > 0).withColumn("k", F.least(F.lit(n), F.size("w")))
    at = F.explode(F.sequence(F.lit(0), F.size("w") - F.col("k")))
    items = items.select("item_id", "w", "k", at.alias("at"))
    return items.select("item_id", "k", F.concat_ws(" ", F.slice("w", F.col("at") + 1, F.col("k"))).alias("gram")).distinct()


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))


def _bit_set(grams: DataFrame, k: int, anchor: int) -> tuple[Column, int] | None:
    """The anchors of k-word windows as bits of an array of longs, 32 bits for each anchor or more, 2^24 bits at most."""
    w = F.split("gram", " ")
    anchors = grams.filter(F.col("k") == k).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - anchor)), lambda i: F.xxhash64(gram(w, i, anchor)))).alias("h")).distinct()
    anchors = anchors.persist()
    try:
        n = anchors.count()
        if not n:
            return None
        log = min(24, max(12, (32 * n).bit_length()))
        place = F.pmod("h", F.lit(1 << log))
        groups = anchors.groupBy(F.floor(place / 64).cast("long").alias("at")).agg(F.bit_or(_bit(F.col("h"))).alias("bits"))
        bits = [0] * (1 << log - 6)
        for r in groups.collect():  # 2^18 rows at most
            bits[r["at"]] = r["bits"]
        return F.from_json(F.lit(str(bits)), "array<bigint>"), log
    finally:
        anchors.unpersist()


def _near(grams: DataFrame, k: int) -> Column:
    """The windows of k words (at, k, gram) around those of column w's anchors that the benchmark may have."""
    anchor = min(ANCHOR, k)
    bits, log = _bit_set(grams, k, anchor)
    stride, w = k - anchor + 1, F.col("w")

    def likely(i: Column) -> Column:
        h = F.xxhash64(gram(w, i, anchor))
        return F.get(bits, F.floor(F.pmod(h, F.lit(1 << log)) / 64).cast("int")).bitwiseAND(_bit(h)) != 0

    starts = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - anchor, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    first, last = (lambda i: F.greatest(i - (stride - 1), F.lit(0))), (lambda i: F.least(i, F.size(w) - k))
    around = F.transform(F.filter(starts, likely), lambda i: F.when(first(i) <= last(i), F.sequence(first(i), last(i))).otherwise(F.array().cast("array<int>")))
    return F.transform(F.flatten(around), lambda at: F.struct(at.cast("int").alias("at"), F.lit(k).alias("k"), gram(w, at, k).alias("gram")))


def find_windows(docs: DataFrame, items: DataFrame, n: int = 13) -> DataFrame:
    """_row, doc_id, n_words, at, k, item_id: a row for each occurrence of an item's window, or one with nulls for a document without any.

    docs has _row, doc_id and w, items has item_id and w (arrays of words).
    """
    grams = settle(windows(items, n))
    found = None
    for k in sorted(r["k"] for r in grams.select("k").distinct().collect()):  # n rows at most
        docs = docs.withColumn(f"_near{k}", _near(grams, k))
        found = [*(found or []), F.col(f"_near{k}")]
    kind = "array<struct<at:int,k:int,gram:string>>"
    near = F.concat(*found) if found else F.lit(None).cast(kind)
    docs = docs.select("_row", "doc_id", F.size("w").alias("n_words"), F.explode_outer(near).alias("x")).select("_row", "doc_id", "n_words", "x.at", "x.k", "x.gram")
    small = grams.count() <= MOST_BROADCAST
    grams = grams.select(F.col("k").alias("_k"), F.col("gram").alias("_gram"), "item_id")
    return docs.join(F.broadcast(grams) if small else grams, (F.col("gram") == F.col("_gram")) & (F.col("k") == F.col("_k")), "left").select("_row", "doc_id", "n_words", "at", "k", "item_id")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    n: int = 13,
    one_in: int = 20,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans: one row for each document row.

    spans are [from, to) word ranges that windows cover; contaminated: one word in ``one_in`` or more is hit. A null text has no words, so no hits; a null item
    text gives no window, a null item_id doesn't count as an item; repeated rows are judged each; equal
    items count each; empty tables give no rows, or no hits. Other columns are not read.
    """
    docs = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    items = benchmark.select(F.col(item_id_col).cast("string").alias("item_id"), words(F.col(item_text_col)).alias("w"))
    found = find_windows(docs, items, n)
    hit = F.col("item_id").isNotNull()
    per = found.groupBy("_row", "doc_id", "n_words").agg(
        F.collect_set(F.when(hit, F.struct(F.col("at").alias("from"), (F.col("at") + F.col("k")).alias("to")))).alias("ranges"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )
    # Every hit word once, in order; a span begins and ends where a neighbour isn't hit.
    hits = F.array_sort(F.array_distinct(F.flatten(F.transform("ranges", lambda x: F.sequence(x["from"], x["to"] - 1)))))
    per = per.withColumn("hits", hits).withColumns({"n_hit": F.size("hits").cast("long"), "n_words": F.col("n_words").cast("long")})
    first = F.filter("hits", lambda x, k: (k == 0) | (F.get("hits", k - 1) != x - 1))
    last = F.transform(F.filter("hits", lambda x, k: F.coalesce(F.get("hits", k + 1) != x + 1, F.lit(True))), lambda x: x + 1)
    per = per.withColumn("spans", F.arrays_zip(first.alias("from"), last.alias("to")))
    return per.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words"))).alias("contaminated"),
        "spans",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all their columns, without those whose text is contaminated.

    Each row is judged by its own text, whatever its id: ids may be null or repeat. Rows with a null text stay, repeated rows fare alike,
    an empty table gives an empty result, and no column name clashes.
    """
    fingerprint = next(n for k in range(len(docs.columns) + 1) if (n := f"_print{k}") not in docs.columns)
    text = docs[f"`{text_col}`"]
    prints = docs.select(F.md5(text).alias("doc_id"), text.alias("text"))
    bad = contamination(prints, benchmark, **options).filter("contaminated").select(F.col("doc_id").alias(fingerprint)).distinct()
    return docs.join(bad, F.md5(text) == bad[fingerprint], "left_anti")
