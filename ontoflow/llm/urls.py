"""Operator 9: URL filters by rules, and by a character language-model ratio where no rule fits.

Two smoothed variable-order Markov models of characters (orders 0 to ``order``, Witten-Bell interpolated), one
of allowed and one of blocked URLs, score a URL by the difference of their log-likelihoods by length. The
threshold is calibrated on labelled URLs that neither model has seen.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import ascii_lower, map_batches, settle

#: The contract's rules: (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url or one without ://."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; of equal length the first listed."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class Markov:
    """Counts of characters after each context of 0 to ``order`` characters, interpolated from short to long."""

    def __init__(self, order: int, alphabet: int = 256):
        self.order, self.alphabet = order, alphabet
        self.next: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        self.known: dict[str, float] = {}

    def fit(self, texts: list[str]) -> Markov:
        for text in texts:
            padded = "\x02" * self.order + text + "\x03"
            for k in range(self.order, len(padded)):
                for n in range(self.order + 1):
                    self.next[padded[k - n : k]][padded[k]] += 1
        self.next = {c: dict(x) for c, x in self.next.items()}
        return self

    def log_p(self, context: str, char: str) -> float:
        if (seen := self.known.get(context + char)) is not None:
            return seen
        p = 1 / self.alphabet
        for n in range(len(context) + 1):
            if not (after := self.next.get(context[len(context) - n :])):
                break
            total, kinds = sum(after.values()), len(after)
            p = (after.get(char, 0) + kinds * p) / (total + kinds)
        if len(self.known) > 500_000:
            self.known.clear()
        self.known[context + char] = out = math.log(p)
        return out


def ratio(allowed: Markov, blocked: Markov, text: str) -> float:
    """Mean log-likelihood difference by character; above zero is more like an allowed URL."""
    order = allowed.order
    padded = "\x02" * order + text + "\x03"
    spots = [(padded[k - order : k], padded[k]) for k in range(order, len(padded))]
    return sum(allowed.log_p(c, x) - blocked.log_p(c, x) for c, x in spots) / len(spots)


def calibrate(scores: np.ndarray, good: np.ndarray) -> float:
    """The threshold of the highest balanced accuracy; 0 if either class is missing."""
    if not good.any() or good.all() or not len(good):
        return 0.0
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    kept = 1 - np.concatenate([[0], np.cumsum(g)]) / g.sum()
    refused = np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    edges = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    valid = np.concatenate([[True], s[1:] > s[:-1], [True]])
    best = np.where(valid, kept + refused, -1)
    return float(edges[int(np.argmax(best))])


def counts(texts: DataFrame, order: int) -> DataFrame:
    """verdict, context, char, n over all texts (verdict, text): how often the character follows each context of 0 to ``order`` characters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for verdict, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                padded = "\x02" * order + text + "\x03"
                for k in range(order, len(padded)):
                    seen.update((verdict, padded[k - n : k], padded[k]) for n in range(order + 1))
            columns = list(zip(*seen)) or [[], [], []]
            yield pa.record_batch([*(pa.array(c, pa.string()) for c in columns), pa.array(list(seen.values()), pa.int64())], ["verdict", "context", "char", "n"])

    partial = texts.select("verdict", "text").transform(map_batches, count, "verdict string, context string, char string, n bigint")
    return partial.groupBy("verdict", "context", "char").agg(F.sum("n").alias("n"))


def spots(texts: DataFrame, order: int) -> DataFrame:
    """The columns of texts with pos, context, char: each character (and the end) after its ``order`` predecessors."""
    padded = F.concat(F.lit("\x02" * order), "text", F.lit("\x03"))
    at = texts.withColumn("padded", padded).withColumn("pos", F.explode(F.sequence(F.lit(1), F.length("padded") - order)))
    return at.withColumns({"context": F.substring("padded", F.col("pos"), F.lit(order)), "char": F.substring("padded", F.col("pos") + order, F.lit(1))}).drop("padded")


def gains(of: DataFrame, counted: DataFrame, order: int, alphabet: int = 256) -> DataFrame:
    """context, char, gain for distinct (context, char): the difference of the characters' log-likelihoods by the two models' counts, as Markov.log_p has them."""
    totals = counted.groupBy("verdict", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).withColumnsRenamed({"context": "c", "verdict": "v"})
    after = counted.withColumnsRenamed({"context": "c", "verdict": "v", "char": "x"})
    levels = F.explode(F.sequence(F.lit(0), F.lit(order)))
    each = of.withColumn("k", levels).withColumn("v", F.explode(F.array(F.lit("allow"), F.lit("block")))).withColumn("c", F.expr(f"substring(context, {order} - k + 1, k)"))
    met = each.join(totals, ["v", "c"]).join(after.withColumnRenamed("x", "char"), ["v", "c", "char"], "left")
    steps = F.array_sort(F.collect_list(F.struct("k", F.coalesce("n", F.lit(0)).cast("double").alias("n"), "total", "kinds")))
    # A context that was seen has all of its suffixes seen, so the levels met are the first ones.
    p = F.aggregate("steps", F.lit(1.0 / alphabet), lambda p, s: (s["n"] + s["kinds"] * p) / (s["total"] + s["kinds"]))
    by = met.groupBy("context", "char", "v").agg(steps.alias("steps")).withColumn("log_p", F.log(p))
    return by.groupBy("context", "char").agg(F.sum(F.when(F.col("v") == "allow", F.col("log_p")).otherwise(-F.col("log_p"))).alias("gain"))


def scores(texts: DataFrame, counted: DataFrame, order: int) -> DataFrame:
    """verdict, text, score of distinct texts: the mean gain by character."""
    every = spots(texts, order)
    gained = settle(gains(every.select("context", "char").distinct(), counted, order))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "gain")))
    found = every.join(gained, ["context", "char"]).groupBy("verdict", "text").agg(ordered.alias("by"))
    return found.select("verdict", "text", (F.aggregate("by", F.lit(0.0), lambda s, x: s + x["gain"]) / F.size("by")).alias("score"))


def threshold(scored: DataFrame, buckets: int = 1024) -> float:
    """What ``calibrate`` gives, for scores (verdict, score) of any number: sums by bucket reach the driver, the running sums within a bucket are Spark's."""
    is_good = F.col("verdict") == "allow"
    by = settle(scored.groupBy("score").agg(F.sum(is_good.cast("long")).alias("g"), F.sum((~is_good).cast("long")).alias("b")))
    low, high, good, bad = by.agg(F.min("score"), F.max("score"), F.sum("g"), F.sum("b")).first()
    if not good or not bad:
        return 0.0
    bucket = F.least(F.floor((F.col("score") - low) / (high - low or 1.0) * buckets), F.lit(buckets - 1))
    by = by.withColumn("bucket", bucket)
    sums = by.groupBy("bucket").agg(F.sum("g").alias("g"), F.sum("b").alias("b"), F.min("score").alias("first")).orderBy("bucket").collect()
    starts, g, b = [], 0, 0
    for r, after in zip(sums, [*sums[1:], None]):
        starts.append((r["bucket"], g, b, after["first"] if after else high + 2))
        g, b = g + r["g"], b + r["b"]
    starts = scored.sparkSession.createDataFrame(starts, "bucket long, g0 long, b0 long, then double")
    w = Window.partitionBy("bucket").orderBy("score")
    edge = by.join(F.broadcast(starts), "bucket").select(
        ((F.col("score") + F.coalesce(F.lead("score").over(w), "then")) / 2).alias("edge"),
        ((1 - (F.sum("g").over(w) + F.col("g0")) / good) + (F.sum("b").over(w) + F.col("b0")) / bad).alias("worth"),
    )
    best = edge.agg(F.max(F.struct("worth", (-F.col("edge")).alias("e"))).alias("m")).first()["m"]
    return float(-best["e"]) if best["worth"] > 1 else float(low - 1)


def judge(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: list[tuple[str, str, str]] = RULES,
    order: int = 4,
    seed: int = 42,
) -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row for each input row.

    The models learn from all distinct URLs (host and path) that a rule judges; a quarter of them, by hash, calibrates the threshold, the others are counted. Counts and
    scores stay in Spark: each distinct character after its predecessors joins the counts of its contexts, and a URL the gains of its characters. Where rules judge no URLs as allowed, or none as blocked, all
    others are allowed. A null url is judged as an empty one; ids may be null or repeat; an empty table gives an empty result; other columns are not read.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    host, path = host_path(F.col("url"))
    pages = pages.withColumns({"host": host, "path": path})
    pages = pages.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    ready = pages.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"), F.concat("host", "path").alias("text"))
    ruled = ready.filter("rule is not null").select("verdict", "text").distinct()
    ruled = settle(ruled.withColumn("held", F.pmod(F.xxhash64(F.lit(seed + 1), "text"), F.lit(4)) == 0))
    of = {(r["verdict"], r["held"]) for r in ruled.select("verdict", "held").distinct().collect()}
    columns = ["page_id", "host", "path", "rule"]
    if not {"allow", "block"} <= {v for v, _ in of}:
        return ready.select(*columns, F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    learn = ruled.filter("not held") if {("allow", False), ("block", False)} <= of else ruled
    counted = settle(counts(learn, order))
    least = threshold(scores(ruled.filter("held").select("verdict", "text"), counted, order))
    open_ = ready.filter("rule is null")
    judged = scores(open_.select(F.lit("").alias("verdict"), "text").distinct(), counted, order).select("text", "score")
    said = F.when(F.col("score") >= least, "allow").otherwise("block")
    rest = open_.join(judged, "text", "left").select(*columns, said.alias("verdict"), "score")
    return ready.filter("rule is not null").select(*columns, "verdict", F.lit(None).cast("double").alias("score")).unionByName(rest)
