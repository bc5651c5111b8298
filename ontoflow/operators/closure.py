"""Loops over edges: transitive closure, reachability, restriction depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoflow.plans.storage import grow, settle


def transitive_closure(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """All pairs (s, o) joined by a path of one edge or more; cycles are no problem.

    Paths double each round: what a round found joins everything found so far on both sides, so a chain of n
    edges takes about log2(n) rounds. Rows with a null end are left out.
    """
    total = settle(edges.select("s", "o").filter("s is not null and o is not null").distinct())
    delta = total
    for _ in range(max_rounds):
        left = delta.alias("a").join(total.alias("b"), F.col("a.o") == F.col("b.s")).select("a.s", "b.o")
        right = total.alias("a").join(delta.alias("b"), F.col("a.o") == F.col("b.s")).select("a.s", "b.o")
        delta = settle(left.union(right).distinct().join(total, ["s", "o"], "left_anti"))
        if delta.isEmpty():
            return total
        total = grow(total, delta)
    raise RuntimeError(f"no closure in {max_rounds} rounds")


def leveled_closure(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """s, o, l: the closure of edges with levels, each pair with its least one.

    A pair of level 2 or less goes on over an edge of level 1 to a pair of level 2; a pair of any level but 3 (reflexive ones) goes on over an edge of level 4
    (what a union is below) to a pair of level 5. Levels of told edges are 1, 3 and 4. A pair found again at a lower level goes on again; cycles end, as levels only fall.
    Rows with a null are left out.
    """
    base = settle(edges.filter("s is not null and o is not null and l is not null").groupBy("s", "o").agg(F.min("l").cast("int").alias("l")))
    told, unions = (base.filter(f"l = {n}").select(F.col("s").alias("m"), "o") for n in (1, 4))
    total = delta = base
    for _ in range(max_rounds):
        step = lambda cond, over, level: delta.filter(cond).select("s", F.col("o").alias("m")).join(over, "m").select("s", "o", F.lit(level).alias("l"))  # noqa: E731, B023
        found = step("l <= 2", told, 2).union(step("l <> 3", unions, 5)).groupBy("s", "o").agg(F.min("l").alias("l"))
        known = total.select("s", "o", F.col("l").alias("known"))
        delta = settle(found.join(known, ["s", "o"], "left").filter("known is null or l < known").select("s", "o", "l"))
        if delta.isEmpty():
            return total
        total = settle(total.union(delta).groupBy("s", "o").agg(F.min("l").alias("l")))
    raise RuntimeError(f"no closure in {max_rounds} rounds")


def reachable(start: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Nodes (s) that start (s) reaches over edges (s, o), itself included."""
    total = settle(start.select("s").distinct())
    delta = total
    for _ in range(max_rounds):
        step = delta.join(edges, "s").select(F.col("o").alias("s")).distinct()
        delta = settle(step.join(total, "s", "left_anti"))
        if delta.isEmpty():
            return total
        total = grow(total, delta)
    raise RuntimeError(f"reachability unsettled after {max_rounds} rounds")


def restriction_depth(some: DataFrame, only: DataFrame, of: DataFrame, is_a: DataFrame | None = None) -> DataFrame:
    """s, depth: the number of distinct restrictions that each node of ``of`` (s) reaches through values (and is_a edges, if given), itself included."""
    restrictions = some.union(only).select("s", "value").distinct()
    steps = restrictions.select("s", F.col("value").alias("o"))
    if is_a is not None:
        steps = steps.union(is_a.select("s", "o"))
    pairs = transitive_closure(steps.distinct()).union(of.select("s", F.col("s").alias("o"))).distinct()
    counted = pairs.join(restrictions.select(F.col("s").alias("o")).distinct(), "o").groupBy("s").agg(F.count("*").alias("depth"))
    return of.select("s").distinct().join(counted, "s", "left").select("s", F.coalesce("depth", F.lit(0)).alias("depth"))
