"""Which nodes need inferences: marks that spread from named entities over edges, lists and restrictions.

A node is marked ``descendants`` if what is below it matters, ``ancestors`` if what is above it does. A universal turns one into the other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoflow.operators.closure import reachable
from ontoflow.plans.storage import settle

DOWN, UP = "descendants", "ancestors"
#: Each rule: the mark it starts from, the relation it goes along, and the mark it gives.
STEPS: dict[str, tuple[str, str, str]] = {
    "infer_descendants_is_a": (DOWN, "below", DOWN),
    "infer_ancestors_is_a": (UP, "above", UP),
    "infer_descendants_inner_1": (DOWN, "and", DOWN),
    "infer_descendants_inner_2": (DOWN, "or", DOWN),
    "infer_ancestors_inner_1": (UP, "and", UP),
    "infer_ancestors_inner_2": (UP, "or", UP),
    "infer_descendants_some": (DOWN, "some", DOWN),
    "infer_ancestors_some": (UP, "some", UP),
    "infer_descendants_only": (UP, "only", DOWN),
    "infer_ancestors_only": (DOWN, "only", UP),
}


def relations(told: DataFrame, members: DataFrame, some: DataFrame, only: DataFrame) -> dict[str, DataFrame]:
    """The edges (s, o) that marks go along, by name; told has s below o."""
    kind = lambda k: members.filter(F.col("kind") == k).select("s", "o")
    value = lambda df: df.select("s", F.col("value").alias("o"))
    turned = told.select(F.col("o").alias("s"), F.col("s").alias("o"))
    edges = {"below": turned, "above": told.select("s", "o"), "and": kind("and"), "or": kind("or"), "some": value(some), "only": value(only)}
    return {k: df.selectExpr("cast(s as bigint) s", "cast(o as bigint) o") for k, df in edges.items()}


def named(types: DataFrame, mark: str) -> DataFrame:
    """mark, s: named classes and individuals, marked."""
    return types.filter("s > 0 and kind in ('Class', 'NamedIndividual')").select(F.lit(mark).alias("mark"), F.col("s").cast("bigint").alias("s")).distinct()


def marks(types: DataFrame, told: DataFrame, members: DataFrame, some: DataFrame, only: DataFrame) -> DataFrame:
    """mark, s: every marked node. A node may have both marks; an empty table of types marks nothing."""
    along = relations(told, members, some, only)
    state = lambda mark, column: F.struct(F.col(mark).alias("mark"), F.col(column).alias("s"))
    edges = reduce(DataFrame.union, [along[r].select(F.lit(a).alias("a"), "s", F.lit(b).alias("b"), "o") for a, r, b in STEPS.values()])
    start = named(types, DOWN)
    # Named entities have both marks from the start, so only what isn't one is looked for: what they lead to first, then along edges between such nodes.
    ends = reduce(DataFrame.union, [df.select("s").union(df.select("o")) for r, df in along.items() if r != "below"]).distinct()
    open_ = settle(ends.join(start.select("s"), "s", "left_anti"))
    into = edges.join(open_.select(F.col("s").alias("o")), "o", "left_semi")
    first = into.join(open_, "s", "left_anti").select(state("b", "o").alias("s"))
    inner = settle(into.join(open_, "s", "left_semi").select(state("a", "s").alias("s"), state("b", "o").alias("o")).distinct())
    found = reachable(first, inner).select("s.mark", "s.s")
    return start.union(start.select(F.lit(UP).alias("mark"), "s")).union(found)


def step(rule: str, marked: DataFrame, along: dict[str, DataFrame]) -> DataFrame:
    """mark, s: what one rule marks, given all marks."""
    before, relation, after = STEPS[rule]
    return marked.filter(F.col("mark") == before).join(along[relation], "s").select(F.lit(after).alias("mark"), F.col("o").alias("s")).distinct()
