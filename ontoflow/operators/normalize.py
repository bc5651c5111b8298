"""Structural operators on constructs: keys, merging of equal definitions, singletons, classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoflow.plans.storage import settle
from ontoflow.schema import KB


def operand_keys(members: DataFrame) -> DataFrame:
    """s, n, key: each list's sorted distinct operands as text, and their number; members has s and o."""
    operands = F.array_sort(F.collect_set("o"))
    return members.groupBy("s").agg(operands.alias("os")).select("s", F.size("os").cast("long").alias("n"), F.array_join("os", ",").alias("key"))


def merge_structural(triples: DataFrame, max_rounds: int = 50) -> DataFrame:
    """s, rep: nodes of triples (s, p, o) below zero whose definitions are equal, up to equal operands, with the greatest of them.

    A node is keyed once, when all its operands are: equal definitions have equal operands, so they are ready in the same round. What rests on itself
    is compared round by round, as merged operands make more nodes equal. Named nodes are never merged.
    """
    rest = triples.filter("s < 0").select("s", "p", "o", F.expr("o >= 0").alias("known"))
    done = []
    for _ in range(max_rounds):
        nodes = settle(rest.groupBy("s").agg(F.array_sort(F.collect_set(F.struct("p", "o", "known"))).alias("definition")))
        ready, rest = nodes.filter("forall(definition, x -> x.known)"), nodes.filter("exists(definition, x -> not x.known)").select("s", F.inline("definition"))
        to = settle(_merged(ready.select("s", F.expr("array_join(transform(definition, x -> concat(x.p, ':', x.o)), ',')").alias("definition"))))
        done.append(to)
        if rest.isEmpty():
            return reduce(DataFrame.union, done)
        if to.isEmpty():
            # An operand without a definition stands for itself; if there is none, all that is left rests on itself.
            leaf = rest.filter("not known").select(F.col("o").alias("s")).distinct().join(rest.select("s").distinct(), "s", "left_anti")
            to = settle(leaf.select("s", F.col("s").alias("rep")))
            if to.isEmpty():
                return reduce(DataFrame.union, [*done, _merge_cyclic(rest.select("s", "p", "o"), max_rounds)])
        met = rest.filter("not known").join(to.select(F.col("s").alias("o"), "rep"), "o", "left")
        rest = rest.filter("known").union(met.select("s", "p", F.coalesce("rep", "o").alias("o"), F.col("rep").isNotNull().alias("known")))
    raise RuntimeError(f"not merged in {max_rounds} rounds")


def _merged(keys: DataFrame) -> DataFrame:
    """s, rep: nodes with the greatest one of the same definition."""
    return keys.join(keys.groupBy("definition").agg(F.max("s").alias("rep")), "definition").select("s", "rep")


def _merge_cyclic(triples: DataFrame, max_rounds: int) -> DataFrame:
    """merge_structural of nodes of which each rests on one that rests on itself: all are keyed in every round."""
    triples = settle(triples)
    mapping = settle(triples.select("s", F.col("s").alias("rep")).distinct())
    for _ in range(max_rounds):
        to = mapping.select(F.col("s").alias("o"), F.col("rep").alias("new"))
        now = triples.join(to, "o", "left").select("s", "p", F.coalesce("new", "o").alias("o"))
        new = settle(_merged(now.groupBy("s").agg(F.array_sort(F.collect_set(F.struct("p", "o"))).alias("definition"))))
        if new.join(mapping, ["s", "rep"], "left_anti").isEmpty():
            return new
        mapping = new
    raise RuntimeError(f"not merged in {max_rounds} rounds")


def below_all(sub: DataFrame, members: DataFrame) -> DataFrame:
    """s, n: what is below all operands of an intersection n; sub (s, o), members (n, o).

    A list is looked up by the operand that fewest lists have, and the others among what s is below, so that no row is made for a list that s is below only in part.
    """
    members = settle(members.select("n", "o").distinct())
    often = members.groupBy("o").agg(F.count("*").alias("lists"))
    lists = members.join(often, "o").groupBy("n").agg(F.min(F.struct("lists", "o"))["o"].alias("first"), F.collect_list("o").alias("all"))
    have = sub.select("s", "o").join(settle(members.select("o").distinct()), "o", "left_semi").groupBy("s").agg(F.collect_set("o").alias("os"))
    met = have.select("s", "os", F.explode("os").alias("first")).join(settle(lists), "first")
    return met.filter(F.size(F.array_except("all", "os")) == 0).select("s", "n")


def pair_equivalents(equivalent: DataFrame) -> DataFrame:
    """s, rep: anonymous concepts that a named equivalent replaces. Of several names of a concept the least counts, and a name replaces
    only the least of the concepts that it is for, so that no name gets two definitions; equivalent (s, o) may go either way."""
    both = equivalent.select("s", "o").union(equivalent.select(F.col("o").alias("s"), F.col("s").alias("o")))
    named = both.filter("s > 0 and o < 0").groupBy("o").agg(F.min("s").alias("rep"))
    return named.groupBy("rep").agg(F.min("o").alias("s")).select("s", "rep")


def merge_equivalents(kb: KB) -> KB:
    """The knowledge base with each named concept in the place of the anonymous one that defines it; the latter's own edges and types go."""
    pairs = settle(pair_equivalents(kb.equivalent))
    gone = pairs.select("s")

    def put(df: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            to = pairs.select(F.col("s").alias("_from"), F.col("rep").alias("_to"))
            df = df.join(to, F.col(c) == F.col("_from"), "left").withColumn(c, F.coalesce("_to", c)).drop("_from", "_to")
        return df.distinct()

    return kb.with_(
        is_a=put(kb.is_a.join(gone, "s", "left_anti").select("s", "o"), "o").filter("s <> o"),
        types=kb.types.join(gone, "s", "left_anti").select("s", "kind"),
        equivalent=put(kb.equivalent, "s", "o").filter("s <> o"),
        some=put(kb.some, "s", "value"),
        only=put(kb.only, "s", "value"),
        list_member=put(kb.list_member, "s", "o"),
    )


def rewrite(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """edges (s, o) with ids replaced by mapping (s, rep), distinct."""
    m = mapping.select(F.col("s").alias("_from"), F.col("rep").alias("_to"))
    out = edges.join(m, F.col("s") == F.col("_from"), "left").select(F.coalesce("_to", "s").alias("s"), "o")
    out = out.join(m, F.col("o") == F.col("_from"), "left").select("s", F.coalesce("_to", "o").alias("o"))
    return out.distinct()


def singleton_lists(members: DataFrame) -> DataFrame:
    """s, rep: lists of a single operand, and that operand."""
    return members.groupBy("s").agg(F.min("o").alias("rep"), F.count_distinct("o").alias("n")).filter("n = 1").select("s", "rep")


def simplify_lists(members: DataFrame, is_a: DataFrame, kind: str, top: int = 1, bottom: int = 2) -> DataFrame:
    """s, o: the operands that matter. and: without top and without what is above another operand; bottom swallows the rest.
    or: without bottom and without what is below another operand; top swallows the rest. An empty list is top (and) or bottom (or)."""
    neutral, swallow = (top, bottom) if kind == "and" else (bottom, top)
    members = members.select("s", "o").distinct()
    all_ = members.filter(F.col("o") == swallow).select("s").distinct()
    rest = members.join(all_, "s", "left_anti").filter(F.col("o") != neutral)
    other = members.select("s", F.col("o").alias("p"))
    edges = is_a.select(F.col("s").alias("lower"), F.col("o").alias("upper")).filter("lower <> upper").distinct()
    names = {"lower": "p", "upper": "o"} if kind == "and" else {"lower": "o", "upper": "p"}
    idle = rest.join(other, "s").join(edges.select(F.col("lower").alias(names["lower"]), F.col("upper").alias(names["upper"])), ["p", "o"], "left_semi").select("s", "o").distinct()
    rest = rest.join(idle, ["s", "o"], "left_anti")
    empty = members.select("s").distinct().join(all_, "s", "left_anti").join(members.filter(F.col("o") != neutral).select("s").distinct(), "s", "left_anti")
    return rest.union(all_.select("s", F.lit(swallow).cast("bigint").alias("o"))).union(empty.select("s", F.lit(neutral).cast("bigint").alias("o")))


def classify_restrictions(triples: DataFrame, predicates: dict[str, int]) -> DataFrame:
    """s, kind, prop, card, value of restriction nodes from their triples (s, p, o); predicates gives the id of onProperty, someValuesFrom, ..."""
    one = lambda name: F.max(F.when(F.col("p") == predicates[name], F.col("o")))
    kinds = {"some": "someValuesFrom", "only": "allValuesFrom", "value": "hasValue", "min": "minQualifiedCardinality", "max": "maxQualifiedCardinality", "exactly": "qualifiedCardinality"}
    found = {k: v for k, v in kinds.items() if v in predicates}
    rows = triples.groupBy("s").agg(one("onProperty").alias("prop"), *[one(v).alias(f"_{k}") for k, v in found.items()], (one("onClass") if "onClass" in predicates else F.lit(None).cast("bigint")).alias("_class"))
    kind = F.coalesce(*[F.when(F.col(f"_{k}").isNotNull(), k) for k in found])
    numbers = [F.col(f"_{k}") for k in ("min", "max", "exactly") if k in found]
    values = [F.col(f"_{k}") for k in ("some", "only", "value") if k in found]
    # hasValue on an object property is an existential over the individual.
    return rows.filter(F.col("prop").isNotNull() & kind.isNotNull()).select("s", F.when(kind == "value", "some").otherwise(kind).alias("kind"), "prop", (F.coalesce(*numbers) if numbers else F.lit(None).cast("bigint")).alias("card"), F.coalesce(*values, F.col("_class")).alias("value"))
