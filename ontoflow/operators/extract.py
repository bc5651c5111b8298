"""Results of a run: new parents, new equivalences, kinds of entities; explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoflow.plans.storage import settle
from ontoflow.schema import BOTTOM, TOP


def equivalents(sub: DataFrame) -> DataFrame:
    """s, o: different concepts below each other."""
    other = sub.select(F.col("o").alias("s"), F.col("s").alias("o"))
    return sub.select("s", "o").filter("s <> o").join(other, ["s", "o"], "left_semi").distinct()


def new_parents(sub: DataFrame, told: DataFrame) -> DataFrame:
    """s, o: named parents that are neither told, nor follow from a told edge and one more, nor are equivalents, nor trivial.

    Only parents above zero count, and only what something is below can be the middle of two edges: the large part of sub is joined once, with what is told.
    """
    up, t = sub.select("s", "o").filter("s <> o and o > 0"), told.select("s", "o")
    open_ = settle(up.filter(f"s > 0 and s <> {BOTTOM} and o <> {TOP}").distinct().join(t.filter("s > 0 and o > 0"), ["s", "o"], "left_anti"))
    middle = settle(t.select(F.col("o").alias("s")).union(open_.select(F.col("o").alias("s"))).distinct())
    inner = settle(up.join(middle, "s", "left_semi").distinct())
    step = t.filter("s > 0").join(inner.select(F.col("s").alias("o"), F.col("o").alias("z")), "o").select("s", F.col("z").alias("o"))
    return open_.join(step, ["s", "o"], "left_anti").join(inner.select(F.col("o").alias("s"), F.col("s").alias("o")), ["s", "o"], "left_anti")


def entity_kinds(types: DataFrame) -> DataFrame:
    """s, kind: one kind for each entity; an individual is an individual, then properties, then classes."""
    rank = F.when(F.col("kind") == "NamedIndividual", 0).when(F.col("kind") == "ObjectProperty", 1).when(F.col("kind") == "DatatypeProperty", 2).when(F.col("kind") == "Class", 3).otherwise(4)
    return types.groupBy("s").agg(F.min(F.struct(rank.alias("r"), "kind")).alias("k")).select("s", F.col("k.kind").alias("kind"))


def explain_transitive(told: DataFrame, sub: DataFrame) -> DataFrame:
    """s, o, rule, sources: each derived edge with the pairs of edges it follows from by transitivity, each told edge as an assertion."""
    told = told.select("s", "o").distinct()
    a, b = told.alias("a"), sub.filter("s <> o").alias("b")
    via = a.join(b, F.col("a.o") == F.col("b.s")).filter("a.s <> a.o").select(F.col("a.s").alias("s"), F.col("b.o").alias("o"), F.array(F.struct(F.col("a.s").alias("s"), F.col("a.o").alias("o")), F.struct(F.col("b.s").alias("s"), F.col("b.o").alias("o"))).alias("sources"))
    derived = via.join(told, ["s", "o"], "left_anti").select("s", "o", F.lit("is_a_transitivity").alias("rule"), "sources")
    none = F.array().cast("array<struct<s:bigint,o:bigint>>")
    return derived.union(told.select("s", "o", F.lit("assertion").alias("rule"), none.alias("sources")))


def render(kb_some: DataFrame, kb_only: DataFrame, members: DataFrame, entity: DataFrame, rounds: int = 4) -> DataFrame:
    """id, text of named entities and of constructs nested up to ``rounds`` deep, like (p some (A and B)); deeper or cyclic parts are (...)."""
    name = entity.select("id", F.col("name").alias("text"))
    text = name
    for _ in range(rounds):
        t = text.select(F.col("id").alias("value"), F.col("text").alias("vt"))
        p = name.select(F.col("id").alias("prop"), F.col("text").alias("pt"))
        out = [name]
        for kind, df in (("some", kb_some), ("only", kb_only)):
            out.append(df.join(p, "prop", "left").join(t, "value", "left").select(F.col("s").alias("id"), F.concat(F.lit("("), F.coalesce("pt", F.col("prop").cast("string")), F.lit(f" {kind} "), F.coalesce("vt", F.lit("(...)")), F.lit(")")).alias("text")))
        m = members.join(t.select(F.col("value").alias("o"), "vt"), "o", "left").groupBy("kind", "s").agg(F.array_sort(F.collect_list(F.coalesce("vt", F.lit("(...)")))).alias("parts"))
        joined = F.when(F.col("kind") == "not", F.concat(F.lit("(not "), F.col("parts")[0], F.lit(")"))).otherwise(F.concat(F.lit("("), F.array_join(F.col("parts"), "\x00"), F.lit(")")))
        out.append(m.filter("kind in ('and', 'or', 'not')").select(F.col("s").alias("id"), F.replace(joined, F.lit("\x00"), F.concat(F.lit(" "), F.col("kind"), F.lit(" "))).alias("text")))
        text = out[0]
        for d in out[1:]:
            text = text.unionByName(d)
    return text
