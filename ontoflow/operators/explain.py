"""Explanations: what a conclusion rests on, from the derivations (rel, s, p, o, rule, sources) of a run with explain.

Derivations are an and-or graph: a fact may have several, and each needs all of its sources. What helps to derive a fact that is asked for
is found by walking from conclusions to sources.
"""

from __future__ import annotations

import html as _html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoflow.operators.closure import reachable
from ontoflow.schema import BOTTOM, TOP

FACT = ["rel", "s", "p", "o"]


def fact_text(rel: Column, s: Column, p: Column, o: Column) -> Column:
    """A fact as text, like sub:5:0:7; the key that the graph's joins use."""
    return F.concat_ws(":", rel, s.cast("string"), p.cast("string"), o.cast("string"))


def sources_text(sources: Column) -> Column:
    return F.array_join(F.transform(sources, lambda x: fact_text(x["rel"], x["s"], x["p"], x["o"])), ";")


def arrows(derivations: DataFrame) -> DataFrame:
    """fact, rule, way, source: a row for each source of each derivation (texts); way tells the derivations of a fact apart, told facts have no row."""
    keyed = derivations.select(fact_text(*map(F.col, FACT)).alias("fact"), "rule", sources_text(F.col("sources")).alias("way"), F.explode("sources").alias("x"))
    return keyed.select("fact", "rule", "way", fact_text(F.col("x.rel"), F.col("x.s"), F.col("x.p"), F.col("x.o")).alias("source")).distinct()


def graph(derivations: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """rel, s, p, o, told, trivial, useful, ways: every fact that has a derivation or is a source of one.

    useful: some seed (rel, s, p, o) rests on the fact. Without seeds these are the subsumptions under a named concept other than top and the fact's own.
    trivial: a reflexive subsumption, or one under top. ways: in how many ways it was derived, told ones not counted. What follows from an inconsistent bottom is left out.
    """
    sound = derivations.filter(f"rel <> 'sub' or s <> {BOTTOM}")
    own = sound.select(*FACT, (F.col("rule") == "assertion").alias("told"), F.when(F.col("rule") != "assertion", F.concat_ws("|", "rule", sources_text(F.col("sources")))).alias("way"))
    used = sound.select(F.explode("sources").alias("x")).select("x.*", F.lit(False).alias("told"), F.lit(None).cast("string").alias("way"))
    facts = own.unionByName(used).groupBy(*FACT).agg(F.max("told").alias("told"), F.count_distinct("way").alias("ways"))
    if seeds is None:
        seeds = facts.filter(f"rel = 'sub' and o > 0 and o <> s and o <> {TOP}")
    edges = arrows(sound).select(F.col("fact").alias("s"), F.col("source").alias("o")).distinct()
    useful = reachable(seeds.select(fact_text(*map(F.col, FACT)).alias("s")), edges).select(F.col("s").alias("key"), F.lit(True).alias("useful"))
    trivial = (F.col("rel") == "sub") & ((F.col("s") == F.col("o")) | (F.col("o") == TOP))
    found = facts.withColumn("key", fact_text(*map(F.col, FACT))).join(useful, "key", "left")
    return found.select(*FACT, "told", trivial.alias("trivial"), F.coalesce("useful", F.lit(False)).alias("useful"), "ways")


def to_html(derivations: DataFrame, seeds: DataFrame, names: DataFrame, most: int = 5000) -> str:
    """A page that lists what the seeds rest on, each fact with its derivations. names: id, text. More than ``most`` derivations are an error, as no one reads them."""
    useful = graph(derivations, seeds).filter("useful")
    rows = derivations.join(useful.select(*FACT, "told"), FACT).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} derivations; ask about fewer conclusions")
    ids = sorted({x for r in rows for x in (r["s"], r["p"], r["o"], *(y for z in r["sources"] for y in (z["s"], z["p"], z["o"])))})
    wanted = derivations.sparkSession.createDataFrame([(i,) for i in ids], "id bigint")
    name = {r["id"]: r["text"] for r in names.join(wanted, "id", "left_semi").collect()}  # as many as most allows
    word = {"sub": "is a", "concrete": "has members"}

    def line(x) -> str:
        who = lambda i: _html.escape(name.get(i, f"#{i}"))
        if x["rel"] in ("some", "only"):
            return f"{who(x['s'])} = {who(x['p'])} <b>{x['rel']}</b> {who(x['o'])}"
        return f"{who(x['s'])} <b>{word.get(x['rel'], x['rel'])}</b> {who(x['o']) if x['o'] else ''}".strip()

    key = lambda x: tuple(x[c] for c in FACT)
    at = {f: n for n, f in enumerate(sorted({key(r) for r in rows}), 1)}
    out = ["<!DOCTYPE html><meta charset='utf-8'><title>Explanation</title><ol>"]
    for f, n in at.items():
        mine = [r for r in rows if key(r) == f]
        out.append(f"<li id='f{n}'>{line(mine[0])}<ul>")
        for r in sorted(mine, key=lambda r: (r["rule"], str(r["sources"]))):
            links = [f"<a href='#f{at[key(x)]}'>{line(x)}</a>" if key(x) in at else line(x) for x in r["sources"]]
            out.append(f"<li>{_html.escape(r['rule'])}{': ' + ', '.join(links) if links else ''}</li>")
        out.append("</ul></li>")
    return "\n".join([*out, "</ol>"])
