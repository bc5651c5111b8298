"""Registered queries of the reasoning engine over the driver's tables, each with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ontoflow import rule_queries
from ontoflow.functions.terms import construct_id, list_text, restriction_text
from ontoflow.operators import explain, extract, normalize
from ontoflow.operators import marks as mark
from ontoflow.operators.closure import leveled_closure, reachable, restriction_depth, transitive_closure
from ontoflow.plans import joint
from ontoflow.plans.commerce import relation, rule_query, sql
from ontoflow.plans.reasoner import Reasoner
from ontoflow.plans.rules import RULES
from ontoflow.schema import KB

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {name: rule_query(name) for name in sorted(RULES)}
ORACLE: dict[str, str] = {name: sql(RULES[name]) for name in sorted(RULES)}
QUERIES |= joint.QUERIES
# What they join on both sides is a value, an operand or what something is below.
QUERIES |= {name: rule_query(name, re.sub(r"\bsub\b", "class_sub", RULES[name])) for name in ("r31_is_a_transitivity_2", "r67_some_only_inverse_or_1", "r70_some_func_or")}
QUERIES |= rule_queries.QUERIES
ORACLE |= rule_queries.ORACLE


#: The rules on marks: number, name, and what SQL joins the marks with.
_MARK_SQL = {
    "below": "SELECT o AS s, s AS o FROM told", "above": "SELECT s, o FROM told", "and": "SELECT s, o FROM list_member WHERE kind = 'and'",
    "or": "SELECT s, o FROM list_member WHERE kind = 'or'", "some": "SELECT s, value AS o FROM some_", "only": "SELECT s, value AS o FROM only_",
}


def _mark_rules() -> None:
    """Queries r12 to r23: what each rule on marks gives, from the operator's marks; their SQL is a recursion of its own."""

    def along(spark, d):
        return mark.relations(*(relation(spark, d, f"SELECT * FROM {r}") for r in ("told", "list_member", "some_", "only_")))

    for k, (name, one) in enumerate((("infer_descendants_entity", mark.DOWN), ("infer_ancestors_entity", mark.UP)), 12):
        QUERIES[f"r{k}_{name}"] = lambda spark, d, one=one: mark.named(relation(spark, d, "SELECT * FROM types"), one)
        ORACLE[f"r{k}_{name}"] = sql(f"SELECT DISTINCT '{one}' AS mark, s FROM types WHERE kind IN ('Class', 'NamedIndividual') AND s > 0")
    for k, (rule, (before, edges, after)) in enumerate(mark.STEPS.items(), 14):
        QUERIES[f"r{k}_{rule}"] = lambda spark, d, rule=rule: mark.step(rule, relation(spark, d, "SELECT * FROM marks"), along(spark, d))
        ORACLE[f"r{k}_{rule}"] = sql(f"SELECT DISTINCT '{after}' AS mark, e.o AS s FROM marks m JOIN ({_MARK_SQL[edges]}) e ON e.s = m.s WHERE m.mark = '{before}'")


_mark_rules()

#: Nations, customers and suppliers below regions: a small hierarchy of named concepts.
HIERARCHY = """SELECT CAST(2000 + n_nationkey AS BIGINT) AS s, CAST(1000 + n_regionkey AS BIGINT) AS o FROM nation
  UNION ALL SELECT 1000000000 + c_custkey, CAST(2000 + c_nationkey AS BIGINT) FROM customer UNION ALL SELECT 2000000000 + s_suppkey, CAST(2000 + s_nationkey AS BIGINT) FROM supplier"""
_MD5 = "-(('0x' || substr(md5({0}), 1, 15))::BIGINT)"
_CHAIN = "SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS s, CAST(l_orderkey * 10 + l_linenumber + 1 AS BIGINT) AS o FROM lineitem WHERE l_linenumber < 7"


def q(name: str, oracle: str | None = None, kb: bool = True):
    """Register a query; its oracle runs over the knowledge base's relations unless kb is false."""

    def enter(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = sql(oracle) if kb else oracle
        return f

    return enter


def _all(name: str) -> str:
    return f"SELECT * FROM {name}"


#: Every intersection has two operands, so its pairs come straight from the tables.
_AND_PAIRS = """WITH l AS (SELECT -(1000000 + s.id * 10 + r_regionkey) AS s, s.id AS x, 1000 + r_regionkey AS y FROM seg s CROSS JOIN region
  UNION SELECT -(2000000 + (t - 4000) * 1000 + (b - 5000)), t, b FROM item) """
ORACLE["r24_and_linked_list"] = sql(_AND_PAIRS + "SELECT s, least(x, y) AS o1, greatest(x, y) AS o2 FROM l")


@q("r09_prop_is_a_transitivity", "WITH r AS (SELECT s, o FROM prop_told UNION SELECT r.s, p.o FROM r JOIN prop_told p ON p.s = r.o) SELECT CAST(s AS BIGINT) AS s, CAST(o AS BIGINT) AS o FROM r")
def property_closure(spark, d):
    """Properties of brands and types below all that they are below."""
    return transitive_closure(relation(spark, d, "SELECT CAST(s AS BIGINT) AS s, CAST(o AS BIGINT) AS o FROM prop_told"))


ORACLE["r09_prop_is_a_transitivity"] = ORACLE["r09_prop_is_a_transitivity"].replace("WITH", "WITH RECURSIVE", 1)


@q("o01_triple_scan", "SELECT s, value AS o FROM some_ WHERE prop = 13")
def triple_scan(spark, d):
    return relation(spark, d, _all("some_")).filter("prop = 13").select("s", F.col("value").alias("o"))


@q("o02_construct_scan", "SELECT s, prop, value FROM some_ WHERE s < 0 AND prop IN (11, 12) UNION ALL SELECT s, prop, value FROM only_ WHERE s < 0 AND prop IN (11, 12)")
def construct_scan(spark, d):
    both = relation(spark, d, _all("some_")).union(relation(spark, d, _all("only_")))
    return both.filter((F.col("s") < 0) & F.col("prop").isin(11, 12)).select("s", "prop", "value")


@q("o03_type_import", "SELECT DISTINCT s, kind FROM types WHERE kind IN ('Class', 'NamedIndividual', 'ObjectProperty', 'DatatypeProperty', 'FunctionalProperty', 'TransitiveProperty')")
def type_import(spark, d):
    from ontoflow.schema import KINDS

    return relation(spark, d, _all("types")).filter(F.col("kind").isin(*KINDS)).distinct()


@q("o04_instance_import", "SELECT DISTINCT a.s, a.o FROM is_a a JOIN types t ON t.s = a.s WHERE t.kind = 'NamedIndividual'")
def instance_import(spark, d):
    people = relation(spark, d, _all("types")).filter("kind = 'NamedIndividual'")
    return relation(spark, d, _all("is_a")).join(people, "s", "left_semi").distinct()


@q("o05_subclass_import", "SELECT s, o, 1 AS l FROM is_a")
def subclass_import(spark, d):
    return relation(spark, d, _all("is_a")).select("s", "o", F.lit(1).alias("l"))


@q("o06_rdf_list", "SELECT CAST(1000 + n_regionkey AS BIGINT) AS list, CAST(2000 + n_nationkey AS BIGINT) AS member FROM nation", kb=False)
def rdf_list(spark, d):
    """Nations of a region as a first/rest chain, read back by reachability over rest."""
    from ontoflow.sources.triples import list_members

    n = spark.read.parquet(f"{d}/nation.parquet")
    cell = (-F.col("n_nationkey") - 1).cast("bigint")
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    cells = n.select(F.col("n_regionkey").alias("r"), cell.alias("cell"), (F.col("n_nationkey") + 2000).cast("bigint").alias("first"), F.lead(cell).over(w).alias("rest"), F.row_number().over(w).alias("k"))
    heads = cells.filter("k = 1").select((F.col("r") + 1000).cast("bigint").alias("list"), F.col("cell").alias("head"))
    return list_members(heads, cells.select("cell", "first"), cells.filter("rest is not null").select("cell", "rest"))


@q("o21_distinct_projection", "SELECT DISTINCT prop, value FROM some_")
def distinct_projection(spark, d):
    return relation(spark, d, _all("some_")).select("prop", "value").distinct()


@q("o22_constant", "SELECT s FROM types WHERE kind = 'Class'")
def constant(spark, d):
    return relation(spark, d, _all("types")).filter(F.col("kind") == "Class").select("s")


@q("o23_comparison", "SELECT a.s, a.o FROM is_a a WHERE a.s <> a.o AND a.o > 1000 AND a.o <= 5025 AND a.s >= 2000")
def comparison(spark, d):
    return relation(spark, d, _all("is_a")).filter((F.col("s") != F.col("o")) & (F.col("o") > 1000) & (F.col("o") <= 5025) & (F.col("s") >= 2000))


@q("o24_level", "SELECT a.s, b.o, 2 AS l FROM is_a a JOIN is_a b ON a.o = b.s WHERE NOT EXISTS (SELECT 1 FROM is_a c WHERE c.s = a.s AND c.o = b.o) GROUP BY a.s, b.o")
def level(spark, d):
    told = relation(spark, d, _all("is_a"))
    two = told.alias("a").join(told.alias("b"), F.col("a.o") == F.col("b.s")).select("a.s", "b.o", F.lit(2).alias("l"))
    leveled = told.withColumn("l", F.lit(1)).union(two).groupBy("s", "o").agg(F.min("l").alias("l"))
    return leveled.filter("l <= 3 and l <> 1")


@q("o25_named", "SELECT DISTINCT o FROM is_a WHERE o > 0")
def named(spark, d):
    return relation(spark, d, _all("is_a")).filter("o > 0").select("o").distinct()


@q("o26_symmetry", "SELECT least(a.o, b.o) AS o1, greatest(a.o, b.o) AS o2, a.s FROM list_member a JOIN list_member b ON a.s = b.s AND a.o < b.o WHERE a.kind = 'or' AND b.kind = 'or'")
def symmetry(spark, d):
    m = relation(spark, d, _all("list_member")).filter("kind = 'or'").select("s", "o")
    return m.select("s", F.col("o").alias("o1")).join(m.select("s", F.col("o").alias("o2")), "s").filter("o1 < o2").select("o1", "o2", "s")


@q("o27_negation", "SELECT s, o FROM equivalent e WHERE NOT EXISTS (SELECT 1 FROM is_a a WHERE a.o = e.o)")
def negation(spark, d):
    return relation(spark, d, _all("equivalent")).join(relation(spark, d, _all("is_a")).select("o"), "o", "left_anti").select("s", "o")


@q("o29_commutative", _AND_PAIRS + "SELECT s, x, y FROM l UNION ALL SELECT s, y AS x, x AS y FROM l")
def commutative(spark, d):
    m = relation(spark, d, _all("list_member")).filter("kind = 'and'").select("s", "o")
    return m.select("s", F.col("o").alias("x")).join(m.select("s", F.col("o").alias("y")), "s").filter("x <> y")


@q("o31_equi_join", "SELECT a.s, g.prop, g.value FROM is_a a JOIN some_ g ON a.o = g.s")
def equi_join(spark, d):
    return relation(spark, d, _all("is_a")).join(relation(spark, d, _all("some_")).withColumnRenamed("s", "g"), F.col("o") == F.col("g")).select("s", "prop", "value")


@q(
    "o32_self_join",
    """SELECT CAST(1000000000 + c_custkey AS BIGINT) AS s, CAST(1000 + n_regionkey AS BIGINT) AS o FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT CAST(2000000000 + s_suppkey AS BIGINT), CAST(1000 + n_regionkey AS BIGINT) FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    kb=False,
)
def self_join(spark, d):
    a = relation(spark, d, _all("is_a"))
    return a.alias("a").join(a.filter("o between 1000 and 1004").alias("b"), F.col("a.o") == F.col("b.s")).select("a.s", "b.o")


@q(
    "o33_theta_residual",
    """WITH g AS (SELECT s, list_sort(list(o)) AS os FROM is_a GROUP BY s), e AS (SELECT s, os, unnest(range(1, len(os))) AS i FROM g)
SELECT s, os[i] AS o1, unnest(os[i + 1:]) AS o2 FROM e""",
)
def theta(spark, d):
    a = relation(spark, d, _all("is_a"))
    return a.select("s", F.col("o").alias("o1")).join(a.select("s", F.col("o").alias("o2")), "s").filter("o1 < o2")


@q("o35_semi_join", "SELECT s, o FROM is_a WHERE o IN (SELECT s FROM types WHERE kind = 'Class')")
def semi_join(spark, d):
    marks = relation(spark, d, _all("types")).filter("kind = 'Class'").select(F.col("s").alias("o"))
    return relation(spark, d, _all("is_a")).join(marks, "o", "left_semi").select("s", "o")


@q("o36_anti_join", "SELECT s, o FROM is_a EXCEPT SELECT s, o FROM is_a WHERE o < 0")
def anti_join(spark, d):
    a = relation(spark, d, _all("is_a"))
    return a.select("s", "o").subtract(a.filter("o < 0").select("s", "o"))


@q("o39_operand_sets", "SELECT s, count(DISTINCT o) AS n, string_agg(DISTINCT o::VARCHAR, ',' ORDER BY o::VARCHAR) AS key FROM list_member WHERE kind IN ('and', 'or') GROUP BY s")
def operand_sets(spark, d):
    m = relation(spark, d, _all("list_member")).filter("kind in ('and', 'or')").select("s", F.col("o").cast("string").alias("o"))
    return normalize.operand_keys(m)


@q("o40_operand_popularity", "SELECT o, count(*) AS n FROM list_member GROUP BY o")
def popularity(spark, d):
    return relation(spark, d, _all("list_member")).groupBy("o").agg(F.count("*").alias("n"))


@q("o41_max_by_definition", "SELECT prop, value, max(s) AS rep, count(*) AS n FROM only_ GROUP BY prop, value")
def max_by_definition(spark, d):
    return relation(spark, d, _all("only_")).groupBy("prop", "value").agg(F.max("s").alias("rep"), F.count("*").alias("n"))


@q("o42_single_parents", "SELECT s, o FROM is_a WHERE o NOT IN (SELECT o FROM is_a GROUP BY o HAVING count(*) = 1)")
def single_parents(spark, d):
    """Without edges to concepts that have a single child."""
    a = relation(spark, d, _all("is_a"))
    return a.join(a.groupBy("o").count().filter("count = 1").select("o"), "o", "left_anti").select("s", "o")


@q("o45_union_all", "SELECT s, o FROM is_a UNION ALL SELECT s, o FROM equivalent")
def union_all(spark, d):
    return relation(spark, d, _all("is_a")).select("s", "o").unionByName(relation(spark, d, _all("equivalent")).selectExpr("cast(s as bigint) s", "cast(o as bigint) o"))


@q("o49_insert_ignore", "SELECT s, o FROM is_a UNION SELECT o, s FROM equivalent")
def insert_ignore(spark, d):
    """Set insert: only rows that aren't there yet."""
    have = relation(spark, d, _all("is_a")).select("s", "o")
    new = relation(spark, d, _all("equivalent")).selectExpr("cast(o as bigint) s", "cast(s as bigint) o").distinct().join(have, ["s", "o"], "left_anti")
    return have.union(new)


@q("o50_id_rewrite", "SELECT DISTINCT coalesce(e.s, a.s) AS s, coalesce(f.s, a.o) AS o FROM is_a a LEFT JOIN equivalent e ON e.o = a.s LEFT JOIN equivalent f ON f.o = a.o")
def id_rewrite(spark, d):
    mapping = relation(spark, d, _all("equivalent")).selectExpr("cast(o as bigint) s", "cast(s as bigint) rep")
    return normalize.rewrite(relation(spark, d, _all("is_a")), mapping)


@q("o51_ordered_operands", "SELECT s, min(o) AS first, max(o) AS last FROM list_member GROUP BY s")
def ordered(spark, d):
    sorted_ = relation(spark, d, _all("list_member")).groupBy("s").agg(F.array_sort(F.collect_list("o")).alias("os"))
    return sorted_.select("s", F.element_at("os", 1).alias("first"), F.element_at("os", -1).alias("last"))


@q("o54_semi_naive_step", "SELECT DISTINCT a.s, b.o FROM is_a a JOIN is_a b ON a.o = b.s WHERE NOT EXISTS (SELECT 1 FROM is_a c WHERE c.s = a.s AND c.o = b.o)")
def semi_naive(spark, d):
    a = relation(spark, d, _all("is_a")).select("s", "o")
    step = a.alias("a").join(a.alias("b"), F.col("a.o") == F.col("b.s")).select("a.s", "b.o").distinct()
    return step.join(a, ["s", "o"], "left_anti")


@q("o58_transitive_closure", f"WITH RECURSIVE e AS ({HIERARCHY} UNION ALL {_CHAIN}), r AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s) SELECT s, o FROM r", kb=False)
def closure(spark, d):
    for t in ("nation", "customer", "supplier", "lineitem"):
        spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(t)
    return transitive_closure(spark.sql(f"{HIERARCHY} UNION ALL {_CHAIN}"))


_LEVELS = f"""SELECT s, o, 1 AS l FROM ({HIERARCHY}) h UNION ALL SELECT o, o, 3 FROM ({HIERARCHY}) h
  UNION ALL SELECT CAST(1000 + r_regionkey AS BIGINT), CAST(500 + r_regionkey % 2 AS BIGINT), 4 FROM region UNION ALL SELECT CAST(500 + r_regionkey % 2 AS BIGINT), 600, 1 FROM region UNION ALL SELECT 600, 1000, 4"""


@q(
    "o58_levels",
    f"""WITH RECURSIVE e AS ({_LEVELS}), r AS (SELECT s, o, l FROM e UNION
  SELECT r.s, e.o, CASE e.l WHEN 1 THEN 2 ELSE 5 END FROM r JOIN e ON e.s = r.o WHERE (r.l <= 2 AND e.l = 1) OR (r.l <> 3 AND e.l = 4))
SELECT s, o, min(l)::INT AS l FROM r GROUP BY s, o""",
    kb=False,
)
def levels(spark, d):
    """Told edges, reflexive ones, and regions below unions, with a cycle through one of them."""
    for t in ("region", "nation", "customer", "supplier"):
        spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(t)
    return leveled_closure(spark.sql(_LEVELS))


@q("o57_reachability", f"WITH RECURSIVE e AS ({HIERARCHY}), r AS (SELECT CAST(1000 AS BIGINT) AS s UNION SELECT e.s FROM r JOIN e ON e.o = r.s) SELECT s FROM r", kb=False)
def reach(spark, d):
    for t in ("nation", "customer", "supplier"):
        spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(t)
    down = spark.sql(HIERARCHY).select(F.col("o").alias("s"), F.col("s").alias("o"))
    return reachable(spark.createDataFrame([(1000,)], "s bigint"), down)


_DEPTH = """WITH steps AS (SELECT s, value AS o FROM some_ UNION SELECT s, value FROM only_ UNION SELECT s, o FROM list_member WHERE kind IN ('and', 'or')),
  walk AS (SELECT s, s AS o FROM some_ UNION SELECT s, s FROM only_ UNION SELECT w.s, t.o FROM walk w JOIN steps t ON t.s = w.o)
  SELECT s, count(*) AS depth FROM walk WHERE o IN (SELECT s FROM some_ UNION SELECT s FROM only_) GROUP BY s"""


@q("o59_restriction_depth")
def depth(spark, d):
    """Restrictions of all kinds that each restriction reaches through values and operands."""
    some, only = (relation(spark, d, f"SELECT CAST(s AS BIGINT) AS s, CAST(prop AS BIGINT) AS prop, CAST(value AS BIGINT) AS value FROM {r}") for r in ("some_", "only_"))
    operands = relation(spark, d, "SELECT CAST(s AS BIGINT) AS s, CAST(o AS BIGINT) AS o FROM list_member WHERE kind IN ('and', 'or')")
    return restriction_depth(some, only, some.select("s").union(only.select("s")).distinct(), operands)


ORACLE["o59_restriction_depth"] = sql(_DEPTH).replace("WITH", "WITH RECURSIVE", 1)


@q("o61_create_restriction", f"SELECT DISTINCT {_MD5.format(chr(39) + 'some|11|' + chr(39) + ' || o')} AS s, 11 AS prop, o AS value FROM list_member WHERE kind = 'or' AND o > 0")
def create_restriction(spark, d):
    m = relation(spark, d, _all("list_member")).filter("kind = 'or' and o > 0").select("o").distinct()
    return m.select(construct_id(restriction_text("some", F.lit(11), F.col("o"))).alias("s"), F.lit(11).alias("prop"), F.col("o").alias("value"))


@q("o62_create_list", f"SELECT {_MD5.format(chr(39) + 'or|' + chr(39) + ' || k')} AS s, k AS operands FROM (SELECT s AS u, string_agg(o::VARCHAR, ',' ORDER BY o) AS k FROM (SELECT DISTINCT s, o FROM list_member WHERE kind = 'or') t GROUP BY s) z")
def create_list(spark, d):
    m = relation(spark, d, _all("list_member")).filter("kind = 'or'").groupBy("s").agg(F.collect_set("o").alias("os"))
    return m.select(construct_id(list_text("or", F.col("os"))).alias("s"), F.array_join(F.array_sort("os"), ",").alias("operands"))


@q("o63_simplify_union", "SELECT s, o FROM list_member m WHERE kind = 'or' AND NOT EXISTS (SELECT 1 FROM list_member k JOIN is_a a ON a.o = k.o WHERE k.kind = 'or' AND k.s = m.s AND a.s = m.o AND a.s <> a.o) AND o <> 2")
def simplify(spark, d):
    m = relation(spark, d, _all("list_member")).filter("kind = 'or'").selectExpr("cast(s as bigint) s", "cast(o as bigint) o")
    return normalize.simplify_lists(m, relation(spark, d, _all("is_a")), "or")


@q("o65_clause_rest", "SELECT m.s, m.o AS x, r.o AS rest FROM list_member m JOIN list_member r ON r.s = m.s AND r.kind = m.kind AND r.o <> m.o WHERE m.kind = 'or'")
def clause_rest(spark, d):
    lists = relation(spark, d, _all("list_member")).filter("kind = 'or'").groupBy("s").agg(F.collect_set("o").alias("os"))
    each = lists.select("s", F.explode("os").alias("x"), "os")
    return each.select("s", "x", F.explode(F.array_remove("os", F.col("x"))).alias("rest"))


@q("o66_clause_pattern", "SELECT g.s, m.s AS u, m.o AS value FROM some_ g JOIN list_member m ON m.s = g.value AND m.kind = 'or'")
def clause_pattern(spark, d):
    lists = relation(spark, d, _all("list_member")).filter("kind = 'or'").groupBy(F.col("s").alias("u")).agg(F.collect_set("o").alias("os"))
    return relation(spark, d, _all("some_")).join(lists, F.col("value") == F.col("u")).select("s", "u", F.explode("os").alias("value"))


@q("o71_key_list", "SELECT key, min(s) AS node FROM (SELECT s, string_agg(o::VARCHAR, ',' ORDER BY o) AS key FROM (SELECT DISTINCT s, o FROM list_member WHERE kind = 'or') t GROUP BY s) k GROUP BY key")
def key_list(spark, d):
    keys = normalize.operand_keys(relation(spark, d, _all("list_member")).filter("kind = 'or'"))
    return keys.groupBy("key").agg(F.min("s").alias("node"))


@q("o74_structural_merge", "SELECT s, max(s) OVER (PARTITION BY p, o) AS rep FROM (SELECT CAST(-(p_partkey + 10) AS BIGINT) AS s, p_type AS p, p_brand AS o FROM part) t", kb=False)
def structural_merge(spark, d):
    """Part descriptions as anonymous nodes with a type and a brand; equal ones merge."""
    p = spark.read.parquet(f"{d}/part.parquet").select((-(F.col("p_partkey") + 10)).cast("bigint").alias("s"), F.abs(F.xxhash64("p_type")).alias("t"), F.abs(F.xxhash64("p_brand")).alias("b"))
    triples = p.select("s", F.lit(1).cast("bigint").alias("p"), F.col("t").alias("o")).union(p.select("s", F.lit(2).cast("bigint"), F.col("b")))
    return normalize.merge_structural(triples)


@q(
    "o74_nested_merge",
    """WITH a AS (SELECT p_partkey, CAST(max(-(p_partkey + 10)) OVER (PARTITION BY p_type, p_brand) AS BIGINT) AS r FROM part),
l AS (SELECT DISTINCT l_orderkey, l_linenumber, CAST(-(10000000000 + l_orderkey * 10 + l_linenumber) AS BIGINT) AS s, r FROM lineitem JOIN a ON p_partkey = l_partkey),
n AS (SELECT l_orderkey, l_linenumber, s, string_agg(r::VARCHAR, ',' ORDER BY r) AS parts FROM l GROUP BY l_orderkey, l_linenumber, s),
m AS (SELECT l_orderkey, s, max(s) OVER (PARTITION BY l_linenumber, parts) AS rep FROM n),
k AS (SELECT l_orderkey, string_agg(rep::VARCHAR, ',' ORDER BY rep) AS lines FROM (SELECT DISTINCT l_orderkey, rep FROM m) t GROUP BY l_orderkey)
SELECT CAST(-(p_partkey + 10) AS BIGINT) AS s, r AS rep FROM a UNION ALL SELECT s, rep FROM m
UNION ALL SELECT CAST(-(20000000000 + l_orderkey) AS BIGINT), CAST(max(-(20000000000 + l_orderkey)) OVER (PARTITION BY lines) AS BIGINT) FROM k""",
    kb=False,
)
def nested_merge(spark, d):
    """Orders defined by lines, lines by their number and parts, parts by type and brand: equal parts make lines equal, and these orders."""
    part, line = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("part", "lineitem"))
    node = {
        "part": (-(F.col("p_partkey") + 10)).cast("bigint"),
        "of": (-(F.col("l_partkey") + 10)).cast("bigint"),
        "line": (-(F.lit(10000000000) + F.col("l_orderkey") * 10 + F.col("l_linenumber"))).cast("bigint"),
        "order": (-(F.lit(20000000000) + F.col("l_orderkey"))).cast("bigint"),
    }
    known = line.join(part.select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    edge = lambda df, s, p, o: df.select(s.alias("s"), F.lit(p).cast("bigint").alias("p"), o.cast("bigint").alias("o"))
    triples = edge(part, node["part"], 1, F.abs(F.xxhash64("p_type"))).union(edge(part, node["part"], 2, F.abs(F.xxhash64("p_brand"))))
    triples = triples.union(edge(known, node["line"], 3, node["of"])).union(edge(known, node["line"], 4, F.col("l_linenumber"))).union(edge(known, node["order"], 5, node["line"]))
    return normalize.merge_structural(triples)


@q("o76_singletons", "SELECT CAST(-(l_orderkey + 10) AS BIGINT) AS s, CAST(min(l_suppkey) AS BIGINT) AS rep FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 1", kb=False)
def singletons(spark, d):
    lists = spark.read.parquet(f"{d}/lineitem.parquet").select((-(F.col("l_orderkey") + 10)).cast("bigint").alias("s"), F.col("l_suppkey").cast("bigint").alias("o"))
    return normalize.singleton_lists(lists)


@q("o77_classify", "SELECT s, 'some' AS kind, prop, value FROM some_ UNION ALL SELECT s, 'only' AS kind, prop, value FROM only_")
def classify(spark, d):
    ids = {"onProperty": 1, "someValuesFrom": 2, "allValuesFrom": 3}
    some, only = relation(spark, d, _all("some_")), relation(spark, d, _all("only_"))
    rows = some.select("s", F.lit(1).alias("p"), F.col("prop").alias("o")).union(some.select("s", F.lit(2), F.col("value"))).union(only.select("s", F.lit(1), F.col("prop"))).union(only.select("s", F.lit(3), F.col("value")))
    return normalize.classify_restrictions(rows, ids).select("s", "kind", "prop", "value")


@q(
    "o77_six_kinds",
    """SELECT CAST(-(p_partkey + 10) AS BIGINT) AS s, CASE p_partkey % 6 WHEN 0 THEN 'some' WHEN 1 THEN 'only' WHEN 2 THEN 'some' WHEN 3 THEN 'min' WHEN 4 THEN 'max' ELSE 'exactly' END AS kind,
CAST(100 + p_size AS BIGINT) AS prop, CASE WHEN p_partkey % 6 > 2 THEN CAST(p_size % 5 AS BIGINT) ELSE -1 END AS card, CAST(1000 + p_size AS BIGINT) AS value FROM part""",
    kb=False,
)
def six_kinds(spark, d):
    """A restriction for each part, of all six kinds; hasValue is an existential over the individual."""
    names = ["someValuesFrom", "allValuesFrom", "hasValue", "minQualifiedCardinality", "maxQualifiedCardinality", "qualifiedCardinality"]
    ids = {name: k for k, name in enumerate([*names, "onProperty", "onClass"])}
    part = spark.read.parquet(f"{d}/part.parquet").select((-(F.col("p_partkey") + 10)).cast("bigint").alias("s"), (F.col("p_partkey") % 6).alias("k"), F.col("p_size").cast("bigint").alias("z"))
    edge = lambda df, p, o: df.select("s", F.lit(p).alias("p") if isinstance(p, int) else p.cast("int").alias("p"), o.alias("o"))
    triples = edge(part, ids["onProperty"], F.col("z") + 100).union(edge(part, F.col("k"), F.when(F.col("k") > 2, F.col("z") % 5).otherwise(F.col("z") + 1000)))
    found = normalize.classify_restrictions(triples.union(edge(part.filter("k > 2"), ids["onClass"], F.col("z") + 1000)), ids)
    return found.withColumn("card", F.coalesce("card", F.lit(-1).cast("bigint")))


#: Told, two steps on, below intersections, and below the classes that these define.
_DEFINED = f"WITH below AS ({RULES['r33_and_2']}), wide AS (SELECT s, o FROM sub UNION SELECT s, o FROM below UNION SELECT b.s, e.s AS o FROM below b JOIN equivalent e ON e.o = b.o) "


@q(
    "o78_new_parents",
    _DEFINED
    + """SELECT s, o FROM wide WHERE s > 0 AND o > 0 AND s <> o AND s <> 2 AND o <> 1 EXCEPT (SELECT s, o FROM told
  UNION SELECT t.s, w.o FROM told t JOIN wide w ON w.s = t.o AND w.s <> w.o UNION SELECT w.s, w.o FROM wide w JOIN wide v ON v.s = w.o AND v.o = w.s WHERE w.s <> w.o)""",
)
def new_parents(spark, d):
    """Classes defined as intersections that a customer or another concept is found to be below."""
    # An intersection is no named parent itself, so only those that define a class matter.
    lists = relation(spark, d, "SELECT m.s AS n, m.o FROM list_member m LEFT SEMI JOIN equivalent e ON e.o = m.s WHERE kind = 'and'")
    sub, defined = relation(spark, d, "SELECT s, o FROM sub"), relation(spark, d, "SELECT CAST(o AS BIGINT) AS n, CAST(s AS BIGINT) AS o FROM equivalent")
    found = normalize.below_all(sub, lists).join(defined, "n").select("s", "o")
    return extract.new_parents(sub.union(found), relation(spark, d, _all("told")))


@q("o75_merge_equivalents", "SELECT o AS s, s AS rep FROM (SELECT s, min(o) AS o FROM (SELECT o, min(s) AS s FROM (SELECT s, o FROM equivalent UNION ALL SELECT s + 500, o FROM equivalent) t GROUP BY o) u GROUP BY s) v")
def merge_pairs(spark, d):
    """Two names for each definition; the lesser one takes its place."""
    both = relation(spark, d, "SELECT s, o FROM equivalent UNION ALL SELECT s + 500, o FROM equivalent")
    return normalize.pair_equivalents(both)


@q("o78_equivalents", "WITH RECURSIVE e AS (SELECT CAST(s_suppkey AS BIGINT) AS s, CAST(1000000 + s_nationkey AS BIGINT) AS o FROM supplier UNION ALL SELECT CAST(1000000 + s_nationkey AS BIGINT), CAST(min(s_suppkey) AS BIGINT) FROM supplier GROUP BY s_nationkey), r AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s) SELECT a.s, a.o FROM r a JOIN r b ON a.s = b.o AND a.o = b.s WHERE a.s <> a.o", kb=False)
def equivalent_pairs(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("bigint").alias("k"), (F.col("s_nationkey") + 1000000).cast("bigint").alias("n"))
    return extract.equivalents(transitive_closure(s.select(F.col("k").alias("s"), F.col("n").alias("o")).union(s.groupBy("n").agg(F.min("k")))))


@q("o78_entity_kinds", "SELECT s, CASE min(CASE kind WHEN 'NamedIndividual' THEN 0 WHEN 'ObjectProperty' THEN 1 WHEN 'DatatypeProperty' THEN 2 WHEN 'Class' THEN 3 ELSE 4 END) WHEN 0 THEN 'NamedIndividual' WHEN 1 THEN 'ObjectProperty' WHEN 2 THEN 'DatatypeProperty' WHEN 3 THEN 'Class' ELSE 'FunctionalProperty' END AS kind FROM types GROUP BY s")
def kinds(spark, d):
    return extract.entity_kinds(relation(spark, d, _all("types")))


@q("o81_provenance", f"WITH e AS ({HIERARCHY}), r AS (SELECT s, o FROM e UNION SELECT a.s, b.o FROM e a JOIN e b ON a.o = b.s) SELECT r.s, r.o, 'is_a_transitivity' AS rule, e.o AS via FROM e JOIN r ON e.o = r.s WHERE NOT EXISTS (SELECT 1 FROM e z WHERE z.s = e.s AND z.o = r.o)".replace("SELECT r.s, r.o, 'is_a", "SELECT e.s, r.o, 'is_a"), kb=False)
def provenance(spark, d):
    sub = QUERIES["o58_hierarchy"](spark, d)
    found = extract.explain_transitive(spark.sql(HIERARCHY), sub).filter("rule <> 'assertion'")
    return found.select("s", "o", "rule", F.get("sources", F.lit(0))["o"].alias("via"))


@q("o58_hierarchy", f"WITH e AS ({HIERARCHY}) SELECT s, o FROM e UNION SELECT a.s, b.o FROM e a JOIN e b ON a.o = b.s", kb=False)
def hierarchy(spark, d):
    for t in ("nation", "customer", "supplier"):
        spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(t)
    return transitive_closure(spark.sql(HIERARCHY))


@q("o83_render", "SELECT g.s AS id, '(p' || prop || ' some c' || value || ')' AS text FROM some_ g WHERE value > 0")
def rendered(spark, d):
    some = relation(spark, d, "SELECT * FROM some_ WHERE value > 0")
    names = some.select(F.col("value").alias("id"), F.concat(F.lit("c"), "value").alias("name")).union(some.select("prop", F.concat(F.lit("p"), "prop"))).distinct()
    members = relation(spark, d, _all("list_member")).limit(0)
    return extract.render(some, some.limit(0), members, names, 1).filter("id < 0")


@q(
    "o83_render_nested",
    """WITH g AS (SELECT s, 'some' AS k, prop, value FROM some_ UNION ALL SELECT s, 'only', prop, value FROM only_),
flat AS (SELECT s AS id, '(p' || prop || ' ' || k || ' c' || value || ')' AS text FROM g WHERE value > 0),
part AS (SELECT m.kind, m.s, coalesce(f.text, 'c' || m.o) AS text FROM list_member m LEFT JOIN flat f ON f.id = m.o WHERE m.kind IN ('and', 'or', 'not')),
lists AS (SELECT s AS id, '(' || string_agg(text, ' and ' ORDER BY text) || ')' AS text FROM part WHERE kind = 'and' GROUP BY s
  UNION ALL SELECT s, '(' || string_agg(text, ' or ' ORDER BY text) || ')' FROM part WHERE kind = 'or' GROUP BY s UNION ALL SELECT s, '(not ' || text || ')' FROM part WHERE kind = 'not')
SELECT id, text FROM flat UNION ALL SELECT id, text FROM lists UNION ALL SELECT g.s, '(p' || prop || ' ' || k || ' ' || l.text || ')' FROM g JOIN lists l ON l.id = g.value""",
)
def rendered_nested(spark, d):
    """Every construct of the knowledge base: restrictions over unions, unions of restrictions, complements."""
    k = lambda name: relation(spark, d, _all(name))
    some, only, members = k("some_"), k("only_"), k("list_member").filter("kind <> 'inverse'")
    entities = some.union(only).select("value").union(members.select("o")).filter("value > 0").distinct()
    names = entities.select(F.col("value").alias("id"), F.concat(F.lit("c"), "value").alias("name"))
    properties = some.union(only).select("prop").distinct().select("prop", F.concat(F.lit("p"), "prop"))
    return extract.render(some, only, members, names.union(properties), 3).filter("id < 0")


def commerce_kb(spark: SparkSession, d: str) -> KB:
    """Customers, nations, regions and segments with intersections, disjoint regions and placed-order existentials."""
    is_a = relation(spark, d, "SELECT s, o FROM is_a WHERE s BETWEEN 1000 AND 2999 OR (s BETWEEN 1000000000 AND 1999999999 AND (o > 0 OR o BETWEEN -130009999 AND -130000000))")
    members = relation(spark, d, "SELECT kind, CAST(s AS BIGINT) AS s, CAST(o AS BIGINT) AS o FROM list_member WHERE s BETWEEN -1999999 AND -1000000 OR s IN (-90, -91)")
    some = relation(spark, d, "SELECT CAST(s AS BIGINT) AS s, CAST(prop AS BIGINT) AS prop, CAST(value AS BIGINT) AS value FROM some_ WHERE prop = 13")
    types = relation(spark, d, "SELECT s, kind FROM types WHERE s < 3000000000 AND s <> 9")
    return KB.of(spark, is_a=is_a, list_member=members, some=some, types=types, domain_range=spark.createDataFrame([("domain", 13, 8002)], "kind string, p bigint, c bigint"))


_COMMERCE = """WITH RECURSIVE t AS (SELECT s, o FROM is_a WHERE s BETWEEN 1000 AND 2999 OR (s BETWEEN 1000000000 AND 1999999999 AND (o > 0 OR o BETWEEN -130009999 AND -130000000))
  UNION SELECT s, 8002 FROM some_ WHERE prop = 13),
r AS (SELECT s, o FROM t UNION SELECT r.s, t.o FROM r JOIN t ON r.o = t.s),
n AS (SELECT r.s, m.s AS o FROM r JOIN list_member m ON m.o = r.o WHERE m.kind = 'and' AND m.s BETWEEN -1999999 AND -1000000 GROUP BY r.s, m.s HAVING count(DISTINCT m.o) = 2),
b AS (SELECT DISTINCT r.s, 2 AS o FROM r JOIN list_member m ON m.o = r.o WHERE m.s IN (-90, -91) GROUP BY r.s, m.s HAVING count(DISTINCT m.o) > 1)
SELECT s, o FROM r WHERE s >= 1000000000 UNION SELECT s, o FROM n WHERE s >= 1000000000 UNION SELECT s, o FROM b WHERE s >= 1000000000"""


def _recursive(text: str) -> str:
    inner = sql(text.replace("WITH RECURSIVE", "WITH", 1))
    return inner.replace("WITH", "WITH RECURSIVE", 1)


@q("reason_commerce", _recursive(_COMMERCE), kb=False)
def reason_commerce(spark, d):
    """The whole fixpoint over the commerce ontology: what holds of each customer, but for itself and top."""
    found = Reasoner(rules="basic").run(commerce_kb(spark, d))
    return found.sub.filter("s >= 1000000000 and s <> o and o <> 1")


@q("o79_inconsistent", _recursive(_COMMERCE.replace("SELECT s, o FROM r WHERE s >= 1000000000 UNION SELECT s, o FROM n WHERE s >= 1000000000 UNION SELECT s, o FROM b WHERE s >= 1000000000", "SELECT s FROM b WHERE s >= 1000000000")), kb=False)
def inconsistent(spark, d):
    return Reasoner(rules="basic").run(commerce_kb(spark, d)).inconsistent()


_CUSTOMERS = """cust AS (SELECT 1000000000 + c_custkey AS c, CAST(2000 + c_nationkey AS BIGINT) AS n, CAST(1000 + n_regionkey AS BIGINT) AS r, seg.id AS sg, c_custkey % 50 = 0 AS two
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN seg ON name = c_mktsegment),
regions AS (SELECT c, sg, r AS x FROM cust UNION SELECT c, sg, 1000 FROM cust WHERE two)"""


@q(
    "o81_sources",
    f"""WITH {_CUSTOMERS},
orders_of AS (SELECT DISTINCT 1000000000 + o_custkey AS c, -(13 * 10000000 + id) AS g FROM orders JOIN oclass ON st = o_orderstatus AND pr = o_orderpriority)
SELECT c AS s, r AS o, 'is_a_transitivity' AS rule, 'sub:' || c || ':0:' || n || ';sub:' || n || ':0:' || r AS sources FROM cust WHERE NOT (two AND r = 1000)
UNION ALL SELECT c, -(1000000 + sg * 10 + x - 1000), 'and_2', 'sub:' || c || ':0:' || x || ';sub:' || c || ':0:' || sg FROM regions
UNION ALL SELECT c, 2, 'disjoint', 'sub:' || c || ':0:1000;sub:' || c || ':0:' || r FROM cust WHERE two AND r <> 1000
UNION ALL SELECT c, 8002, 'is_a_transitivity', 'sub:' || c || ':0:' || g || ';sub:' || g || ':0:8002' FROM orders_of""",
)
def sources(spark, d):
    """Each inference about customers with the facts it follows from, over three rules."""
    found = Reasoner(rules="basic", explain=True).run(commerce_kb(spark, d)).derivations()
    mine = found.filter("rel = 'sub' and s >= 1000000000 and s <> o and o <> 1 and rule <> 'assertion'")
    return mine.select("s", "o", "rule", explain.sources_text(F.col("sources")).alias("sources"))


@q(
    "o82_explanation",
    f"""WITH {_CUSTOMERS}, bad AS (SELECT * FROM cust WHERE two AND r <> 1000)
SELECT c AS s, 2 AS o, false AS told, 1 AS ways FROM bad UNION SELECT c, 1000, true, 0 FROM bad UNION SELECT c, r, false, 1 FROM bad UNION SELECT c, n, true, 0 FROM bad UNION SELECT n, r, true, 0 FROM bad""",
)
def explanation(spark, d):
    """What the inconsistency of customers in two regions rests on, and nothing else."""
    found = Reasoner(rules="basic", explain=True).run(commerce_kb(spark, d)).derivations()
    bad = found.filter("rel = 'sub' and o = 2 and s >= 1000000000").select("rel", "s", "p", "o")
    return explain.graph(found, bad).filter("useful").select("s", "o", "told", "ways")


def market_kb(spark: SparkSession, d: str) -> KB:
    """Customers with the orders they placed, under axioms that need constructed concepts, cases and inverses.

    Placed orders of segment 1 are valid (19001), and 20000 + k is what placed a valid order of class k. Segment 2 trades in zone 19002 or 19003, and debtors
    (19004) aren't in the first one. An order of class 6001 is placed by rush customers (19005) only.
    """
    k = lambda text: relation(spark, d, text)
    customers = k("SELECT CAST(1000000000 + c_custkey AS BIGINT) AS s, CAST(id AS BIGINT) AS o, c_acctbal FROM customer JOIN seg ON name = c_mktsegment")
    # These rows of is_a alone: the rest of that relation, for which all lines are read, isn't about customers' orders.
    placed = k("SELECT DISTINCT CAST(1000000000 + o_custkey AS BIGINT) AS s, CAST(-(130000000 + id) AS BIGINT) AS o FROM orders JOIN oclass ON st = o_orderstatus AND pr = o_orderpriority WHERE o_custkey IS NOT NULL")
    classes = k("SELECT CAST(id AS BIGINT) AS id FROM oclass")
    is_a = customers.select("s", "o").union(placed).union(customers.filter("c_acctbal < 0").select("s", F.lit(19004).cast("bigint"))).union(spark.sql("SELECT s, o FROM VALUES (3001L, -19100L), (3002L, -19200L), (6001L, -19101L) AS t(s, o)"))
    both = classes.select(F.lit("and"), -(F.col("id") + 132000000), "id").union(classes.select(F.lit("and"), -(F.col("id") + 132000000), F.lit(19001).cast("bigint")))
    lists = spark.sql("SELECT kind, s, o FROM VALUES ('or', -19200L, 19002L), ('or', -19200L, 19003L), ('disjoint', -19300L, 19004L), ('disjoint', -19300L, 19002L), ('inverse', 14L, 13L) AS t(kind, s, o)")
    thirteen = F.lit(13).cast("bigint").alias("prop")
    some = classes.select(-(F.col("id") + 130000000), thirteen, "id").union(classes.select(-(F.col("id") + 131000000), thirteen, -(F.col("id") + 132000000)))
    only = spark.sql("SELECT s, prop, value FROM VALUES (-19100L, 13L, 19001L), (-19101L, 14L, 19005L) AS t(s, prop, value)")
    named = classes.select((F.col("id") + 14000).alias("s"), F.lit("Class").alias("kind")).union(customers.select("s", F.lit("NamedIndividual")))
    return KB.of(spark, is_a=is_a.distinct(), equivalent=classes.select(F.col("id") + 14000, -(F.col("id") + 131000000)).toDF("s", "o"), list_member=lists.union(both), some=some.toDF("s", "prop", "value"), only=only, types=named)


@q(
    "reason_full",
    """WITH c AS (SELECT CAST(1000000000 + c_custkey AS BIGINT) AS s, id AS sg, c_acctbal < 0 AS debtor FROM customer JOIN seg ON name = c_mktsegment),
p AS (SELECT DISTINCT CAST(1000000000 + o_custkey AS BIGINT) AS s, id FROM orders JOIN oclass ON st = o_orderstatus AND pr = o_orderpriority)
SELECT s, CAST(sg AS BIGINT) AS o FROM c UNION SELECT s, 19004 FROM c WHERE debtor UNION SELECT s, 19003 FROM c WHERE debtor AND sg = 3002
UNION SELECT s, 19005 FROM p WHERE id = 6001 UNION SELECT c.s, id + 14000 FROM c JOIN p ON p.s = c.s WHERE sg = 3001""",
)
def reason_full(spark, d):
    """All rules, constructing ones included, over customers and their orders: the named concepts that each customer is found to be in."""
    found = Reasoner(rules="full").run(market_kb(spark, d))
    return found.sub.filter("s >= 1000000000 and o > 1 and s <> o")


@q(
    "o10_roles",
    """WITH p AS (SELECT DISTINCT CAST(1000000000 + o_custkey AS BIGINT) AS c, CAST(4000000000 + o_orderkey AS BIGINT) AS k, id, c_mktsegment AS m FROM orders
  JOIN customer ON c_custkey = o_custkey JOIN oclass ON st = o_orderstatus AND pr = o_orderpriority)
SELECT DISTINCT c AS s, -(130000000 + id) AS o FROM p UNION ALL SELECT DISTINCT k, -(140000000 + g.id) FROM p JOIN seg g ON g.name = m UNION ALL SELECT DISTINCT k, 19001 FROM p JOIN seg g ON g.name = m WHERE g.id = 3001""",
)
def roles(spark, d):
    """Customers that placed orders (property 13, inverse 14), as individuals: orders of segment 1 are valid, customers have some of each class of order, orders some of each segment."""
    k = lambda text: relation(spark, d, text)
    people = k("SELECT CAST(1000000000 + c_custkey AS BIGINT) AS s, CAST(id AS BIGINT) AS o FROM customer JOIN seg ON name = c_mktsegment")
    orders = k("SELECT CAST(4000000000 + o_orderkey AS BIGINT) AS s, CAST(id AS BIGINT) AS o, CAST(1000000000 + o_custkey AS BIGINT) AS c FROM orders JOIN oclass ON st = o_orderstatus AND pr = o_orderpriority")
    some = k("SELECT CAST(s AS BIGINT) AS s, CAST(prop AS BIGINT) AS prop, CAST(value AS BIGINT) AS value FROM some_ WHERE prop = 13 OR (prop = 14 AND value > 3000)")
    types = people.select("s").union(orders.select("s")).select("s", F.lit("NamedIndividual").alias("kind"))
    kb = KB.of(
        spark,
        is_a=people.union(orders.select("s", "o")).union(spark.createDataFrame([(3001, -19100)], "s bigint, o bigint")),
        some=some,
        only=[(-19100, 13, 19001)],
        list_member=[("inverse", 14, 13)],
        types=types,
        role=orders.select(F.col("c").alias("s"), F.lit(13).cast("bigint").alias("p"), F.col("s").alias("o")),
    )
    return Reasoner(rules="basic").run(kb).sub.filter("s >= 1000000000 and (o < 0 or o = 19001) and o <> -19100")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return reason_commerce(spark, d)
