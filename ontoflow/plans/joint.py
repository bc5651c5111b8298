"""Rules about what is below two concepts at once, joined over the concepts first.

The SQL of these rules (ontoflow.plans.rules) joins, for each x, the restrictions and unions above it with all subsumptions. But for x, their bodies speak of classes and
constructs only. So the pairs of concepts above an x are found first; what the rule says of each different pair is worked out once, from small tables, and then put to its x.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoflow.plans.commerce import relation
from ontoflow.plans.rules import RULES
from ontoflow.plans.storage import settle

_SPLIT = "list_member m JOIN list_member r ON r.s = m.s AND r.kind = 'or' AND r.o <> m.o"
_PAIR = "SELECT m.s AS n, m.o AS a, k.o AS b FROM list_member m JOIN list_member k ON k.s = m.s AND k.kind = 'and' AND k.o <> m.o WHERE m.kind = 'and'"
#: What may be above x: the concept c, its property q, its filler or operand v, and for unions the union u and another operand r.
HALVES = {
    "held": "SELECT s AS c, prop AS q, value AS v, CAST(NULL AS BIGINT) AS u, CAST(NULL AS BIGINT) AS r FROM only_",
    "edge": "SELECT s AS c, prop AS q, value AS v, CAST(NULL AS BIGINT) AS u, CAST(NULL AS BIGINT) AS r FROM some_",
    "split": f"SELECT m.s AS c, CAST(NULL AS INT) AS q, m.o AS v, m.s AS u, r.o AS r FROM {_SPLIT} WHERE m.kind = 'or'",
    "uheld": f"SELECT h.s AS c, h.prop AS q, m.o AS v, m.s AS u, r.o AS r FROM {_SPLIT} JOIN only_ h ON h.value = m.s WHERE m.kind = 'or'",
    "oheld": f"SELECT m.s AS c, g.prop AS q, g.value AS v, m.s AS u, r.o AS r FROM {_SPLIT} JOIN only_ g ON g.s = m.o WHERE m.kind = 'or'",
    "oedge": f"SELECT m.s AS c, g.prop AS q, g.value AS v, m.s AS u, r.o AS r FROM {_SPLIT} JOIN some_ g ON g.s = m.o WHERE m.kind = 'or'",
    "operand": f"SELECT DISTINCT b AS c, CAST(NULL AS INT) AS q, b AS v, CAST(NULL AS BIGINT) AS u, CAST(NULL AS BIGINT) AS r FROM ({_PAIR})",
    "told": "SELECT DISTINCT o AS c, CAST(NULL AS INT) AS q, o AS v, CAST(NULL AS BIGINT) AS u, CAST(NULL AS BIGINT) AS r FROM is_a",
}
#: How the fillers v and w must stand to each other, and the intersection n if one is meant.
MEETS = {
    "below": "SELECT s AS v, o AS w, CAST(NULL AS BIGINT) AS n FROM class_sub",
    "pair": f"SELECT DISTINCT a.s AS v, b.s AS w, p.n FROM ({_PAIR}) p JOIN class_sub a ON a.o = p.a JOIN class_sub b ON b.o = p.b",
    "pair_1": f"SELECT DISTINCT a.s AS v, p.b AS w, p.n FROM ({_PAIR}) p JOIN class_sub a ON a.o = p.a",
    "clash": """SELECT DISTINCT a.s AS v, b.s AS w, CAST(NULL AS BIGINT) AS n FROM list_member m JOIN list_member k ON k.s = m.s AND k.kind = 'disjoint' AND k.o <> m.o
      JOIN class_sub a ON a.o = m.o JOIN class_sub b ON b.o = k.o WHERE m.kind = 'disjoint'""",
}
_UP, _DOWN, _OTHER = "h.o = f.q AND h.s = e.q", "h.s = f.q AND h.o = e.q", "f.u <> e.u"
#: Each rule: what x is below (f with filler v, e with filler w), how they meet, a condition on the properties, one on the unions, and the columns of its head.
JOINT: dict[str, tuple[str, str, str, str | None, str | None, str]] = {
    "r36_and_2_or_1": ("split", "operand", "pair_1", None, None, "f.u, m.n AS head, f.r AS rest"),
    "r37_and_2_or_2": ("split", "split", "pair", None, _OTHER, "f.u AS u1, e.u AS u2, m.n AS head, f.r AS rest1, e.r AS rest2"),
    "r41_disjoint_or_1": ("split", "told", "clash", None, None, "f.u, f.r AS rest"),
    "r42_disjoint_or_2": ("split", "split", "clash", None, _OTHER, "f.u AS u1, e.u AS u2, f.r AS rest1, e.r AS rest2"),
    "r48_only_and_or_1": ("uheld", "held", "pair", _UP, None, "e.q AS prop, m.n AS value, f.r AS rest"),
    "r49_only_and_or_2": ("uheld", "held", "pair", _DOWN + " AND h.o <> h.s", None, "f.q AS prop, m.n AS value, f.r AS rest"),
    "r50_only_and_or_3": ("uheld", "uheld", "pair", _UP, None, "e.q AS prop, m.n AS value, f.r AS rest1, e.r AS rest2"),
    "r51_only_disjoint": ("held", "held", "clash", _UP, None, "e.q AS prop"),
    "r52_only_disjoint_or_1": ("uheld", "held", "clash", _DOWN, None, "f.q AS prop, f.r AS rest"),
    "r53_only_disjoint_or_2": ("uheld", "uheld", "clash", _UP, None, "e.q AS prop, f.r AS rest1, e.r AS rest2"),
    "r54_some_only": ("held", "edge", "below", _UP, None, "e.q AS prop, f.v AS value"),
    "r55_some_only_or_1": ("oheld", "edge", "below", _UP, None, "e.q AS prop, f.v AS value, f.r AS rest"),
    "r56_some_only_or_2": ("held", "oedge", "below", _UP, None, "e.q AS prop, f.v AS value, e.r AS rest"),
    "r57_some_only_or_3": ("oheld", "oedge", "below", _UP, _OTHER, "e.q AS prop, f.v AS value, e.r AS rest1, f.r AS rest2"),
    "r59_some_only_and_or_1": ("oheld", "edge", "pair", _UP, None, "e.q AS prop, m.n AS value, f.r AS rest"),
    "r60_some_only_and_or_2": ("held", "oedge", "pair", _UP, None, "e.q AS prop, m.n AS value, e.r AS rest"),
    "r61_some_only_and_or_3": ("oheld", "oedge", "pair", _UP, _OTHER, "e.q AS prop, m.n AS value, e.r AS rest1, f.r AS rest2"),
    "r62_some_only_disjoint": ("held", "edge", "clash", _UP, None, "CAST(2 AS BIGINT) AS o"),
    "r63_some_only_disjoint_or_1": ("oheld", "edge", "clash", _UP, None, "f.u, f.r AS rest"),
    "r64_some_only_disjoint_or_2": ("held", "oedge", "clash", _UP, None, "e.u, e.r AS rest"),
    "r65_some_only_disjoint_or_3": ("oheld", "oedge", "clash", _UP, _OTHER, "e.r AS rest1, f.r AS rest2"),
}


def _above(spark: SparkSession, d: str, source: str, half: DataFrame, c: str) -> DataFrame:
    """x and the concepts c of a half that it is below."""
    edges = relation(spark, d, f"SELECT s AS x, o AS {c} FROM {source}")
    return edges.join(settle(half.select(F.col("c").cast("bigint").alias(c)).distinct()), c, "left_semi").select("x", c)


def joint(name: str):
    """The query of a rule of two concepts above x."""
    f, e, meet, up, other, head = JOINT[name]

    def query(spark: SparkSession, d: str) -> DataFrame:
        first, second = (settle(relation(spark, d, HALVES[half]).distinct()) for half in (f, e))
        both = settle(_above(spark, d, "sub", first, "c1").join(_above(spark, d, "is_a" if e == "told" else "sub", second, "c2"), "x"))
        found = both.select("c1", "c2").distinct().join(first.alias("f"), F.col("f.c") == F.col("c1")).join(second.alias("e"), F.col("e.c") == F.col("c2"))
        if other:
            found = found.filter(other)
        if up:
            found = found.join(relation(spark, d, "SELECT s, o FROM prop_is_a").alias("h"), F.expr(up), "left_semi")
        meets = settle(relation(spark, d, MEETS[meet])).alias("m")
        found = found.join(meets, (F.col("m.v") == F.col("f.v")) & (F.col("m.w") == F.col("e.v")))
        found = settle(found.selectExpr("c1", "c2", *head.split(", ")).distinct())
        rows = both.join(found, ["c1", "c2"]).drop("c1", "c2").withColumnRenamed("x", "s").distinct()
        if "marks" in RULES[name]:
            rows = rows.join(relation(spark, d, "SELECT s FROM marks WHERE mark = 'ancestors'"), "s", "left_semi")
        return rows

    query.__name__ = name
    return query


def functional(spark: SparkSession, d: str) -> DataFrame:
    """r69: below an existential over a functional property, so below the universals over it that its filler is below."""
    of = relation(spark, d, """SELECT DISTINCT CAST(e.s AS BIGINT) AS c, g.s AS o FROM (SELECT DISTINCT s FROM types WHERE kind = 'FunctionalProperty') t JOIN prop_is_a h ON h.o = t.s JOIN some_ e ON e.prop = h.s
      JOIN class_sub v ON v.s = e.value JOIN only_ g ON g.value = v.o JOIN prop_is_a k ON k.s = g.prop AND k.o = t.s""")
    return relation(spark, d, "SELECT s, o AS c FROM sub").join(settle(of), "c").select("s", "o").distinct()


QUERIES = {**{name: joint(name) for name in JOINT}, "r69_some_func_2": functional}
