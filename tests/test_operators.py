"""Operators of the reasoning engine on small tables: loops, structure, results, sources, and the knowledge base's files."""

from __future__ import annotations

import random

from ontoflow.operators import extract, normalize
from ontoflow.operators.closure import reachable, restriction_depth, transitive_closure
from ontoflow.schema import KB
from ontoflow.sources import triples

PAIR = "s bigint, o bigint"


def rows(df):
    return {tuple(r) for r in df.collect()}


def brute_closure(edges):
    out = set(edges)
    while more := {(a, d) for a, b in out for c, d in out if b == c} - out:
        out |= more
    return out


def test_closure_against_brute_force(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(20), rng.randrange(20)) for _ in range(25)]
    assert rows(transitive_closure(spark.createDataFrame([*edges, edges[0], (None, 1)], PAIR))) == brute_closure(edges)
    assert transitive_closure(spark.createDataFrame([], PAIR)).count() == 0


def test_long_chain(spark):
    chain = spark.range(200).selectExpr("id s", "id + 1 o")
    assert transitive_closure(chain).count() == 200 * 201 // 2


def test_reachable(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], PAIR)
    assert rows(reachable(spark.createDataFrame([(1,)], "s bigint"), edges)) == {(1,), (2,), (3,)}


def test_restriction_depth(spark):
    some = spark.createDataFrame([(-1, 9, 5), (-2, 9, -1), (-3, 9, -2)], "s bigint, prop bigint, value bigint")
    of = spark.createDataFrame([(-1,), (-3,), (5,)], "s bigint")
    assert rows(restriction_depth(some, some.limit(0), of)) == {(-1, 1), (-3, 3), (5, 0)}


def test_simplify_lists(spark):
    members = spark.createDataFrame([(-1, 10), (-1, 11), (-1, 1), (-2, 10), (-2, 2), (-3, 1)], PAIR)
    is_a = spark.createDataFrame([(10, 11), (10, 10)], PAIR)
    assert rows(normalize.simplify_lists(members, is_a, "and")) == {(-1, 10), (-2, 2), (-3, 1)}
    assert rows(normalize.simplify_lists(members, is_a, "or")) == {(-1, 1), (-2, 10), (-3, 1)}


def test_merge_structural(spark):
    t = spark.createDataFrame([(-1, 7, 5), (-2, 7, 5), (-3, 8, -1), (-4, 8, -2), (-5, 8, 6)], "s bigint, p bigint, o bigint")
    assert rows(normalize.merge_structural(t)) == {(-1, -1), (-2, -1), (-3, -3), (-4, -3), (-5, -5)}


def test_new_parents_and_equivalents(spark):
    told = spark.createDataFrame([(10, 11), (11, 12), (12, 13)], PAIR)
    sub = transitive_closure(told.union(spark.createDataFrame([(20, 21), (21, 20)], PAIR)))
    assert rows(extract.new_parents(sub, told)) == brute_closure([(10, 11), (11, 12), (12, 13)]) - {(10, 11), (11, 12), (12, 13), (10, 12), (11, 13), (10, 13)}
    assert rows(extract.equivalents(sub)) == {(20, 21), (21, 20)}


def test_entity_kinds(spark):
    types = spark.createDataFrame([(1, "Class"), (1, "NamedIndividual"), (2, "DatatypeProperty"), (2, "ObjectProperty")], "s bigint, kind string")
    assert rows(extract.entity_kinds(types)) == {(1, "NamedIndividual"), (2, "ObjectProperty")}


def test_render(spark):
    some = spark.createDataFrame([(-1, 7, -2), (-3, 7, -3)], "s bigint, prop bigint, value bigint")
    members = spark.createDataFrame([("and", -2, 8), ("and", -2, 9)], "kind string, s bigint, o bigint")
    names = spark.createDataFrame([(7, "p"), (8, "A"), (9, "B")], "id bigint, name string")
    found = {r.id: r.text for r in extract.render(some, some.limit(0), members, names, 3).collect()}
    assert found[-1] == "(p some (A and B))" and "(...)" in found[-3]


def test_ntriples(spark, tmp_path):
    o, r = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    sub = "<http://www.w3.org/2000/01/rdf-schema#subClassOf>"
    lines = ["# a comment", "", f"<http://e/A> {sub} <http://e/B> .", f"<http://e/a> <{r}type> <{o}NamedIndividual> .", f"<http://e/a> <{r}type> <http://e/A> .", f"<http://e/A> <{r}type> <{o}Class> .", '<http://e/A> <http://e/n> "x \\" y"^^<http://e/t> .', "not a triple"]
    (tmp_path / "t.nt").write_text("\n".join(lines))
    t = triples.read_ntriples(spark, str(tmp_path / "t.nt"))
    assert t.count() == 6 and t.filter("s is null").count() == 1
    literal = t.filter("is_literal").first()
    assert literal.datatype == "http://e/t" and literal.o == 'x \\" y'
    assert triples.imported_is_a(t).count() == 2 and {r.kind for r in triples.imported_types(t).collect()} == {"NamedIndividual", "Class"}


def test_knowledge_base_round_trip(spark, tmp_path):
    kb = KB.of(spark, is_a=[(1000, 1001)], entity=[(1000, "A"), (1001, None)])
    kb.write(str(tmp_path / "kb"))
    back = KB.read(spark, str(tmp_path / "kb"))
    assert {n: rows(d) for n, d in back.relations().items()} == {n: rows(d) for n, d in kb.relations().items()}


def test_marks_turn_at_universals(spark):
    from ontoflow.operators import marks

    types = spark.createDataFrame([(1001, "Class"), (1002, "NamedIndividual"), (-9, "Class"), (9, "ObjectProperty")], "s bigint, kind string")
    told = spark.createDataFrame([(1001, -1), (-7, 1002), (-8, -7)], "s bigint, o bigint")  # 1001 is below only p.V; -8 below -7 below 1002
    members = spark.createDataFrame([("and", -2, -3), ("or", -3, -4), ("disjoint", -2, -6)], "kind string, s bigint, o bigint")
    only, some = (spark.createDataFrame(x, "s bigint, prop bigint, value bigint") for x in ([(-1, 9, -2)], [(-4, 9, -5)]))
    found = {(r.mark, r.s) for r in marks.marks(types, told, members, some, only).collect()}
    want = {(m, s) for m in (marks.DOWN, marks.UP) for s in (1001, 1002)} | {(marks.UP, -1), (marks.DOWN, -7), (marks.DOWN, -8)}
    assert found == want | {(marks.DOWN, x) for x in (-2, -3, -4, -5)}
    assert marks.marks(types.limit(0), told, members, some, only).count() == 0


def test_equivalents_merge_in_pairs(spark):
    from ontoflow.operators.normalize import merge_equivalents, pair_equivalents
    from ontoflow.schema import KB

    two = [(1003, -5), (-5, 1004), (1003, -6), (1007, 1008)]
    assert sorted(map(tuple, pair_equivalents(spark.createDataFrame(two, "s bigint, o bigint")).collect())) == [(-6, 1003)]
    kb = KB.of(spark, equivalent=[(1003, -5)], is_a=[(-5, 1001), (1010, -5)], list_member=[("and", -5, 1001)], some=[(-7, 20, -5)], types=[(-5, "Class"), (1003, "Class")])
    merged = merge_equivalents(kb)
    rows = lambda df: [tuple(r) for r in df.collect()]
    assert rows(merged.is_a) == [(1010, 1003)] and rows(merged.equivalent) == [] and rows(merged.types) == [(1003, "Class")]
    assert rows(merged.list_member) == [("and", 1003, 1001)] and rows(merged.some) == [(-7, 20, 1003)]


def test_results_and_usage_of_a_run(spark):
    from ontoflow.plans.reasoner import Reasoner
    from ontoflow.schema import KB

    kb = KB.of(spark, is_a=[(1010, 1001), (1010, 1002)], equivalent=[(1003, -5)], list_member=[("and", -5, 1001), ("and", -5, 1002)], types=[(k, "Class") for k in (1001, 1002, 1003, 1010)])
    found = Reasoner(rules="basic").run(kb)
    assert [tuple(r) for r in found.new_parents().collect()] == [(1010, 1003)] and found.complete() and found.new_equivalents().count() == 0
    assert {(r.rule, r.hits) for r in found.usage().collect() if r.hits and r.rule != "assertion"} == {("and_2", 1), ("is_a_transitivity", 3)}


def test_merge_keys_each_node_once(spark, monkeypatch):
    """nodes of three levels, an operand without a definition, and a cycle; a node is keyed in the round in which its operands are, and only cycles again."""
    keyed = []
    inner = normalize._merged
    monkeypatch.setattr(normalize, "_merged", lambda keys: (keyed.append(keys.count()), inner(keys))[1])
    level = [(-1, 7, 5), (-2, 7, 5), (-3, 8, -1), (-4, 8, -2), (-5, 9, -3), (-6, 9, -4), (-5, 9, -3)]
    found = rows(normalize.merge_structural(spark.createDataFrame(level, "s bigint, p bigint, o bigint")))
    assert found == {(-1, -1), (-2, -1), (-3, -3), (-4, -3), (-5, -5), (-6, -5)} and keyed == [2, 2, 2]
    more = [(-10, 7, -99), (-11, 7, -99), (-12, 8, -10), (-13, 8, -11), (-20, 7, -20), (-21, 7, -20), (-22, 7, -20), (-23, 9, -21), (-24, 9, -22)]
    found = rows(normalize.merge_structural(spark.createDataFrame(level + more, "s bigint, p bigint, o bigint")))
    assert found == {(-1, -1), (-2, -1), (-3, -3), (-4, -3), (-5, -5), (-6, -5), (-10, -10), (-11, -10), (-12, -12), (-13, -12), (-20, -20), (-21, -20), (-22, -20), (-23, -23), (-24, -23)}


def test_division_makes_no_partial_rows(spark):
    """below all operands of a list."""
    sub = spark.createDataFrame([(10, 1), (10, 2), (10, 3), (11, 1), (12, 2), (12, 3)], PAIR)
    members = spark.createDataFrame([(-1, 1), (-1, 2), (-2, 1), (-2, 2), (-2, 3), (-3, 3), (-4, 1), (-4, 9)], "n bigint, o bigint")
    assert rows(normalize.below_all(sub, members)) == {(10, -1), (10, -2), (10, -3), (12, -3)}


def test_marks_look_only_for_what_is_not_named(spark, monkeypatch):
    """the rounds carry constructs alone, however many individuals there are."""
    from ontoflow.operators import marks

    types = spark.range(1001, 1101).selectExpr("id s", "'NamedIndividual' kind")
    told = spark.range(1001, 1101).selectExpr("id s", "cast(-1 as bigint) o").union(spark.createDataFrame([(-5, 1001), (-6, -5)], PAIR))
    only = spark.createDataFrame([(-1, 9, -2)], "s bigint, prop bigint, value bigint")
    carried, inner = [], marks.reachable
    monkeypatch.setattr(marks, "reachable", lambda start, edges: (carried.append((start.distinct().count(), edges.count())), inner(start, edges))[1])
    found = {(r.mark, r.s) for r in marks.marks(types, told, spark.createDataFrame([], "kind string, s bigint, o bigint"), only.limit(0), only).collect()}
    assert found == {(m, s) for m in (marks.DOWN, marks.UP) for s in range(1001, 1101)} | {(marks.UP, -1), (marks.DOWN, -2), (marks.DOWN, -5), (marks.DOWN, -6)}
    assert carried[0][0] <= 2 and carried[0][1] <= 5
