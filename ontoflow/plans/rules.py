"""The inference rules one by one: what each derives in one step from a knowledge base.

A rule is a conjunctive query in plain SQL over the relations of ontoflow.plans.commerce. Rules whose head is a new
construct return its parts (property, filler, the intersection node, remaining disjuncts one a row) rather than an id. The
reasoner applies the same rules, grouped, until nothing is new.
"""

from __future__ import annotations

# x is below only q.v (held), below some p.w (edge), below a union u of which l is a member and r another (split).
_HELD = "held AS (SELECT DISTINCT x.s AS x, g.prop AS q, g.value AS v FROM sub x JOIN only_ g ON g.s = x.o)"
_EDGE = "edge AS (SELECT DISTINCT x.s AS x, g.prop AS p, g.value AS w FROM sub x JOIN some_ g ON g.s = x.o)"
_SPLIT = "split AS (SELECT DISTINCT x.s AS x, m.s AS u, m.o AS l, r.o AS r FROM sub x JOIN list_member m ON m.s = x.o AND m.kind = 'or' JOIN list_member r ON r.s = m.s AND r.kind = 'or' AND r.o <> m.o)"
_OHELD = "oheld AS (SELECT y.x, y.u, y.r, g.prop AS q, g.value AS v FROM split y JOIN only_ g ON g.s = y.l)"
_OEDGE = "oedge AS (SELECT y.x, y.u, y.r, g.prop AS p, g.value AS w FROM split y JOIN some_ g ON g.s = y.l)"
# Two fillers v, w below different members a, b of a disjoint list; and below the two operands of an intersection n.
_CLASH = "clash AS (SELECT DISTINCT a.s AS v, b.s AS w FROM sub a JOIN list_member m ON m.o = a.o AND m.kind = 'disjoint' JOIN list_member n ON n.s = m.s AND n.kind = 'disjoint' AND n.o <> m.o JOIN sub b ON b.o = n.o WHERE {limit})"
_PAIR = "pair AS (SELECT m.s AS n, m.o AS a, k.o AS b FROM list_member m JOIN list_member k ON k.s = m.s AND k.kind = 'and' AND k.o <> m.o WHERE m.kind = 'and')"
# Only fillers can clash in the rules on restrictions.
_FILLERS = "a.s IN (SELECT value FROM some_ UNION SELECT value FROM only_ UNION SELECT m.o FROM list_member m JOIN only_ g ON g.value = m.s) AND b.s IN (SELECT value FROM some_ UNION SELECT value FROM only_ UNION SELECT m.o FROM list_member m JOIN only_ g ON g.value = m.s)"
_C = _CLASH.format(limit=_FILLERS)
# The union fillers of universals: only q.(l or r).
_UHELD = "uheld AS (SELECT h.x, h.q, m.s AS u, m.o AS l, r.o AS r FROM held h JOIN list_member m ON m.s = h.v AND m.kind = 'or' JOIN list_member r ON r.s = m.s AND r.kind = 'or' AND r.o <> m.o)"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


RULES: dict[str, str] = {
    "r01_equivalence": "SELECT s, o FROM equivalent UNION SELECT o AS s, s AS o FROM equivalent",
    "r02_and_flat_list": "SELECT s, o FROM list_member WHERE kind = 'and'",
    "r03_or_flat_list": "SELECT s, o FROM list_member WHERE kind = 'or'",
    "r04_disjoint_flat_list": "SELECT s, o FROM list_member WHERE kind = 'disjoint'",
    "r05_not_flat_list": "SELECT s, o FROM list_member WHERE kind = 'not'",
    "r06_inverse_flat_list": "SELECT s, o FROM list_member WHERE kind = 'inverse'",
    "r09_prop_is_a_transitivity": "SELECT DISTINCT a.s, b.o FROM prop_told a JOIN prop_told b ON a.o = b.s",
    "r10_domain": "SELECT DISTINCT g.s, d.c AS o FROM domain_range d JOIN prop_is_a h ON h.o = d.p JOIN some_ g ON g.prop = h.s WHERE d.kind = 'domain' AND d.c <> 1",
    "r11_range": "SELECT 1 AS s, p AS prop, c AS value FROM domain_range WHERE kind = 'range' AND c <> 1",
    "r24_and_linked_list": "SELECT m.s, m.o AS o1, n.o AS o2 FROM list_member m JOIN list_member n ON n.s = m.s AND n.kind = 'and' AND m.o < n.o WHERE m.kind = 'and'",
    "r25_or_linked_list": "SELECT m.s, m.o AS o1, n.o AS o2 FROM list_member m JOIN list_member n ON n.s = m.s AND n.kind = 'or' AND m.o < n.o WHERE m.kind = 'or'",
    "r26_prop_is_a_self": "SELECT s, s AS o FROM types WHERE kind IN ('ObjectProperty', 'DatatypeProperty')",
    "r27_is_a_self": "SELECT s, s AS o FROM types WHERE kind IN ('Class', 'NamedIndividual') UNION SELECT s, s AS o FROM some_ UNION SELECT s, s AS o FROM only_",
    "r28_is_a_thing": "SELECT s, CAST(1 AS BIGINT) AS o FROM types WHERE kind IN ('Class', 'NamedIndividual') UNION SELECT s, CAST(1 AS BIGINT) AS o FROM some_ UNION SELECT s, CAST(1 AS BIGINT) AS o FROM only_",
    "r29_nothing": "SELECT 'is_a' AS t, 2 AS s, 1 AS o UNION ALL SELECT 'is_a' AS t, 2 AS s, 2 AS o UNION ALL SELECT 'disjoint' AS t, 1 AS s, 2 AS o",
    "r30_is_a_transitivity_1": "SELECT DISTINCT a.s, b.o FROM is_a a JOIN is_a b ON a.o = b.s",
    # Below something that is newly below an intersection.
    "r31_is_a_transitivity_2": """WITH four AS (
      SELECT x.s, m.s AS o FROM sub x JOIN list_member m ON m.o = x.o AND m.kind = 'and' JOIN (SELECT s, count(*) AS n FROM list_member WHERE kind = 'and' GROUP BY s) z ON z.s = m.s
      GROUP BY x.s, m.s, z.n HAVING count(DISTINCT m.o) = z.n EXCEPT SELECT s, o FROM sub)
      SELECT DISTINCT a.s, f.o FROM is_a a JOIN four f ON f.s = a.o""",
    "r32_and_1": "SELECT DISTINCT x.s, m.o FROM sub x JOIN list_member m ON m.s = x.o AND m.kind = 'and'",
    "r33_and_2": "SELECT x.s, m.s AS o FROM sub x JOIN list_member m ON m.o = x.o AND m.kind = 'and' JOIN (SELECT s, count(*) AS n FROM list_member WHERE kind = 'and' GROUP BY s) z ON z.s = m.s GROUP BY x.s, m.s, z.n HAVING count(DISTINCT m.o) = z.n",
    "r34_or_1": "SELECT DISTINCT m.o AS s, x.o FROM list_member m JOIN sub x ON x.s = m.s WHERE m.kind = 'or'",
    "r35_or_2": "SELECT m.s, x.o FROM list_member m JOIN sub x ON x.s = m.o JOIN (SELECT s, count(*) AS n FROM list_member WHERE kind = 'or' GROUP BY s) z ON z.s = m.s WHERE m.kind = 'or' GROUP BY m.s, x.o, z.n HAVING count(DISTINCT m.o) = z.n",
    "r36_and_2_or_1": _with(_SPLIT, _PAIR) + "SELECT DISTINCT y.x AS s, y.u, p.n AS head, y.r AS rest FROM split y JOIN sub l ON l.s = y.l JOIN pair p ON p.a = l.o JOIN sub b ON b.s = y.x AND b.o = p.b",
    "r37_and_2_or_2": _with(_SPLIT, _PAIR) + "SELECT DISTINCT y.x AS s, y.u AS u1, z.u AS u2, p.n AS head, y.r AS rest1, z.r AS rest2 FROM split y JOIN split z ON z.x = y.x AND z.u <> y.u JOIN sub l ON l.s = y.l JOIN sub k ON k.s = z.l JOIN pair p ON p.a = l.o AND p.b = k.o",
    "r38_not": "SELECT o AS a, s AS b, 'disjoint' AS t FROM list_member WHERE kind = 'not' UNION SELECT o AS a, s AS b, 'union is top' AS t FROM list_member WHERE kind = 'not'",
    "r39_disjoint_pair": "SELECT least(s, o) AS o1, greatest(s, o) AS o2 FROM disjoint_with",
    "r40_disjoint_1": "SELECT x.s, CAST(2 AS BIGINT) AS o FROM sub x JOIN list_member m ON m.o = x.o AND m.kind = 'disjoint' GROUP BY x.s, m.s HAVING count(DISTINCT m.o) > 1",
    "r41_disjoint_or_1": _with(_SPLIT, _CLASH.format(limit="a.s IN (SELECT o FROM list_member WHERE kind = 'or') AND b.s IN (SELECT DISTINCT o FROM is_a)")) + "SELECT DISTINCT y.x AS s, y.u, y.r AS rest FROM split y JOIN clash c ON c.v = y.l JOIN is_a b ON b.s = y.x AND b.o = c.w",
    "r42_disjoint_or_2": _with(_SPLIT, _CLASH.format(limit="a.s IN (SELECT o FROM list_member WHERE kind = 'or') AND b.s IN (SELECT o FROM list_member WHERE kind = 'or')")) + "SELECT DISTINCT y.x AS s, y.u AS u1, z.u AS u2, y.r AS rest1, z.r AS rest2 FROM split y JOIN clash c ON c.v = y.l JOIN split z ON z.x = y.x AND z.l = c.w AND z.u <> y.u",
    "r43_some_subprop_subclass": "SELECT DISTINCT a.s, b.s AS o FROM some_ a JOIN prop_is_a h ON h.s = a.prop JOIN some_ b ON b.prop = h.o JOIN sub v ON v.s = a.value AND v.o = b.value",
    "r44_some_or": "SELECT DISTINCT g.s, g.prop, m.s AS u, m.o AS value FROM some_ g JOIN sub v ON v.s = g.value JOIN list_member m ON m.s = v.o AND m.kind = 'or'",
    "r45_some_nothing": "SELECT DISTINCT g.s, CAST(2 AS BIGINT) AS o FROM some_ g JOIN sub v ON v.s = g.value WHERE v.o = 2",
    "r46_only_subprop_subclass": "SELECT DISTINCT a.s, b.s AS o FROM only_ a JOIN prop_is_a h ON h.o = a.prop JOIN only_ b ON b.prop = h.s JOIN sub v ON v.s = a.value AND v.o = b.value",
    "r47_only_and": _with(_HELD, _PAIR) + "SELECT DISTINCT f.x AS s, g.q AS prop, p.n AS value FROM held f JOIN prop_is_a h ON h.o = f.q JOIN held g ON g.x = f.x AND g.q = h.s JOIN sub a ON a.s = f.v JOIN sub b ON b.s = g.v JOIN pair p ON p.a = a.o AND p.b = b.o",
    "r48_only_and_or_1": _with(_HELD, _PAIR, _UHELD) + "SELECT DISTINCT f.x AS s, g.q AS prop, p.n AS value, f.r AS rest FROM uheld f JOIN prop_is_a h ON h.o = f.q JOIN held g ON g.x = f.x AND g.q = h.s JOIN sub a ON a.s = f.l JOIN sub b ON b.s = g.v JOIN pair p ON p.a = a.o AND p.b = b.o",
    "r49_only_and_or_2": _with(_HELD, _PAIR, _UHELD) + "SELECT DISTINCT f.x AS s, f.q AS prop, p.n AS value, f.r AS rest FROM uheld f JOIN prop_is_a h ON h.s = f.q AND h.o <> h.s JOIN held g ON g.x = f.x AND g.q = h.o JOIN sub a ON a.s = f.l JOIN sub b ON b.s = g.v JOIN pair p ON p.a = a.o AND p.b = b.o",
    "r50_only_and_or_3": _with(_HELD, _PAIR, _UHELD) + "SELECT DISTINCT f.x AS s, g.q AS prop, p.n AS value, f.r AS rest1, g.r AS rest2 FROM uheld f JOIN prop_is_a h ON h.o = f.q JOIN uheld g ON g.x = f.x AND g.q = h.s JOIN sub a ON a.s = f.l JOIN sub b ON b.s = g.l JOIN pair p ON p.a = a.o AND p.b = b.o",
    "r51_only_disjoint": _with(_HELD, _C) + "SELECT DISTINCT f.x AS s, g.q AS prop FROM held f JOIN prop_is_a h ON h.o = f.q JOIN held g ON g.x = f.x AND g.q = h.s JOIN clash c ON c.v = f.v AND c.w = g.v",
    "r52_only_disjoint_or_1": _with(_HELD, _C, _UHELD) + "SELECT DISTINCT f.x AS s, f.q AS prop, f.r AS rest FROM uheld f JOIN prop_is_a h ON h.s = f.q JOIN held g ON g.x = f.x AND g.q = h.o JOIN clash c ON c.v = f.l AND c.w = g.v",
    "r53_only_disjoint_or_2": _with(_HELD, _C, _UHELD) + "SELECT DISTINCT f.x AS s, g.q AS prop, f.r AS rest1, g.r AS rest2 FROM uheld f JOIN prop_is_a h ON h.o = f.q JOIN uheld g ON g.x = f.x AND g.q = h.s JOIN clash c ON c.v = f.l AND c.w = g.l",
    "r54_some_only": _with(_HELD, _EDGE) + "SELECT DISTINCT e.x AS s, e.p AS prop, f.v AS value FROM edge e JOIN prop_is_a h ON h.s = e.p JOIN held f ON f.x = e.x AND f.q = h.o JOIN sub v ON v.s = f.v AND v.o = e.w",
    "r55_some_only_or_1": _with(_SPLIT, _OHELD, _EDGE) + "SELECT DISTINCT e.x AS s, e.p AS prop, f.v AS value, f.r AS rest FROM edge e JOIN prop_is_a h ON h.s = e.p JOIN oheld f ON f.x = e.x AND f.q = h.o JOIN sub v ON v.s = f.v AND v.o = e.w JOIN marks t ON t.s = e.x AND t.mark = 'ancestors'",
    "r56_some_only_or_2": _with(_HELD, _SPLIT, _OEDGE) + "SELECT DISTINCT e.x AS s, e.p AS prop, f.v AS value, e.r AS rest FROM oedge e JOIN prop_is_a h ON h.s = e.p JOIN held f ON f.x = e.x AND f.q = h.o JOIN sub v ON v.s = f.v AND v.o = e.w",
    "r57_some_only_or_3": _with(_SPLIT, _OHELD, _OEDGE) + "SELECT DISTINCT e.x AS s, e.p AS prop, f.v AS value, e.r AS rest1, f.r AS rest2 FROM oedge e JOIN prop_is_a h ON h.s = e.p JOIN oheld f ON f.x = e.x AND f.q = h.o AND f.u <> e.u JOIN sub v ON v.s = f.v AND v.o = e.w JOIN marks t ON t.s = e.x AND t.mark = 'ancestors'",
    "r58_some_only_and_1": _with(_HELD, _EDGE, _PAIR) + "SELECT DISTINCT e.x AS s, e.p AS prop, p.n AS value FROM edge e JOIN prop_is_a h ON h.s = e.p JOIN held f ON f.x = e.x AND f.q = h.o JOIN sub a ON a.s = f.v JOIN sub b ON b.s = e.w JOIN pair p ON p.a = a.o AND p.b = b.o",
    "r59_some_only_and_or_1": _with(_SPLIT, _OHELD, _EDGE, _PAIR) + "SELECT DISTINCT e.x AS s, e.p AS prop, p.n AS value, f.r AS rest FROM edge e JOIN prop_is_a h ON h.s = e.p JOIN oheld f ON f.x = e.x AND f.q = h.o JOIN sub a ON a.s = f.v JOIN sub b ON b.s = e.w JOIN pair p ON p.a = a.o AND p.b = b.o",
    "r60_some_only_and_or_2": _with(_HELD, _SPLIT, _OEDGE, _PAIR) + "SELECT DISTINCT e.x AS s, e.p AS prop, p.n AS value, e.r AS rest FROM oedge e JOIN prop_is_a h ON h.s = e.p JOIN held f ON f.x = e.x AND f.q = h.o JOIN sub a ON a.s = f.v JOIN sub b ON b.s = e.w JOIN pair p ON p.a = a.o AND p.b = b.o",
    "r61_some_only_and_or_3": _with(_SPLIT, _OHELD, _OEDGE, _PAIR) + "SELECT DISTINCT e.x AS s, e.p AS prop, p.n AS value, e.r AS rest1, f.r AS rest2 FROM oedge e JOIN prop_is_a h ON h.s = e.p JOIN oheld f ON f.x = e.x AND f.q = h.o AND f.u <> e.u JOIN sub a ON a.s = f.v JOIN sub b ON b.s = e.w JOIN pair p ON p.a = a.o AND p.b = b.o",
    "r62_some_only_disjoint": _with(_HELD, _EDGE, _C) + "SELECT DISTINCT e.x AS s, CAST(2 AS BIGINT) AS o FROM edge e JOIN prop_is_a h ON h.s = e.p JOIN held f ON f.x = e.x AND f.q = h.o JOIN clash c ON c.v = f.v AND c.w = e.w",
    "r63_some_only_disjoint_or_1": _with(_SPLIT, _OHELD, _EDGE, _C) + "SELECT DISTINCT e.x AS s, f.u, f.r AS rest FROM edge e JOIN prop_is_a h ON h.s = e.p JOIN oheld f ON f.x = e.x AND f.q = h.o JOIN clash c ON c.v = f.v AND c.w = e.w",
    "r64_some_only_disjoint_or_2": _with(_HELD, _SPLIT, _OEDGE, _C) + "SELECT DISTINCT e.x AS s, e.u, e.r AS rest FROM oedge e JOIN prop_is_a h ON h.s = e.p JOIN held f ON f.x = e.x AND f.q = h.o JOIN clash c ON c.v = f.v AND c.w = e.w",
    "r65_some_only_disjoint_or_3": _with(_SPLIT, _OHELD, _OEDGE, _C) + "SELECT DISTINCT e.x AS s, e.r AS rest1, f.r AS rest2 FROM oedge e JOIN prop_is_a h ON h.s = e.p JOIN oheld f ON f.x = e.x AND f.q = h.o AND f.u <> e.u JOIN clash c ON c.v = f.v AND c.w = e.w",
    "r66_some_only_inverse_1": "SELECT DISTINCT g.s, f.value AS o FROM some_ g JOIN prop_is_a h ON h.s = g.prop JOIN list_member i ON i.o = h.o AND i.kind = 'inverse' JOIN sub n ON n.s = g.value JOIN only_ f ON f.s = n.o AND f.prop = i.s",
    "r67_some_only_inverse_or_1": _with(_SPLIT) + "SELECT DISTINCT g.s, f.value AS head, g.prop, y.r AS rest FROM some_ g JOIN prop_is_a h ON h.s = g.prop JOIN list_member i ON i.o = h.o AND i.kind = 'inverse' JOIN split y ON y.x = g.value JOIN sub n ON n.s = y.l JOIN only_ f ON f.s = n.o AND f.prop = i.s",
    "r68_some_func_1": _with(_EDGE) + "SELECT DISTINCT e.x AS s, t.s AS prop, e.w AS value FROM edge e JOIN prop_is_a h ON h.s = e.p JOIN types t ON t.s = h.o AND t.kind = 'FunctionalProperty' JOIN edge f ON f.x = e.x JOIN prop_is_a k ON k.s = f.p AND k.o = t.s WHERE NOT EXISTS (SELECT 1 FROM sub z WHERE z.s = e.w AND z.o = f.w) AND NOT EXISTS (SELECT 1 FROM sub z WHERE z.s = f.w AND z.o = e.w)",
    "r69_some_func_2": _with(_EDGE) + "SELECT DISTINCT e.x AS s, g.s AS o FROM edge e JOIN prop_is_a h ON h.s = e.p JOIN types t ON t.s = h.o AND t.kind = 'FunctionalProperty' JOIN prop_is_a k ON k.o = t.s JOIN only_ g ON g.prop = k.s JOIN sub v ON v.s = e.w AND v.o = g.value",
    "r70_some_func_or": _with(_SPLIT) + "SELECT DISTINCT y.u AS s, t.s AS prop, g.value, y.r AS rest FROM split y JOIN some_ g ON g.s = y.l JOIN prop_is_a h ON h.s = g.prop JOIN types t ON t.s = h.o AND t.kind = 'FunctionalProperty'",
    "r71_inconsistency": "SELECT DISTINCT x.s FROM sub x JOIN list_member m ON m.o = x.o AND m.kind = 'disjoint' JOIN list_member n ON n.s = m.s AND n.kind = 'disjoint' AND n.o <> m.o JOIN sub y ON y.s = x.s AND y.o = n.o JOIN types c ON c.s = x.s AND c.kind = 'NamedIndividual'",
    "r72_individual_1": "SELECT DISTINCT x.o AS s, x.s AS o FROM sub x JOIN types b ON b.s = x.o AND b.kind = 'NamedIndividual' JOIN types c ON c.s = x.s AND c.kind = 'NamedIndividual' WHERE x.s <> x.o",
    "r73_concrete_individual": "SELECT DISTINCT s FROM types WHERE kind = 'NamedIndividual'",
    "r74_concrete_is_a": "SELECT DISTINCT x.o AS s FROM sub x JOIN types c ON c.s = x.s AND c.kind = 'NamedIndividual' WHERE x.o <> 1",
    "r75_concrete_some": _with(_EDGE) + "SELECT DISTINCT e.w AS s FROM edge e JOIN types c ON c.s = e.x AND c.kind = 'NamedIndividual' WHERE e.w <> 1",
    "r76_concrete_or": "SELECT x.o AS u, min(m.o) AS s FROM sub x JOIN types c ON c.s = x.s AND c.kind = 'NamedIndividual' JOIN list_member m ON m.s = x.o AND m.kind = 'or' WHERE m.o NOT IN (SELECT s FROM sub WHERE o = 2) GROUP BY x.o HAVING count(DISTINCT m.o) = 1",
}
