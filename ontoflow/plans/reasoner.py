"""The reasoner: a semi-naive fixpoint of joins over append-only facts.

A round applies every rule that what is new can concern, and writes what that adds as one segment (ontoflow.plans.facts). Saturation rules derive
subsumptions between known concepts; when they add nothing, construction rules make new concepts where the axioms ask for them: the successor that an existential has
under all applicable universals, the intersection of universals' fillers, and the cases of a union below a concept. Rules of the reference that
differ only in whether one or both sides sit in a union are one rule here, applied inside the cases. A new concept's id follows from its
structure, so results don't depend on the order of rules.

Of many individuals, those that nothing refers to join last: the rounds over classes don't carry it, and it then takes a few rounds however deep the classes are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoflow.functions.terms import construct_id, list_text, restriction_text
from ontoflow.operators import extract
from ontoflow.operators.closure import transitive_closure
from ontoflow.operators.normalize import below_all
from ontoflow.plans.facts import FACT, RELATIONS, Facts, facts, union
from ontoflow.plans.storage import settle
from ontoflow.schema import BOTTOM, KB, TOP


class Inconsistent(Exception):
    """A named individual is below bottom."""


def pairs(df: DataFrame, s: str, o: str) -> DataFrame:
    return df.select(F.col(s).alias("s"), F.col(o).alias("o"))


def named(df: DataFrame, **columns: str) -> DataFrame:
    """df with only these columns: new name = old name."""
    return df.select(*(F.col(old).alias(new) for new, old in columns.items()))


@dataclass
class Result:
    """What a run found. sub: all subsumptions, reflexive ones and those of top included."""

    kb: KB
    facts: Facts
    metrics: list[tuple[int, int, float]] = field(default_factory=list)

    def __post_init__(self):
        have = self.facts.all
        self.sub = have("sub").select("s", "o")
        self.some, self.only = (named(have(k), s="s", prop="p", value="o") for k in ("some", "only"))
        self.concrete, self.refused = have("concrete").select("s"), named(have("refused"), s="s", limit="p")

    def new_parents(self) -> DataFrame:
        """s, o: named parents that were neither told nor follow from a told edge and one more."""
        told = self.kb.is_a.select("s", "o").union(self.kb.equivalent.select("s", "o")).union(pairs(self.kb.equivalent, "o", "s"))
        return extract.new_parents(self.sub, told)

    def new_equivalents(self) -> DataFrame:
        """s, o: named concepts below each other that weren't told to be equivalent."""
        told = self.kb.equivalent.select("s", "o").union(pairs(self.kb.equivalent, "o", "s"))
        found = extract.equivalents(self.sub).filter(f"s > {BOTTOM} and o > {BOTTOM}")
        return found.join(told.distinct(), ["s", "o"], "left_anti")

    def entity_kinds(self) -> DataFrame:
        """s, kind: one kind for each entity."""
        return extract.entity_kinds(self.kb.types)

    def complete(self) -> bool:
        """Whether no construction was refused, so that nothing that the rules give is missing."""
        return not self.facts.has("refused")

    def usage(self) -> DataFrame:
        """rule, executions, matches, hits: how often a rule ran, what it gave, and how many of that was new (told of the first rule by name that gave it)."""
        rows = [(rule, *map(int, n)) for rule, n in sorted(self.facts.used.items())]
        return self.kb.spark.createDataFrame(rows, "rule string, executions bigint, matches bigint, hits bigint")

    def derivations(self) -> DataFrame:
        """rel, s, p, o, rule, sources: of a run with explain, each fact with the ways in which the round that made it derived it."""
        return self.facts.derivations()

    def inconsistent(self) -> DataFrame:
        """s: named individuals below bottom."""
        people = self.kb.types.filter("kind = 'NamedIndividual' and s > 0").select("s").distinct()
        return people.join(self.sub.filter(F.col("o") == BOTTOM).select("s").distinct(), "s", "left_semi")

    def check(self) -> Result:
        """Raise Inconsistent if some named individual is below bottom."""
        bad = self.inconsistent().limit(5).collect()
        if bad:
            raise Inconsistent(f"individuals below bottom: {sorted(r['s'] for r in bad)}")
        return self

    def close(self) -> None:
        """Remove what the run wrote; the result's tables can't be read after that."""
        self.facts.close()


#: Saturation rules that look at new subsumptions and at those of new constructs.
SATURATING = ("and_2", "disjoint", "some_subprop_subclass", "only_subprop_subclass", "not", "not_middle", "some_nothing", "some_only_inverse", "or_2", "role_only", "role_some")
#: Relations that only rules on members look at, or none.
STILL = {"concrete", "individual", "attr", "refused"}
#: What a refusal's limit column says.
TOO_MANY_CASES, TOO_MANY_ATOMS, TOO_DEEP = 1, 2, 3


class Reasoner:
    """rules: "full", or "basic" (only rules without unions, cases and construction).

    max_cases: how many unions of a concept are split together; max_atoms: operands of a constructed intersection;
    max_depth: nesting of constructed restrictions. Beyond these nothing is constructed, and Result.refused says what wasn't, so that a result
    that may lack something is told from a complete one. max_rounds ends in an error. explain keeps how each fact was derived
    (Result.derivations). late: how many individuals make those that nothing refers to join last; fewer join at once, as each round takes seconds whatever its data. extra: functions of the Reasoner that give more subsumptions (s, o) each round, from ``sub()`` and ``new()``.
    """

    def __init__(self, rules: str = "full", max_cases: int = 2, max_atoms: int = 12, max_depth: int = 3, max_rounds: int = 1000, extra: list[Callable[[Reasoner], DataFrame]] = (), explain: bool = False, late: int = 1_000_000):
        if rules not in ("full", "basic"):
            raise ValueError(f"no rule set {rules}")
        self.full, self.max_cases, self.max_atoms, self.max_depth, self.max_rounds, self.extra, self.explain = rules == "full", max_cases, max_atoms, max_depth, max_rounds, list(extra), explain
        self.many = late
        self._small: dict[tuple[str, str], DataFrame] = {}

    def run(self, kb: KB) -> Result:
        """All that follows. The result is the same whatever the order of axioms; an empty knowledge base gives top and bottom."""
        self.kb, self.spark = kb, kb.spark
        self.f, self.rarest = Facts(kb.spark, self.explain), None
        told, late = self._load()
        self._settle({"assertion": told})
        if late is not None:
            self._settle({"assertion": late})
        return Result(kb, self.f, self.f.metrics)

    def load(self, kb: KB, edges: Callable[[DataFrame], DataFrame] | None = None) -> Reasoner:
        """Only take in a knowledge base, for ``step``: its facts are the first round, and each relation is read when a rule first needs it. edges: makes the told subsumptions without repeats."""
        self.kb, self.spark = kb, kb.spark
        self.f, self.rarest = Facts(kb.spark, self.explain), None
        self._load_lists()
        self.f.tell({"sub": lambda: facts((edges or DataFrame.distinct)(self._edges(settle)), "sub", "s", "o"), **self._told()}, ("sub",))
        return self

    def step(self, rule: str, rel: str | None = None) -> DataFrame:
        """rel, s, p, o: all that one rule (a name of Result.usage) gives in one step from the last round's facts, known or new; nothing is added. No rows where those facts don't concern it. rel: only facts of this relation."""
        given = self._given(rule)
        if given is None:
            return self.spark.createDataFrame([], "rel string, s bigint, p bigint, o bigint")
        if rel is None:
            return given.select(*FACT).distinct()
        return given.filter(F.col("rel") == rel).select("s", "p", "o").distinct().select(F.lit(rel).alias("rel"), "s", "p", "o")

    def take(self, rule: str) -> bool:
        """Add what a step gives as a round of its own; whether any of it is new."""
        given = self._given(rule)
        of = ("concrete",) if rule in ("concrete_is_a", "concrete_some", "concrete_or") else RELATIONS
        return given is not None and self.f.add({rule: given}, of)

    def _given(self, rule: str) -> DataFrame | None:
        if (found := self._saturation(rule).get(rule)) is None and self.full:
            found = self._construct(0, rule).get(rule)
        return found

    def _first(self) -> bool:
        """Whether all facts are told ones of a step, so that what is new is all that there is."""
        return self.f.round == 1 and bool(self.f.last)

    def _kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What a rule joins all else with: for the first round of steps settled once, as its size, which Spark knows then, decides the join."""
        if not self._first():
            return make()
        if (self.f.folder, name) not in self._small:
            self._small[self.f.folder, name] = settle(make())
        return self._small[self.f.folder, name]

    def _referred(self) -> DataFrame:
        """s: what others are below."""
        return self._kept("referred", lambda: self.sub().filter(f"s <> o and o not in ({TOP}, {BOTTOM})").select(F.col("o").alias("s")).distinct())

    def _settle(self, found: dict[str, DataFrame]) -> None:
        """Add found, then saturate and construct by turns until nothing is new."""
        constructed, fresh = self.f.round, True
        for _ in range(self.max_rounds):
            if found and self.f.add(found):
                found, fresh = self._saturation(), True
            elif self.full and fresh:  # saturated: construct from what changed since the last time
                found, fresh, constructed = self._construct(constructed), False, self.f.round
            else:
                return
        raise RuntimeError(f"not settled in {self.max_rounds} rounds")

    # --- set-up -----------------------------------------------------------------------------------------------

    def _load(self) -> tuple[DataFrame, DataFrame | None]:
        """Told facts, and those of what nothing refers to. What is read more than once is settled first, so that later plans begin with a table."""
        self.kb = self.kb.with_(is_a=settle(self.kb.is_a.select("s", "o")))
        self._load_lists(settle)
        kb, edges = self.kb, settle(self._edges().distinct())
        if self._people.count() < self.many:
            return union([facts(edges, "sub", "s", "o"), *(make() for make in self._told().values())]), None
        below = [named(kb.is_a, s="o"), named(kb.equivalent, s="o"), kb.equivalent.select("s"), named(self._members, s="o"), named(self._some, s="value"), named(self._only, s="value")]
        late = settle(self._people.join(union(below).distinct(), "s", "left_anti"))
        is_late = not late.isEmpty()
        early = edges.join(late, "s", "left_anti") if is_late else edges
        told = union([facts(early, "sub", "s", "o"), *(make() for make in self._told().values())])
        return told, facts(edges.join(late, "s", "left_semi"), "sub", "s", "o") if is_late else None

    def _kind(self, kind: str) -> DataFrame:
        return self._members.filter(F.col("kind") == kind).select("s", "o")

    def _told(self) -> dict[str, Callable[[], DataFrame]]:
        """Told facts but for subsumptions, by relation."""
        kind, some, only, nots = self._kind, self._some, self._only, self._kind("not")

        def role() -> DataFrame:
            turned = named(self.kb.role.join(named(self.inverse, p="s", i="o"), "p"), s="o", p="i", o="s")
            return facts(self.kb.role.select("s", "p", "o").unionByName(turned).filter("s is not null and p is not null and o is not null").distinct(), "role", "s", "o", "p")

        return {
            "some": lambda: facts(some, "some", "s", "value", "prop"),
            "only": lambda: facts(only, "only", "s", "value", "prop"),
            "and": lambda: facts(kind("and"), "and", "s", "o"),
            "or": lambda: facts(kind("or"), "or", "s", "o"),
            "not": lambda: facts(nots, "not", "s", "o"),
            "disjoint": lambda: facts(union([kind("disjoint"), nots, pairs(nots, "s", "s")]), "disjoint", "s", "o"),
            "individual": lambda: facts(self._people, "individual", "s"),
            "concrete": lambda: facts(self._people, "concrete", "s"),
            "case": lambda: facts(kind("or"), "case", "s", "o", "s"),  # what is below all operands' concepts is above the union
            "role": role,
        }

    def _load_lists(self, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
        """Properties, and the relations that are lists."""
        kb = self.kb
        self._members, kind = keep(kb.list_member.distinct()), self._kind
        inverse = kind("inverse")
        self.inverse = settle(inverse.union(pairs(inverse, "o", "s")).distinct())
        typed = lambda k: kb.types.filter(F.col("kind") == k).select("s").distinct()
        self.functional, self._people = settle(typed("FunctionalProperty")), keep(typed("NamedIndividual"))
        some, only = keep(kb.some.distinct()), keep(kb.only.distinct())
        used = union([kb.prop_is_a.select("s"), kb.prop_is_a.select(F.col("o").alias("s")), some.select(F.col("prop").alias("s")), only.select(F.col("prop").alias("s")), self.inverse.select("s"), self.functional, kb.domain_range.select(F.col("p").alias("s")), named(kb.role, s="p")]).distinct()
        # p below q, so the inverse of p is below the inverse of q.
        i, j = named(self.inverse, p="s", ip="o"), named(self.inverse, q="s", iq="o")
        turned = named(named(kb.prop_is_a, p="s", q="o").join(i, "p").join(j, "q"), s="ip", o="iq")
        self.props = settle(transitive_closure(kb.prop_is_a.select("s", "o").union(turned)).union(pairs(used, "s", "s")).distinct())
        #: Properties p1, q2 such that what is related over p1 is related back over q2.
        up = lambda a, b: named(self.props, **{a: "s", b: "o"})
        self.back = settle(up("p1", "p").join(named(self.inverse, p="s", q="o"), "p").join(up("q", "q2"), "q").select("p1", "q2").distinct())
        self.has_inverse, self.has_functional = not self.inverse.isEmpty(), not self.functional.isEmpty()
        self._ranges = kb.domain_range.filter(f"kind = 'range' and c <> {TOP}").select(construct_id(restriction_text("only", F.col("p"), F.col("c"))).alias("s"), F.col("p").alias("prop"), F.col("c").alias("value"))
        self._some, self._only = some, only.unionByName(self._ranges).distinct()
        self.told_ors = settle(kind("or").select("s").distinct())

    def _edges(self, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """Told subsumptions (s, o), some of them more than once: asserted ones, those of equivalents, lists, domains and ranges (which are read twice: keep), and of each concept to itself and top."""
        kb, spark, kind, some, only = self.kb, self.spark, self._kind, self._some, self._only
        domains = kb.domain_range.filter(f"kind = 'domain' and c <> {TOP}").select(F.col("p").alias("up"), F.col("c").alias("o"))
        # The existential of a property's domain holds for its subproperties too.
        domains = some.join(named(self.props, prop="s", up="o"), "prop").join(domains, "up").select("s", "o")
        top = F.lit(TOP).cast("bigint")
        other = keep(union([kb.equivalent.select("s", "o"), pairs(kb.equivalent, "o", "s"), kind("and"), pairs(kind("or"), "o", "s"), domains, self._ranges.select(top.alias("s"), F.col("s").alias("o"))]))
        both = lambda df, a, b: df.select(F.explode(F.array(a, b)).alias("s"))
        ids = union([kb.is_a.select("s"), named(kb.is_a, s="o"), both(other, "s", "o"), both(some, "s", "value"), both(only, "s", "value"), named(self._members.filter("kind <> 'inverse'"), s="o"), kind("not").select("s"), kb.types.filter("kind in ('Class', 'NamedIndividual')").select("s"), spark.range(TOP, BOTTOM + 1).toDF("s")]).distinct()
        return union([kb.is_a.select("s", "o"), other, ids.select("s", F.explode(F.array("s", top)).alias("o"))]).filter(f"s is not null and o is not null and (s <> {BOTTOM} or o in ({TOP}, {BOTTOM}))")

    def sub(self) -> DataFrame:
        return self.f.all("sub").select("s", "o")

    def new(self) -> DataFrame:
        """Subsumptions of the last round."""
        found = self.f.new("sub")
        return (self.f.all("sub").limit(0) if found is None else found).select("s", "o")

    def _dead(self, name: str) -> DataFrame:
        return self.sub().filter(F.col("o") == BOTTOM).select(F.col("s").alias(name))

    def _met(self) -> DataFrame:
        """Subsumptions that rules over restrictions, lists and cases must look at: new ones, and old ones of the values and operands of new constructs."""
        if self._first():
            return self.new()
        out = [self.new()]
        fresh = [named(d, s="o") for k in ("some", "only") if (d := self.f.new(k)) is not None]
        operands = []
        if (d := self.f.new("and")) is not None:
            operands.append(self._rarest().join(named(d, n="s").distinct(), "n", "left_semi").select("o"))  # what is below all operands is below this one
        if (d := self.f.new("disjoint")) is not None:
            operands.append(d.select("o"))
        if fresh:
            out.append(self.sub().join(union(fresh).distinct(), "s", "left_semi"))
        if operands or fresh:
            out.append(self.sub().join(union([*operands, *(named(d, o="s") for d in fresh)]).distinct(), "o", "left_semi").select("s", "o"))
        return settle(union(out).distinct()) if len(out) > 1 else out[0]  # all rules read it

    def _rarest(self) -> DataFrame:
        """n, o: each intersection's operand that fewest others have. Thousands of cases may share an operand, and what is below that one isn't tried with each of them."""
        if "and" in self.f.last or self.rarest is None:
            ands = self.f.all("and").select(F.col("s").alias("n"), "o")
            often = ands.groupBy("o").agg(F.count("*").alias("lists"))
            self.rarest = settle(ands.join(often, "o").groupBy("n").agg(F.min(F.struct("lists", "o"))["o"].alias("o")))
        return self.rarest

    # --- saturation -------------------------------------------------------------------------------------------

    def _saturation(self, only: str | None = None) -> dict[str, DataFrame]:
        """The rules that the last round's facts concern, each with what it gives; only one of them, if it is named."""
        if only is None:
            self.f.compact()
        last, has, found = self.f.last, self.f.has, {}
        want = lambda *names: only is None or only in names
        if want("is_a_transitivity") and "sub" in last:
            found["is_a_transitivity"] = self._transitive()
        if want("top") and "sub" in last and self.f.tops:
            found["top"] = self._of_top()
        stirred = bool(set(last) - STILL)
        met = self._met() if stirred and want(*SATURATING) else None
        rules: list[tuple[str, tuple[str, ...], Callable[[DataFrame], DataFrame]]] = [
            ("and_2", ("and",), self._and),
            ("disjoint", ("disjoint",), self._disjoint),
            ("some_subprop_subclass", ("some",), lambda m: self._restricted(m, "some")),
            ("only_subprop_subclass", ("only",), lambda m: self._restricted(m, "only")),
            ("not", ("not", "disjoint"), self._complement),
            ("not_middle", ("not",), self._middle),
        ]
        if stirred:
            found |= {name: rule(met) for name, needs, rule in rules if want(name) and all(map(has, needs))}
        if stirred and want("some_nothing") and has("some") and (self.f.bottoms or "some" in last):
            found["some_nothing"] = self._empty_successor(met)
        if want("only_nothing") and has("only") and (self.f.bottoms or "only" in last):
            found["only_nothing"] = self._only_nothing()
        if stirred and want("some_only_inverse") and self.has_inverse and has("some") and has("only"):
            found["some_only_inverse"] = self._inverse(met)
        if stirred and want("or_2") and self.full and has("case"):
            found["or_2"] = self._by_cases(met)
        if stirred and want("role_only", "role_some") and has("role"):
            found |= self._roles(met)
        if want("concrete_is_a", "concrete_some", "concrete_or", "individual_1") and has("individual"):
            found |= self._concrete(only)
        for k, rule in enumerate(self.extra):
            if want(f"extra_{k}"):
                found[f"extra_{k}"] = facts(rule(self), "sub", "s", "o")
        return {name: df.filter(f"rel <> 'sub' or s <> {BOTTOM}") for name, df in found.items() if want(name)}

    def _transitive(self) -> DataFrame:
        """New edges before and after known ones; edges to top are never the first, reflexive ones neither."""
        first, then = f"s <> o and o not in ({TOP}, {BOTTOM})", f"s <> o and o <> {TOP}"
        after = self._kept("after", lambda: self.sub().filter(then).join(self._referred(), "s", "left_semi")) if self._first() else self.sub().filter(then)
        a = named(self.new().filter(first), x="s", y="o").join(named(after, y="s", z="o"), "y")
        if self._first():
            return self._facts(a, "sub", "x", "z", via=[("sub", "x", None, "y"), ("sub", "y", None, "z")])
        b = named(self.sub().filter(first), x="s", y="o").join(named(self.new().filter(then), y="s", z="o"), "y")
        return self._facts(a.union(b), "sub", "x", "z", via=[("sub", "x", None, "y"), ("sub", "y", None, "z")])

    def _of_top(self) -> DataFrame:
        """What is above top is above every concept; a key of its own for each part of the concepts, so that none is hot."""
        parts = 64
        tops = self.new().filter(f"s = {TOP} and o <> {TOP}").select(F.col("o").alias("z"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        every = self.sub().filter(f"s = o and s <> {BOTTOM}").select(F.col("s").alias("x"), F.pmod(F.xxhash64("s"), F.lit(parts)).cast("int").alias("part"))
        return self._facts(every.join(tops, "part"), "sub", "x", "z", via=[("sub", TOP, None, "z")])

    def _and(self, met: DataFrame) -> DataFrame:
        """Division: below all operands, so below the intersection. Only pairs that the new facts touch are counted."""
        ands = named(self.f.all("and"), n="s", o="o")
        if self._first() and not self.explain:
            found = below_all(self.sub(), ands).join(named(self.sub().join(named(ands, o="n").distinct(), "o", "left_semi"), s="s", n="o"), ["s", "n"], "left_anti")
            return facts(found, "sub", "s", "n")
        size = ands.groupBy("n").agg(F.count("*").alias("size"))
        known = named(self.sub().join(named(ands, o="n").distinct(), "o", "left_semi"), s="s", n="o")
        below = self.sub().join(ands, "o")
        if not self._first():
            who = met.join(ands.select("o").distinct(), "o", "left_semi").select("s").distinct()
            touched = self.sub().join(self._rarest(), "o").select("s", "n").join(who, "s", "left_semi").join(known, ["s", "n"], "left_anti")
            below = touched.join(ands, "n").join(self.sub(), ["s", "o"], "left_semi")
        whole = below.groupBy("s", "n").agg(F.count("*").alias("met"), *self._listed("sub", "s", "o")).join(size, "n").filter("met = size")
        whole = whole.join(known, ["s", "n"], "left_anti") if self._first() else whole
        return self._facts(whole, "sub", "s", "n", via=self._via(whole))

    def _facts(self, df: DataFrame, rel: str, s, o=None, p=None, via: list[tuple] | Column | None = None) -> DataFrame:
        """Facts with what they follow from, where that is kept."""
        return facts(df, rel, s, o, p, via if self.explain else None)

    def _listed(self, rel: str, s: str, o: str) -> list[Column]:
        """With explain, the facts of a group, as the column via."""
        if not self.explain:
            return []
        return [F.sort_array(F.collect_set(F.struct(F.lit(rel).alias("rel"), F.col(s).alias("s"), F.lit(0).cast("bigint").alias("p"), F.col(o).alias("o")))).alias("via")]

    def _via(self, df: DataFrame, *more: tuple) -> Column | None:
        if not self.explain:
            return None
        extra = [F.struct(F.lit(r).alias("rel"), *(((F.lit(0) if c is None else F.lit(c) if isinstance(c, int) else F.col(c)).cast("bigint")).alias(n) for c, n in zip(cs, ("s", "p", "o")))) for r, *cs in more]
        return F.concat(F.col("via"), F.array(*extra)) if extra else F.col("via")

    def _disjoint(self, met: DataFrame) -> DataFrame:
        """Two different members of a disjoint list above one concept; a count by list, never pairs."""
        lists = named(self.f.all("disjoint"), d="s", o="o")
        touched = met.join(lists, "o").select("s", "d").distinct()
        count = touched.join(lists, "d").join(self.sub(), ["s", "o"], "left_semi").groupBy("s", "d").agg(F.count("*").alias("n"), *self._listed("sub", "s", "o")).filter("n > 1")
        return self._facts(count, "sub", "s", BOTTOM, via=self._via(count))

    def _restricted(self, met: DataFrame, kind: str) -> DataFrame:
        """Restrictions over comparable properties and values: some grows with its property, only shrinks."""
        a, b = named(self.f.all(kind), s1="s", p1="p", v1="o"), named(self.f.all(kind), s2="s", p2="p", v2="o")
        h = named(self.props, p1="s", p2="o") if kind == "some" else named(self.props, p2="s", p1="o")
        found = named(met, v1="s", v2="o").join(a, "v1").join(h, "p1").join(b, ["p2", "v2"])
        return self._facts(found, "sub", "s1", "s2", via=[(kind, "s1", "p1", "v1"), ("sub", "v1", None, "v2"), (kind, "s2", "p2", "v2")])

    def _empty_successor(self, met: DataFrame) -> DataFrame:
        found = named(met.filter(F.col("o") == BOTTOM), v="s").join(named(self.f.all("some"), x="s", p="p", v="o"), "v")
        return self._facts(found, "sub", "x", BOTTOM, via=[("some", "x", "p", "v"), ("sub", "v", None, BOTTOM)])

    def _only_nothing(self) -> DataFrame:
        """What has no successors over a property has only such of any kind over it."""
        only = self.f.all("only")
        none = named(only, s1="s", p1="p", v1="o").join(self._dead("v1"), "v1")
        found = none.join(named(self.props, p2="s", p1="o"), "p1").join(named(only, s2="s", p2="p", v2="o"), "p2").filter("s1 <> s2")
        return self._facts(found, "sub", "s1", "s2", via=[("only", "s1", "p1", "v1"), ("sub", "v1", None, BOTTOM), ("only", "s2", "p2", "v2")])

    def _complement(self, met: DataFrame) -> DataFrame:
        """x is below not-A if it is below something disjoint with something above A."""
        nots, lists = named(self.f.all("not"), n="s", a="o"), named(self.f.all("disjoint"), d="s", m="o")

        def block(sub: DataFrame) -> DataFrame:
            over = nots.join(named(sub, a="s", m="o"), "a").join(lists, "m")
            return over.join(named(lists, d="d", b="m"), "d").filter("b <> m").select("n", "a", "m", "b").distinct()

        found = named(met, x="s", b="o").join(block(self.sub()), "b").unionByName(named(self.sub(), x="s", b="o").join(block(met), "b"))
        return self._facts(found, "sub", "x", "n", via=[("sub", "x", None, "b"), ("sub", "a", None, "m"), ("not", "n", None, "a")])

    def _middle(self, met: DataFrame) -> DataFrame:
        """What holds of A and of not-A holds of top."""
        nots = named(self.f.all("not"), n="s", a="o")
        new, all_ = met.filter(f"o <> {TOP}"), self.sub().filter(f"o <> {TOP}")
        one = nots.join(named(new, n="s", z="o"), "n").join(named(all_, a="s", z="o"), ["a", "z"])
        two = nots.join(named(new, a="s", z="o"), "a").join(named(all_, n="s", z="o"), ["n", "z"])
        return self._facts(one.unionByName(two), "sub", TOP, "z", via=[("sub", "n", None, "z"), ("sub", "a", None, "z"), ("not", "n", None, "a")])

    def _inverse(self, met: DataFrame) -> DataFrame:
        """M is some P.N, N only has A over P's inverse: M is below A."""
        held = named(met, n="s", g="o").join(named(self.f.all("only"), g="s", q2="p", a="o"), "g")
        found = held.join(self.back, "q2").join(named(self.f.all("some"), m="s", p1="p", n="o"), ["p1", "n"])
        return self._facts(found, "sub", "m", "a", via=[("some", "m", "p1", "n"), ("sub", "n", None, "g"), ("only", "g", "q2", "a")])

    def _by_cases(self, met: DataFrame) -> DataFrame:
        """Below z in all cases, but for impossible ones: below z."""
        cases = named(self.f.all("case"), x="s", u="p", k="o")
        touched = [named(met, k="s").distinct().join(cases, "k").select("x", "u")]
        if (d := self.f.new("case")) is not None:
            touched.append(named(d, x="s", u="p"))
        c = cases if self._first() else cases.join(union(touched).distinct(), ["x", "u"], "left_semi")
        live = c.join(self._dead("k").distinct(), "k", "left_anti")
        size = live.groupBy("x", "u").agg(F.count("*").alias("size"))
        none = c.select("x", "u").distinct().join(size, ["x", "u"], "left_anti")
        every = live.join(named(self.sub(), k="s", z="o"), "k").groupBy("x", "u", "z").agg(F.count("*").alias("n"), *self._listed("sub", "k", "z")).join(size, ["x", "u"]).filter("n = size")
        return self._facts(every, "sub", "x", "z", via=self._via(every, ("sub", "x", None, "u"))).unionByName(self._facts(none, "sub", "x", BOTTOM, via=[("sub", "x", None, "u")]))

    def _roles(self, met: DataFrame) -> dict[str, DataFrame]:
        """Individuals that are related: o is in what s only has over the property, and s has some of what o is."""
        roles, up = named(self.f.all("role"), x="s", p="p", y="o"), named(self.props, p="s", q="o")
        found = {}
        if self.f.has("only"):
            held = named(met, x="s", g="o").join(named(self.f.all("only"), g="s", q="p", c="o"), "g").join(up, "q").join(roles, ["x", "p"])
            found["role_only"] = self._facts(held, "sub", "y", "c", via=[("sub", "x", None, "g"), ("only", "g", "q", "c"), ("role", "x", "p", "y")])
        if self.f.has("some"):
            has = named(met, y="s", c="o").join(named(self.f.all("some"), e="s", q="p", c="o"), "c").join(up, "q").join(roles, ["y", "p"])
            found["role_some"] = self._facts(has, "sub", "x", "e", via=[("role", "x", "p", "y"), ("sub", "y", None, "c"), ("some", "e", "q", "c")])
        return found

    def _concrete(self, only: str | None = None) -> dict[str, DataFrame]:
        """Concepts that have members: individuals, what is above or linked to them, and the last possible operand of a concrete union. A concrete concept below {b} holds b."""
        found, concrete = {}, self.f.all("concrete").select("s")
        up = lambda df: df.filter(f"s <> o and o not in ({TOP}, {BOTTOM})")
        if only == "individual_1" and self._first():
            # Few individuals have something below them: these first.
            held = self._kept("held", lambda: named(self.f.all("individual").select("s").join(self._referred(), "s", "left_semi"), o="s"))
            found["individual_1"] = self._facts(up(self.new()).join(held, "o", "left_semi").join(concrete, "s", "left_semi"), "sub", "o", "s", via=[("concrete", "s", None, None), ("sub", "s", None, "o")])
            return found
        above = [up(self.new()).join(concrete, "s", "left_semi")]
        if not self._first() and (d := self.f.new("concrete")) is not None:
            above.append(up(self.sub()).join(d.select("s"), "s", "left_semi"))
        above = union(above)
        found["concrete_is_a"] = self._facts(above, "concrete", "o", via=[("concrete", "s", None, None), ("sub", "s", None, "o")])
        if only == "concrete_is_a":
            return found
        if self.f.has("some") and ("concrete" in self.f.last or "some" in self.f.last):
            linked = self.f.all("some").filter(f"o <> {TOP}").join(concrete, "s", "left_semi")
            found["concrete_some"] = self._facts(linked, "concrete", "o", via=[("concrete", "s", None, None), ("some", "s", "p", "o")])
        if self.f.has("or") and ("concrete" in self.f.last or self.f.bottoms):
            found["concrete_or"] = self._facts(self.last_operands(), "concrete", "o", via=[("concrete", "s", None, None), ("or", "s", None, "o")])
        held = above.join(named(self.f.all("individual"), o="s"), "o")
        found["individual_1"] = self._facts(held, "sub", "o", "s", via=[("concrete", "s", None, None), ("sub", "s", None, "o")])
        return found

    def last_operands(self) -> DataFrame:
        """s, o: each union that has members, with its operand where one alone is possible."""
        live = self.f.all("or").join(self.f.all("concrete").select("s"), "s", "left_semi").join(self._dead("o").distinct(), "o", "left_anti")
        return live.groupBy("s").agg(F.count("*").alias("n"), F.min("o").alias("o")).filter("n = 1").select("s", "o")

    # --- construction -----------------------------------------------------------------------------------------

    def _construct(self, since: int, only: str | None = None) -> dict[str, DataFrame]:
        """New concepts for what rounds after ``since`` changed; only those of one rule, if it is named."""
        has = self.f.has
        want = lambda *names: only is None or only in names
        self.attr = self.f.all("attr").groupBy(F.col("s").alias("id")).agg(F.max("p").alias("depth"), F.max("o").alias("cases"))
        asked, found = [], {}
        if want("some_or") and has("some") and has("case"):
            found["some_or"] = self._existentials_of_cases()
        if only == "some_or":
            return found
        self.touched = None
        if not self._first():
            alive = self._dead("x").distinct()
            self.touched = settle(named(self.f.since("sub", since), x="s").distinct().join(alive, "x", "left_anti").filter(f"x <> {BOTTOM}"))
        every = ("construct_and", "refused")
        if want("some_only", *every) and has("only") and has("some"):
            asked.append(self._successors())
        if want("only_and", *every) and has("only"):
            asked.append(self._fillers())
        if want("case", *every) and (has("or") or has("not")):
            asked.append(self._open_unions())
        if asked:
            found |= self._contexts(union(asked))
        if want("some_func", "func_refused", "some_func_inverse") and self.has_functional and has("some"):
            found |= self._functional()
        return found

    def _alive(self, df: DataFrame) -> DataFrame:
        """Rows of what has changed (x) and isn't below bottom."""
        if self.touched is not None:
            return df.join(self.touched, "x", "left_semi")
        return df.join(self._kept("dead", lambda: self._dead("x").distinct()), "x", "left_anti").filter(f"x <> {BOTTOM}")

    def _below(self, kind: str, x: str, g: str, prop: str, value: str) -> DataFrame:
        """x, g, prop, value: touched concepts below a restriction."""
        edges = self._alive(named(self.sub(), x="s", g="o").join(named(self.f.all(kind), g="s", prop="p", value="o"), "g"))
        return named(edges.filter(f"value <> {TOP}"), **{x: "x", g: "g", prop: "prop", value: "value"})

    def _asked(self, df: DataFrame, rule: str, x: str, p: str, w: Column, u: Column) -> DataFrame:
        """rule, x, p, w, u, part, g: a concept (one row a part) whose parts' intersection is asked for, as x is below g."""
        return df.select(F.lit(rule).alias("rule"), F.col(x).alias("x"), F.col(p).alias("p") if p else F.lit(0).cast("bigint").alias("p"), w.cast("bigint").alias("w"), u.cast("bigint").alias("u"), "part", "g")

    def _successors(self) -> DataFrame:
        """An existential's successor is in all fillers of the universals that hold."""
        edge = self._below("some", "x", "e", "p", "w").groupBy("x", "p", "w").agg(F.min("e").alias("e"))
        only = self._below("only", "x", "g", "q", "v").groupBy("x", "q", "v").agg(F.min("g").alias("g"))
        held = edge.join(named(self.props, p="s", q="o"), "p").join(only, ["x", "q"]).groupBy("x", "p", "w", "e", "v").agg(F.min("g").alias("g"))
        values = self._kept("values", lambda: self.sub().join(named(self.f.all("some"), s="o").distinct(), "s", "left_semi").join(self.f.all("only").select("o").distinct(), "o", "left_semi").select("s", "o"))
        held = held.join(named(values, w="s", v="o"), ["w", "v"], "left_anti")
        both = F.explode(F.array(F.struct(F.col("v").alias("part"), F.col("g").alias("why")), F.struct(F.col("w").alias("part"), F.col("e").alias("why"))))
        parts = held.select("x", "p", "w", both.alias("b")).select("x", "p", "w", "b.part", F.col("b.why").alias("g"))
        return self._asked(parts, "some_only", "x", "p", F.col("w"), F.lit(0))

    def _fillers(self) -> DataFrame:
        """Universals over one property at once: their fillers' intersection."""
        props = named(self.f.all("only"), p="p").distinct()
        held = self._below("only", "x", "g", "q", "v").join(named(self.props, p="s", q="o").join(props, "p", "left_semi"), "q").groupBy("x", "p", "v").agg(F.min("g").alias("g"))
        return self._asked(named(held, x="x", p="p", part="v", g="g"), "only_and", "x", "p", F.lit(0), F.lit(0))

    def _open_unions(self) -> DataFrame:
        """Cases of the unions below which a concept is, unless it is below one of their operands."""
        ors = named(self.f.all("or"), u="s", l="o")
        some_values = named(self.f.all("some"), x="o") if self.f.has("some") else self.attr.select(F.col("id").alias("x")).limit(0)
        able = union([some_values, named(self.attr, x="id")]).distinct().withColumn("able", F.lit(True))
        below = self._alive(named(self.sub(), x="s", u="o").join(ors.select("u").distinct(), "u", "left_semi").filter("x <> u")).join(able, "x", "left").filter("x > 0 or able").select("x", "u")
        operands = self.sub().join(named(ors, o="l").distinct(), "o", "left_semi")
        met = below.join(ors, "u").join(named(operands, x="s", l="o"), ["x", "l"], "left_semi").select("x", "u").distinct()
        open_ = below.join(met, ["x", "u"], "left_anti").join(ors, "u").select("x", "u", "l")
        if self.f.has("not") and self.f.has("and"):
            # Excluded middle, for a concept that has part of the other operand of a union with not-A.
            nots = named(self.f.all("not"), n="s", a="o")
            with_not = nots.join(named(ors, n="l", u="u"), "n").join(named(ors, u="u", other="l"), "u").filter("other <> n")
            part = with_not.join(named(self.f.all("and"), other="s", b="o"), "other").select("n", "a", "b").distinct()
            asked = self._alive(named(self.sub(), x="s", b="o").join(part, "b")).filter(f"x > {BOTTOM}").select("x", "n", "a").distinct()
            open_ = open_.unionByName(asked.select("x", F.col("n").alias("u"), F.explode(F.array("n", "a")).alias("l")))
        parts = open_.select("x", "u", "l", F.explode(F.array("x", "l")).alias("part"), F.col("u").alias("g")).distinct()
        return self._asked(parts, "case", "x", None, F.col("l"), F.col("u"))

    def _contexts(self, asked: DataFrame) -> dict[str, DataFrame]:
        """Facts of the intersections asked for, within the limits: without operands that others are below."""
        key = ["rule", "x", "p", "w", "u"]
        asked = settle(asked.distinct())
        if asked.isEmpty():
            return {}
        limits = asked.join(named(self.attr, part="id", depth="depth", cases="cases"), "part", "left").groupBy(*key).agg(F.max(F.coalesce("depth", F.lit(0))).alias("depth"), F.max(F.coalesce("cases", F.lit(0))).alias("cases"))
        inner = named(self.f.all("and"), part="s", atom="o").join(named(self.attr, part="id"), "part", "left_semi")
        atoms = asked.join(inner, "part", "left").select(*key, F.coalesce("atom", "part").alias("a")).distinct()
        within = self.sub()
        if self._first():
            # Only what others are below can be above another part.
            heads = settle(named(asked.select("part").distinct().join(named(self._referred(), part="s"), "part", "left_semi"), o="part"))
            within = settle(within.filter("s <> o").join(heads, "o", "left_semi").join(named(asked, s="part").distinct(), "s", "left_semi").select("s", "o"))
        below = named(within, b="s", a="o")
        over = atoms.join(named(atoms, **{c: c for c in key}, b="a"), key).filter("a <> b").join(below, ["a", "b"], "left_semi")
        back = named(within, a="s", b="o").withColumn("both", F.lit(True))
        over = over.join(back, ["a", "b"], "left").filter("both is null or b < a").select(*key, "a").distinct()
        least = atoms.join(over, [*key, "a"], "left_anti").groupBy(*key).agg(F.array_sort(F.collect_set("a")).alias("atoms"))
        made = least.join(limits, key).withColumn("k", F.when(F.size("atoms") == 1, F.col("atoms")[0]).otherwise(construct_id(list_text("and", F.col("atoms")))))
        split = F.col("rule") == "case"
        cases = F.col("cases") + F.when(split, 1).otherwise(0)
        limit = F.when(cases > self.max_cases, TOO_MANY_CASES).when(F.size("atoms") > self.max_atoms, TOO_MANY_ATOMS).when(~split & (F.col("depth") >= self.max_depth), TOO_DEEP)
        made = made.withColumns({"cases": cases, "limit": limit}).filter("rule <> 'only_and' or size(atoms) > 1")
        # A union is split into all of its cases, or into none.
        worst = made.groupBy("rule", "x", "p", "u", F.when(split, 0).otherwise(F.col("w")).alias("w2")).agg(F.max("limit").alias("worst"))
        made = settle(made.withColumn("w2", F.when(split, 0).otherwise(F.col("w"))).join(worst, ["rule", "x", "p", "u", "w2"]))
        refused, able = made.filter("worst is not null"), made.filter("worst is null")
        several = able.filter("size(atoms) > 1")
        each = several.select("k", F.explode("atoms").alias("a"))
        found = {
            "construct_and": union([facts(each, "and", "k", "a"), facts(each, "sub", "k", "a"), facts(each, "sub", "k", "k"), facts(each, "sub", "k", TOP), facts(several, "attr", "k", "cases", "depth")]),
            "refused": facts(refused, "refused", "x", p="worst"),
            "case": self._facts(able.filter("rule = 'case'"), "case", "x", "k", "u", via=[("sub", "x", None, "u")]),
        }
        for rule, kind in (("some_only", "some"), ("only_and", "only")):
            mine = able.filter(F.col("rule") == rule)
            if self.explain:
                mine = mine.join(asked.groupBy(*key).agg(*self._listed("sub", "x", "g")), key)
            found[rule] = self._restriction(kind, mine.withColumnsRenamed({"p": "prop", "k": "value"}), self._via(mine))
        return found

    def _known(self, kind: str, made: DataFrame) -> DataFrame:
        """made (prop, value, ...) with r, the id of its restriction: the least that there is, or one from its structure."""
        old = self.f.all(kind).groupBy(F.col("p").alias("prop"), F.col("o").alias("value")).agg(F.min("s").alias("old"))
        return made.join(old, ["prop", "value"], "left").withColumn("r", F.coalesce("old", construct_id(restriction_text(kind, F.col("prop"), F.col("value"))))).drop("old")

    def _entered(self, kind: str, made: DataFrame) -> list[DataFrame]:
        """Facts that enter restrictions (r, prop, value, depth of the value)."""
        return [facts(made, kind, "r", "value", "prop"), facts(made, "attr", "r", 0, F.col("depth") + 1), facts(made, "sub", "r", "r"), facts(made, "sub", "r", TOP)]

    def _restriction(self, kind: str, made: DataFrame, via: Column | None = None) -> DataFrame:
        """Facts of x below kind prop.value, the restriction entered if there is none."""
        made = self._known(kind, made)
        return union([*self._entered(kind, made), self._facts(made, "sub", "x", "r", via=via)])

    def _functional(self) -> dict[str, DataFrame]:
        """The only successor over a functional property is in the filler of any existential below it."""
        f = named(self.props, p="s", prop="o").join(named(self.functional, prop="s"), "prop", "left_semi")
        edge = self._below("some", "x", "g", "p", "v").join(f, "p").select("x", "prop", "v").distinct()
        edge = edge.join(self._below("only", "x", "g", "prop", "v").select("x", "prop", "v").distinct(), ["x", "prop", "v"], "left_anti")
        edge = edge.join(named(self.attr, v="id", depth="depth"), "v", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
        deep = edge.filter(F.col("depth") >= self.max_depth)
        found = {"some_func": self._restriction("only", named(edge.filter(F.col("depth") < self.max_depth), x="x", prop="prop", value="v", depth="depth")), "func_refused": facts(deep, "refused", "x", p=F.lit(TOO_DEEP))}
        if self.has_inverse:
            # N's successor over a functional property is the M whose existential leads to N over its inverse: M is related back.
            some = self.f.all("some")
            there = named(some, m="s", r1="p", n="o").join(named(self.props, r1="s", i="o"), "r1").join(named(self.inverse, i="s", prop="o"), "i").join(named(self.functional, prop="s"), "prop", "left_semi")
            on = self._below("some", "n", "g", "r2", "w").select("n", "r2").distinct().join(named(self.props, r2="s", prop="o"), "r2").join(named(self.inverse, r2="s", back="o"), "r2")
            back = there.join(on, ["n", "prop"]).select(F.col("m").alias("x"), F.col("back").alias("prop"), F.col("n").alias("value")).distinct()
            back = back.join(named(self.attr, value="id", depth="depth"), "value", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
            found["some_func_inverse"] = self._restriction("some", back.filter(F.col("depth") < self.max_depth))
        return found

    def _existentials_of_cases(self) -> DataFrame:
        """Some P.V with V in cases of a told union is below the union of the cases' existentials."""
        cases = named(self.f.all("case"), value="s", u="p", k="o").join(named(self.told_ors, u="s"), "u", "left_semi")
        edge = named(self.f.all("some"), e="s", prop="p", value="o").join(cases, "value").select("e", "u", "prop", F.col("k").alias("value")).distinct()
        edge = edge.join(named(self.attr, value="id", depth="depth"), "value", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
        able = edge.groupBy("e", "u").agg(F.max("depth").alias("deepest"))
        edge = edge.join(able, ["e", "u"])
        deep, edge = edge.filter(F.col("deepest") >= self.max_depth), edge.filter(F.col("deepest") < self.max_depth)
        made = self._known("some", edge)
        several = made.groupBy("e", "u").agg(F.array_sort(F.collect_set("r")).alias("rs")).withColumn("w", F.when(F.size("rs") == 1, F.col("rs")[0]).otherwise(construct_id(list_text("or", F.col("rs")))))
        member = several.filter("size(rs) > 1").select("w", F.explode("rs").alias("r"))
        lists = [facts(member, "or", "w", "r"), facts(member, "case", "w", "r", "w"), facts(member, "sub", "r", "w"), facts(member, "sub", "w", "w"), facts(member, "sub", "w", TOP)]
        return union([*self._entered("some", made), *lists, facts(several, "sub", "e", "w"), facts(deep, "refused", "e", p=F.lit(TOO_DEEP))])
