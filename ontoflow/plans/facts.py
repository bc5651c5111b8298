"""The facts of a run: append-only rows (rel, s, p, o), a segment a round, in one folder that the run owns."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ontoflow.plans.storage import remove, shared_folder
from ontoflow.schema import empty

#: sub (s, o); some, only (s, property, value); and, or, not, disjoint, inverse (list, member); case (concept, union, case); attr (construct, depth, cases);
#: role (s, property, o) between individuals; concrete (s); individual (s); refused (s, which rule).
RELATIONS = ("sub", "some", "only", "and", "or", "not", "disjoint", "case", "attr", "role", "concrete", "individual", "refused")
FACT = ["rel", "s", "p", "o"]
SCHEMA = "s bigint, p bigint, o bigint"
SOURCES = "array<struct<rel:string,s:bigint,p:bigint,o:bigint>>"
#: Segments of a relation that are read side by side; more are written together first.
MOST_SEGMENTS = 16


def facts(df: DataFrame, rel: str, s, o=None, p=None, via: list[tuple] | Column | None = None) -> DataFrame:
    """Rows of a relation from columns of df. via: what they follow from, as (rel, s, p, o) of columns, or a column of such structs."""
    zero = F.lit(0).cast("bigint")
    as_id = lambda c: zero if c is None else (F.lit(c) if isinstance(c, int) else F.col(c) if isinstance(c, str) else c).cast("bigint")
    if via is None:
        sources = F.array().cast(SOURCES)
    elif isinstance(via, list):
        sources = F.array(*(F.struct(F.lit(v[0]).alias("rel"), *(as_id(c).alias(n) for c, n in zip(v[1:], ("s", "p", "o")))) for v in via))
    else:
        sources = via
    return df.select(F.lit(rel).alias("rel"), as_id(s).alias("s"), as_id(p).alias("p"), as_id(o).alias("o"), sources.cast(SOURCES).alias("sources"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class Facts:
    """Segments by relation. A round's new facts are one write; what no longer changes is never written again but to join small segments.

    explain keeps, beside each round's new facts, every way in which the round derived them.
    """

    def __init__(self, spark: SparkSession, explain: bool = False):
        self.spark, self.explain = spark, explain
        self.folder = f"{shared_folder(spark)}/facts-{uuid.uuid4().hex}"
        self.segments: dict[str, list[tuple[int, str]]] = {rel: [] for rel in RELATIONS}
        self.count = dict.fromkeys(RELATIONS, 0)
        self.last: dict[str, str] = {}
        self.ways: list[str] = []
        #: Tables that have been opened, by paths: a round reads the same ones many times.
        self.tables: dict[tuple[str, ...], DataFrame] = {}
        self.round, self.tops, self.bottoms = 0, 0, 0
        #: Told relations that nothing has read yet.
        self.told: dict[str, Callable[[], DataFrame]] = {}
        self.used: dict[str, list] = {}
        self.metrics: list[tuple[int, int, float]] = []

    def _read(self, paths: list[str]) -> DataFrame:
        key = tuple(paths)
        if key not in self.tables:
            if len(self.tables) > 200:
                self.tables.clear()
            self.tables[key] = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else empty(self.spark, SCHEMA)
        return self.tables[key]

    def tell(self, told: dict[str, Callable[[], DataFrame]], once: tuple[str, ...] = ()) -> None:
        """The first round, of told facts: a relation is made and written when it is first read. once: relations that have no row twice."""
        self.round, self.told, self.once = 1, dict(told), once
        self.last = {rel: f"{self.folder}/1/rel={rel}" for rel in told}
        self.tops = self.bottoms = 1  # unknown, so that no rule is left out

    def _open(self, rel: str) -> None:
        if rel in self.told:
            path = f"{self.folder}/1/rel={rel}"
            found = self.told.pop(rel)().select("s", "p", "o")
            (found if rel in self.once else found.distinct()).write.parquet(path)
            if not self._read([path]).isEmpty():
                self.segments[rel].append((1, path))

    def all(self, rel: str) -> DataFrame:
        """s, p, o of all facts of a relation."""
        self._open(rel)
        return self._read([path for _, path in self.segments[rel]])

    def new(self, rel: str) -> DataFrame | None:
        """Those that the last round added; None if it added none."""
        self._open(rel)
        return self._read([self.last[rel]]) if rel in self.last else None

    def since(self, rel: str, round_: int) -> DataFrame:
        """Those that rounds after round_ added (all, where they have been written together since)."""
        self._open(rel)
        return self._read([path for n, path in self.segments[rel] if n > round_])

    def has(self, rel: str) -> bool:
        self._open(rel)
        return bool(self.segments[rel])

    def add(self, found: dict[str, DataFrame], of: tuple[str, ...] = RELATIONS) -> bool:
        """Write what is new of the rules' results (rule -> facts of the relations ``of``); whether anything is."""
        begin = time.perf_counter()
        for rel in of:
            self._open(rel)
        self.round += 1
        rules = list(found)
        every = union([df.select(*FACT, *(["sources"] if self.explain else []), F.lit(name).alias("rule")) for name, df in found.items()])
        path = f"{self.folder}/{self.round}"
        if self.explain:
            every.write.parquet(f"{path}-found")
            every = self.spark.read.schema(every.schema).parquet(f"{path}-found")
        matched, hit = Observation(), Observation()
        named = lambda name: F.count(F.when(F.col("rule") == name, 1)).alias(name)
        seen = every if self.explain else every.observe(matched, *(named(r) for r in rules))
        new = seen.groupBy(*FACT).agg(F.min("rule").alias("rule"))
        old = [self.all(rel).select(F.lit(rel).alias("rel"), "s", "p", "o") for rel in of if self.segments[rel]]
        if old:
            new = new.join(union(old), FACT, "left_anti")
        one = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
        marks = [one(F.col("rel") == rel, f"rel_{rel}") for rel in RELATIONS]
        marks += [one((F.col("rel") == "sub") & (F.col("s") == 1) & (F.col("o") != 1), "tops"), one((F.col("rel") == "sub") & (F.col("o") == 2) & (F.col("s") != 2), "bottoms")]
        new = new.observe(hit, *marks, *(named(r) for r in rules))
        new.drop("rule").write.partitionBy("rel").parquet(path)
        got = hit.get
        self.tops, self.bottoms, self.last = got["tops"], got["bottoms"], {}
        for rel in RELATIONS:
            if got[f"rel_{rel}"]:
                self.last[rel] = f"{path}/rel={rel}"
                self.segments[rel].append((self.round, self.last[rel]))
                self.count[rel] += got[f"rel_{rel}"]
        if self.explain and self.last:
            kept = self.spark.read.parquet(path).select(*FACT)
            every.join(kept, FACT, "left_semi").distinct().write.parquet(f"{path}-ways")
            self.ways.append(f"{path}-ways")
            counts = {r["rule"]: r["count"] for r in every.groupBy("rule").count().collect()}  # a row for each rule
        for r in rules:
            use = self.used.setdefault(r, [0, 0, 0])
            use[0] += 1
            use[1] += (counts.get(r, 0) if self.last else 0) if self.explain else matched.get[r]
            use[2] += got[r]
        if self.explain:
            remove(self.spark, f"{path}-found")
        self.metrics.append((self.round, sum(got[f"rel_{rel}"] for rel in RELATIONS), round(time.perf_counter() - begin, 3)))
        return bool(self.last)

    def compact(self) -> None:
        """Write relations of many segments as one, so that reading them stays cheap."""
        for rel, paths in self.segments.items():
            if len(paths) > MOST_SEGMENTS:
                path = f"{self.folder}/{self.round}-{rel}"
                self.all(rel).repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "s").write.parquet(path)
                self.segments[rel] = [(self.round, path)]
                for n, p in paths:
                    if n < self.round:  # the last round's is still read as what is new
                        remove(self.spark, p)

    def derivations(self) -> DataFrame:
        """rel, s, p, o, sources, rule: each fact with every way in which the round that made it derived it."""
        if not self.ways:
            raise ValueError("a run without explain keeps no derivations")
        return self.spark.read.parquet(*self.ways)

    def close(self) -> None:
        """Remove all that the run wrote."""
        remove(self.spark, self.folder)
