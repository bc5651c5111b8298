"""Relations of a knowledge base: narrow tables of integer ids.

Ids above zero are named entities; constructs have negative ids that follow from their structure.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

TOP, BOTTOM = 1, 2

SCHEMAS: dict[str, str] = {
    "is_a": "s bigint, o bigint",  # asserted subclass and instance edges
    "equivalent": "s bigint, o bigint",
    "prop_is_a": "s bigint, o bigint",
    "some": "s bigint, prop bigint, value bigint",
    "only": "s bigint, prop bigint, value bigint",
    "cardinality": "s bigint, kind string, card int, prop bigint, value bigint",  # min, max, exactly: stored, not reasoned on
    "data_value": "s bigint, prop bigint, value string, datatype string",
    "list_member": "kind string, s bigint, o bigint",  # kinds: and, or, disjoint, not, inverse
    "types": "s bigint, kind string",
    "domain_range": "kind string, p bigint, c bigint",
    "role": "s bigint, p bigint, o bigint",  # individual s is related over p to individual o
    "entity": "id bigint, name string",
}

#: The metatypes that an import keeps.
KINDS = ("Class", "NamedIndividual", "ObjectProperty", "DatatypeProperty", "FunctionalProperty", "TransitiveProperty")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, which Spark's optimizer sees: joins with them and their part of a union aren't planned."""
    return spark.sql("SELECT " + ", ".join("CAST(NULL AS {1}) AS {0}".format(*column.split()) for column in schema.split(", ")) + " WHERE false")


@dataclass(frozen=True)
class KB:
    """A knowledge base: one DataFrame for each relation of SCHEMAS."""

    spark: SparkSession
    is_a: DataFrame
    equivalent: DataFrame
    prop_is_a: DataFrame
    some: DataFrame
    only: DataFrame
    cardinality: DataFrame
    data_value: DataFrame
    list_member: DataFrame
    types: DataFrame
    domain_range: DataFrame
    role: DataFrame
    entity: DataFrame

    @staticmethod
    def of(spark: SparkSession, **relations: DataFrame | Iterable) -> KB:
        """From DataFrames or lists of rows; relations left out are empty."""
        frames = {}
        for name, schema in SCHEMAS.items():
            rows = relations.pop(name, [])
            frames[name] = rows if isinstance(rows, DataFrame) else spark.createDataFrame(list(rows), schema) if rows else empty(spark, schema)
        if relations:
            raise ValueError(f"no such relations: {sorted(relations)}")
        return KB(spark, **frames)

    def relations(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "spark"}

    def with_(self, **frames: DataFrame) -> KB:
        return replace(self, **frames)

    def write(self, path: str) -> None:
        """A Parquet table for each relation."""
        for name, df in self.relations().items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def read(spark: SparkSession, path: str) -> KB:
        return KB(spark, **{n: spark.read.schema(s).parquet(f"{path}/{n}") for n, s in SCHEMAS.items()})
