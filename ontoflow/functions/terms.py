"""Column functions: ids of constructs from their structure, and names of entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def construct_id(text: Column) -> Column:
    """A negative id from a construct's canonical text; the same in every run and engine (60 bits of its MD5)."""
    return -F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def restriction_text(kind: str, prop: Column, value: Column) -> Column:
    return F.concat_ws("|", F.lit(kind), prop.cast("string"), value.cast("string"))


def list_text(kind: str, operands: Column) -> Column:
    """The canonical text of a list: its sorted distinct operands."""
    return F.concat(F.lit(f"{kind}|"), F.array_join(F.array_sort(F.array_distinct(operands)), ","))


def short_name(iri: Column) -> Column:
    """What follows the last # or /, if anything does."""
    tail = F.substring_index(F.substring_index(iri, "#", -1), "/", -1)
    return F.when(tail == "", iri).otherwise(tail)
