"""Reading triples and turning them into relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoflow.operators.closure import transitive_closure
from ontoflow.schema import KINDS

# The vocabulary's namespaces.
RDF, RDFS, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o, datatype, is_literal from N-Triples text; comments and blank lines are left out, other malformed lines give null columns."""
    pattern = r"^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|\"(?:[^\"\\]|\\.)*\"(?:@\S+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$"
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda k: F.nullif(F.regexp_extract("value", pattern, k), F.lit(""))
    bare = lambda c: F.regexp_replace(c, r"^<|>$", "")
    o = part(3)
    literal = o.startswith('"')
    return lines.select(bare(part(1)).alias("s"), part(2).alias("p"), F.when(literal, F.regexp_extract(o, r'(?s)^"((?:[^"\\]|\\.)*)"', 1)).otherwise(bare(o)).alias("o"), F.when(literal, F.nullif(F.regexp_extract(o, r"\^\^<([^>]*)>$", 1), F.lit(""))).alias("datatype"), literal.alias("is_literal"))


def term_id(term) -> F.Column:
    """An id for a term: positive for an IRI, negative for a blank node (60 bits of the MD5)."""
    h = F.conv(F.substring(F.md5(term), 1, 15), 16, 10).cast("bigint")
    return F.when(term.startswith("_:"), -h).otherwise(h)


def imported_types(triples: DataFrame) -> DataFrame:
    """s, kind: rdf:type edges to the metatypes that matter (triples s, p, o as text)."""
    t = triples.filter(F.col("p") == RDF + "type").filter(F.col("o").isin(*[OWL + k for k in KINDS]))
    return t.select(term_id(F.col("s")).alias("s"), F.replace(F.col("o"), F.lit(OWL)).alias("kind")).distinct()


def imported_is_a(triples: DataFrame) -> DataFrame:
    """s, o: subclass edges, and type edges of named individuals but that to the metatype itself."""
    people = triples.filter((F.col("p") == RDF + "type") & (F.col("o") == OWL + "NamedIndividual")).select("s")
    kinds = triples.filter((F.col("p") == RDF + "type") & (F.col("o") != OWL + "NamedIndividual")).join(people, "s", "left_semi")
    told = triples.filter(F.col("p") == RDFS + "subClassOf").select("s", "o").union(kinds.select("s", "o"))
    return told.select(term_id(F.col("s")).alias("s"), term_id(F.col("o")).alias("o")).distinct()


def list_members(heads: DataFrame, first: DataFrame, rest: DataFrame) -> DataFrame:
    """list, member: members of RDF lists; heads (list, head), first (cell, first), rest (cell, rest). Cycles end; repeats count once."""
    cells = heads.select("list", F.col("head").alias("cell"))
    onward = transitive_closure(rest.select(F.col("cell").alias("s"), F.col("rest").alias("o")))
    all_ = cells.union(cells.join(onward, F.col("cell") == F.col("s")).select("list", F.col("o").alias("cell")))
    return all_.join(first, "cell").select("list", F.col("first").alias("member")).distinct()
