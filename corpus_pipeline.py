"""The corpus pipeline: five stages over ``documents``, each a training-data operator at work on all that its predecessor kept."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoflow.llm import decontaminate, language, lines, packing, simhash
from ontoflow.llm._common import remove, shared_dir, table


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keeping(stage: Callable) -> Callable:
    """The stage, with columns beyond those of documents kept aside under names that nothing clashes with."""

    @functools.wraps(stage)
    def kept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in COLUMNS else f"_extra{k}" for k, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), sf_dir)
        return out.select(*[F.col(n).alias(c) for c, n in names.items()])

    return kept


# Each stage takes rows with any nulls, equal ids, repeated rows and more columns, and an empty table, for which it gives an empty result; all but
# the last keep the columns as they are, whatever their names.


@keeping
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language (a null text, or one without letters); a missing lang becomes the predicted one. Repeated rows fare alike.

    Where no text has a lang, no language can be told, and every document goes.
    """
    known = language.annotate(docs).filter(F.col("lang_pred") != language.UNKNOWN)
    return known.withColumn("lang", F.coalesce("lang", "lang_pred"))


@keeping
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete blocks of lines that an earlier document has; a document that loses every line goes.

    Rows with a null id or text stay as they are. Rows of equal ids and texts are one document; of different texts with equal ids one counts as the later.
    """
    out = lines.line_dedup(docs).filter("n_cut is null or n_cut = 0 or n_cut < n_lines")
    n_chars = F.when(F.col("n_cut") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars)


@keeping
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links join (five-word shingles, a Jaccard similarity of 0.8 or more) the document of the least id stays."""
    return simhash.keep_one(docs)


@keeping
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more is text of the benchmark, each by its own text; rows with a null text stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences of 1024; a null text is one piece that holds the end token alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None  # learned models, XXH64 fingerprints and BPE are beyond SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet into the shared folder and read again, and removed once the next one is written."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
