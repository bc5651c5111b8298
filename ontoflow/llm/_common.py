"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES, _BATCH = 16_000_000, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can see. Where none is configured, local mode (tests) gets one of its own; on a cluster that is an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="ontoflow-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint: partitions become stable and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def map_batches(df: DataFrame, function: Callable, schema) -> DataFrame:
    """df.mapInArrow(function, schema) with batches of BATCH_BYTES at most, and memory given back after each task.

    Workers serve many tasks, next to the heap of their executor: what one task no longer needs must not stay with the next.
    """
    conf = df.sparkSession.conf
    size = conf.get(_BATCH, "64m").lower().rstrip("b")
    if int(size.rstrip("kmg") or 0) << {"k": 10, "m": 20, "g": 30}.get(size[-1:], 0) > BATCH_BYTES:
        conf.set(_BATCH, f"{BATCH_BYTES}b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data, wherever Spark keeps it."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def ascii_lower(col):
    """Lower-case A-Z only; every other character stays as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
