"""Cutting lineage between the rounds of a loop."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see. Where it is unset, local mode gets one of its own; on a cluster that is an error, as executors don't share one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="ontoflow-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and lost executors repeat nothing before it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def grow(total: DataFrame, more: DataFrame) -> DataFrame:
    """total and more, settled in spark.sql.shuffle.partitions partitions at most: a loop's table mustn't gain partitions with every round."""
    return settle(total.union(more).coalesce(int(total.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data, wherever Spark keeps it."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
