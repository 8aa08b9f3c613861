"""How a table's rows lie on the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame, idle: int = 4) -> DataFrame:
    """df dealt out anew if it is read in so few tasks that most cores would stand idle, as for a table in one small file.

    A table with as many splits as a quarter of the cores, and so any large one, is left as it lies: no shuffle is added.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * idle <= cores else df


def shared_folder(spark: SparkSession) -> str:
    """A new path below the cluster's spark.checkpoint.dir; below a temporary folder only in local mode, where all tasks share
    this machine's disk. All of an application's tables lie in one folder there, to be removed with it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return f"{context.getCheckpointDir()}/{context.applicationId}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table that all executors share: made once, whatever is derived from it, and a lost executor costs
    none of it."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
