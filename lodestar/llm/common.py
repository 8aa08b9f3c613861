"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.layout import spread

#: Bytes that end a word; bytes.split() splits at exactly these.
WHITE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def raw(text: Column | str) -> Column:
    """UTF-8 bytes of a text, so that tasks get bytes without a detour over str; null becomes empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column, F.lit("")).cast("binary")


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only in local mode, where all tasks share this machine's disk."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def utf8(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about most_bytes in a binary column each, so that memory doesn't follow the batch's size."""
    array = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(array), 0), np.int64)
    if not len(sizes):
        return
    part = (np.cumsum(sizes) - sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blas_single_thread() -> None:
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        os.environ.setdefault(name, "1")


def new_path(spark: SparkSession) -> str:
    """A path of its own in the shared checkpoint folder. All of an application's tables lie in one folder there, to be
    removed with it: a lazy result may be read as long as its session lives."""
    return f"{checkpoint_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the cluster's shared checkpoint folder: cuts the lineage, and each row is computed once.

    path: one to write over, by steps that need no more than their predecessor's table.
    """
    spark = df.sparkSession
    path = path or new_path(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def emptied(spark: SparkSession, path: str) -> None:
    """Frees a written table's space, once nothing reads it any more."""
    spark.range(0).write.mode("overwrite").parquet(path)


#: Bytes of rows that go to a Python worker at once. A batch lies in the JVM twice, outside of its heap, and in the worker again,
#: and its buffers double as they grow: Spark's 64 MB make a whole split of a table one batch.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(spark: SparkSession) -> None:
    """Limits Arrow batches to BATCH_BYTES (and one row) in this session. It stays, as Spark reads it when a result is planned;
    no result depends on it."""
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)


#: A table of totals with no more rows than this is small enough to be sent to every task, whatever it was summed from.
MOST_SENT = 50_000
SALTS = 64


def joined_totals(rows: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """rows with the columns of totals, which has one row for each key of rows, null included.

    The number of totals is counted first. Up to MOST_SENT they are broadcast; beyond, rows are dealt out by key and a salt,
    and totals are repeated for each salt, so that a key with a third of all rows is many tasks' work.
    """
    totals = written(totals)
    named = totals.select(F.col(key).alias("__total_key"), *(x for x in totals.columns if x != key))
    if totals.count() <= MOST_SENT:
        return rows.join(F.broadcast(named), F.col(key).eqNullSafe(F.col("__total_key"))).drop("__total_key")
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*(x for x in rows.columns if x != key)), F.lit(SALTS)))
    many = named.withColumn("__total_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = salted.join(many, F.col(key).eqNullSafe(F.col("__total_key")) & (F.col("__salt") == F.col("__total_salt")))
    return met.drop("__total_key", "__salt", "__total_salt")
