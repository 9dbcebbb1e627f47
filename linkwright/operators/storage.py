"""Cutting lineage and keeping intermediate results where every executor can read them."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`.

    Only a local session may go without the setting (tests, a laptop): then a temporary folder
    is set once. On a cluster a machine-local folder would be lost with its executor, so a
    missing setting raises RuntimeError.
    """
    sc = spark.sparkContext
    held = sc.getCheckpointDir()
    if held:
        return held
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="linkwright-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """`df`, computed once and written as a table to the shared checkpoint folder; lineage ends there.

    A written table is compressed, is read by column, and survives the loss of any executor. Tables
    are removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/linkwright-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def merging(df: DataFrame) -> DataFrame:
    """`df` as a side of a join by sorting and merging, which no driver has to hold.

    Spark takes the rows an explode makes, and lists and maps, to be as small as the files they come from, and
    would broadcast tables of any size.
    """
    return df.hint("merge")


@contextmanager
def bloom_joins(spark: SparkSession) -> Iterator[None]:
    """Within, Spark may drop rows of a join's large side by a Bloom filter before they are shuffled, however small the scan is.

    The filter is made of a written table with a comparison on it, if Spark knows it to be below its own
    limit (creationSideThreshold); its bits are bounded by Spark as well. The session's setting is restored afterwards.
    """
    with _setting(spark, "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1b"):
        yield


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Within, stages of many expressions run as several small methods where one generated for all would be above 8000 bytes.

    The JVM never compiles a method of more than that, but interprets it row by row. Holds for what is written within.
    """
    with _setting(spark, "spark.sql.codegen.hugeMethodLimit", "8000"):
        yield


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may be gone; the folder's owner cleans up then
        pass
