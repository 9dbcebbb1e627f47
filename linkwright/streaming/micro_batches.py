"""Bounded reading of source folders: files arrive as micro-batches, each normalised and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkwright.config import LABEL_COLUMNS, SOURCE_COLUMNS
from linkwright.functions.text import na_to_null
from linkwright.operators.blocking import normalized


def source_stream(spark: SparkSession, folder: str, *, files_per_batch: int = 1) -> DataFrame:
    """A streaming table of the tab-separated source files in `folder`, missing texts as null."""
    return _stream(spark, folder, SOURCE_COLUMNS, files_per_batch)


def label_stream(spark: SparkSession, folder: str, *, files_per_batch: int = 1) -> DataFrame:
    """A streaming table of the label files in `folder`."""
    return _stream(spark, folder, LABEL_COLUMNS, files_per_batch)


def _stream(spark: SparkSession, folder: str, columns: tuple[str, ...], files_per_batch: int) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.readStream.schema(schema).options(sep="\t", header=True, escape='"', multiLine=True, maxFilesPerTrigger=files_per_batch).csv(folder)
    return rows.select(*[na_to_null(F.col(c)).alias(c) for c in columns])


def normalize_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, *, files_per_batch: int = 1) -> None:
    """Reads what is new in `folder`, appends its normalised rows to the parquet table `out`, and ends.

    Progress is kept in `checkpoint`; a second call reads only files that came since. Rows are
    independent of each other, so no state is held.
    """
    q = normalized(source_stream(spark, folder, files_per_batch=files_per_batch)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
