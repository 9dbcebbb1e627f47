"""Tab-separated source and label files: reading, schema checks, writing.

Read policy: every column a string; quotes are doubled inside quotes, fields may span lines; texts
that stand for nothing become null; rows with too many fields are dropped (`surplus_rows` counts them), short
rows are filled with nulls. A file is split among tasks unless one of its fields spans lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkwright.config import LABEL_COLUMNS, PREFIX, SOURCE_COLUMNS
from linkwright.functions.text import na_to_null
from linkwright.sources import files

_EXTRA = "_extra"


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether a field holds a line end: then some line has an odd number of quotes. Stops at the first."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def _raw(spark: SparkSession, path: str, columns: tuple[str, ...], multiline: bool | None) -> tuple[DataFrame, list[str]]:
    header = header_of(spark, path)
    if header is None:
        raise FileNotFoundError(path)
    names = [h.strip() for h in header.split("\t")]
    lacking = set(columns) - set(names)
    if lacking:
        raise ValueError(f"{path}: missing columns {sorted(lacking)}")
    # One more column than the header has: it is filled only where a row is too long.
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _EXTRA]])
    whole = spans_lines(spark, path) if multiline is None else multiline
    return spark.read.schema(schema).options(sep="\t", header=True, escape='"', multiLine=whole, mode="PERMISSIVE", enforceSchema=True).csv(path), names


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...], *, multiline: bool | None = None) -> DataFrame:
    """The file's rows under the policy above, columns by header name.

    ValueError if the header lacks one of `columns`; other columns are tolerated and kept.
    FileNotFoundError if there is no file. multiline: whether fields span lines, in which case one task
    reads the file; by default the file is looked through for it.
    """
    df, names = _raw(spark, path, columns, multiline)
    return df.filter(F.col(_EXTRA).isNull()).select(*[na_to_null(F.col(n)).alias(n) for n in names])


def surplus_rows(spark: SparkSession, path: str, columns: tuple[str, ...], *, multiline: bool | None = None) -> int:
    """How many rows `read_tsv` drops because they have too many fields."""
    return _raw(spark, path, columns, multiline)[0].filter(F.col(_EXTRA).isNotNull()).count()


def read_source(spark: SparkSession, path: str, *, columns: tuple[str, ...] | None = None, multiline: bool | None = None) -> DataFrame:
    """A source file; `columns` prunes after the check that all required ones exist."""
    df = read_tsv(spark, path, SOURCE_COLUMNS, multiline=multiline)
    return df.select(*columns) if columns else df


def read_labels(spark: SparkSession, path: str, *, multiline: bool | None = None) -> DataFrame:
    """A label file."""
    return read_tsv(spark, path, LABEL_COLUMNS, multiline=multiline)


def header_of(spark: SparkSession, path: str) -> str | None:
    """First line of the file; None if there is no file, '' if it is empty."""
    if not files.exists(path):
        return None
    first = spark.read.text(path).limit(1).collect()
    return (first[0]["value"] or "") if first else ""


def header_issues(spark: SparkSession, path: str, expected: tuple[str, ...]) -> list[str]:
    """What is wrong with the file's header, which must have exactly the expected columns in order."""
    header = header_of(spark, path)
    if header is None:
        return [f"file not found: {path}"]
    if not header:
        return [f"{path}: empty file"]
    if "\t" not in header and "," in header:
        return [f"{path}: separated by commas, not by tabs"]
    names = tuple(h.strip() for h in header.split("\t"))
    return [] if names == tuple(expected) else [f"{path}: header {list(names)}, expected {list(expected)}"]


def source_issues(spark: SparkSession, path: str, source: str) -> list[str]:
    """Header issues of a source file; an unknown source is an issue as well."""
    return header_issues(spark, path, SOURCE_COLUMNS) if source in PREFIX else [f"unknown source {source!r}"]


def label_issues(spark: SparkSession, path: str) -> list[str]:
    return header_issues(spark, path, LABEL_COLUMNS)


def write_tsv(df: DataFrame, path: str) -> None:
    """A folder of tab-separated files with header; empty strings stay empty, nothing is quoted."""
    df.write.mode("overwrite").options(sep="\t", header=True, emptyValue="", nullValue="", quote="\u0000").csv(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(entity_id): distinct first fields of a file, header and blank lines left out."""
    header = header_of(spark, path)
    lines = spark.read.text(path).filter((F.col("value") != header) & (F.trim("value") != ""))
    return lines.select(F.trim(F.split("value", "\t", 2)[0]).alias("entity_id")).filter("entity_id <> ''").distinct()
