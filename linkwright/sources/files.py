"""Small files and folders on any file system that Spark knows: local, shared or an object store."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(path: str):
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(path: str) -> bool:
    fs, p = _at(path)
    return fs.exists(p)


def read_text(path: str) -> str:
    """A small UTF-8 file."""
    fs, p = _at(path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    fs, p = _at(path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def replace(new: str, path: str) -> None:
    """Puts the folder `new` in the place of `path`, which may exist."""
    fs, p = _at(path)
    _, n = _at(new)
    fs.delete(p, True)
    if not fs.rename(n, p):
        raise OSError(f"cannot move {new} to {path}")
