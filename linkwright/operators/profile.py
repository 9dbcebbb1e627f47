"""Profiling of sources and labels: one aggregation pass per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.functions.text import id_list, is_missing, strip

MISSING = "__MISSING__"


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_missing) for each column, in one pass."""
    one = df.agg(*[F.count_if(is_missing(F.col(c))).alias(c) for c in columns])
    return one.unpivot([], columns, "column_name", "n_missing")


def source_profile(df: DataFrame, prefix: str) -> DataFrame:
    """Rows, distinct ids, repeats, ids without the prefix, distinct countries, names and addresses.

    Null ids, names and addresses count as the value ''; a missing country is no country.
    """
    full = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = df.agg(F.lit(1).alias("one"), F.count("*").alias("n_rows"), F.count_if(~full("entity_id").startswith(prefix)).alias("n_prefix_mismatch"))
    country = F.when(~is_missing(F.col("country")), strip(F.col("country")))
    per = {"n_unique_ids": full("entity_id"), "n_countries": country, "n_names": full("business_name"), "n_addresses": full("business_address")}
    # All columns at once, each value as 128 bits of hash: what is exchanged is small, whatever the texts.
    marks = F.array(*[F.when(c.isNotNull(), F.struct(F.lit(i).alias("i"), F.xxhash64(c).alias("a"), F.xxhash64(F.lit(i), c).alias("b"))) for i, c in enumerate(per.values())])
    values = df.select(F.explode(marks).alias("v")).filter("v is not null").groupBy("v.i", "v.a", "v.b").agg(F.lit(1).alias("one"))
    counts = values.groupBy("one").agg(*[F.count_if(F.col("i") == i).alias(name) for i, name in enumerate(per)])
    both = rows.join(counts, "one", "left").na.fill(0)
    return both.select("n_rows", "n_unique_ids", (F.col("n_rows") - F.col("n_unique_ids")).alias("n_duplicate_ids"), "n_prefix_mismatch", "n_countries", "n_names", "n_addresses")


def _distinct(df: DataFrame, c: Column, name: str) -> DataFrame:
    """One row: the number of distinct values that are not null. Texts travel as 128 bits of hash."""
    bits = F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(name), c).alias("b"))
    return df.filter(c.isNotNull()).select(bits.alias("v")).groupBy("v").agg(F.lit(1).alias("one")).agg(F.lit(1).alias("one"), F.count("*").alias(name))


def duplicate_ids(df: DataFrame, examples: int = 10) -> DataFrame:
    """(entity_id, n_rows) of the ids that come most often more than once; ties by id."""
    return df.groupBy("entity_id").agg(F.count("*").alias("n_rows")).filter("n_rows > 1").orderBy(F.desc("n_rows"), "entity_id").limit(examples)


def country_histogram(df: DataFrame) -> DataFrame:
    """(country, n_rows); missing ones under one mark."""
    c = F.when(is_missing(F.col("country")), F.lit(MISSING)).otherwise(strip(F.col("country")))
    return df.groupBy(c.alias("country")).agg(F.count("*").alias("n_rows"))


def label_profile(labels: DataFrame) -> DataFrame:
    """Counts over the label lists as delivered: repeats within and across lists included."""
    ids = id_list(F.col("matched_entity_ids"))
    x = labels.select(F.coalesce("source1_entity_id", F.lit("")).alias("s1"), ids.alias("ids"))
    flat = x.select(
        "s1",
        F.size("ids").alias("n"),
        (F.size("ids") != F.size(F.array_distinct("ids"))).alias("dup"),
        F.size(F.filter("ids", lambda i: i.startswith("S2-"))).alias("n2"),
        F.size(F.filter("ids", lambda i: i.startswith("S3-"))).alias("n3"),
    )
    rows = flat.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("s1").alias("n_source1"),
        (F.count("*") - F.countDistinct("s1")).alias("n_duplicate_rows"),
        F.count_if(F.col("n") == 0).alias("n_zero"),
        F.count_if(F.col("n") > 0).alias("n_some"),
        F.sum("n").alias("n_matched"),
        F.round(F.avg("n"), 6).alias("mean_matches"),
        F.sum("n2").alias("n_s2"),
        F.sum("n3").alias("n_s3"),
        F.sum(F.col("n") - F.col("n2") - F.col("n3")).alias("n_other"),
        F.count_if("dup").alias("n_lists_with_repeats"),
    )
    return rows.withColumn("one", F.lit(1)).join(_distinct(x.select(F.explode("ids").alias("id")), F.col("id"), "n_distinct_matched"), "one").drop("one")


def match_histogram(labels: DataFrame) -> DataFrame:
    """(n_matches, n_rows) over list lengths, repeats counted."""
    return labels.groupBy(F.size(id_list(F.col("matched_entity_ids"))).alias("n_matches")).agg(F.count("*").alias("n_rows"))


def id_coverage(source1: DataFrame, labels: DataFrame, examples: int = 5) -> DataFrame:
    """(side, n_ids, sample_ids): ids of one table that the other lacks, with the smallest few."""
    a = source1.select(F.col("entity_id").alias("id")).distinct()
    b = labels.select(F.col("source1_entity_id").alias("id")).distinct()
    out = None
    for side, x, y in (("only_source1", a, b), ("only_labels", b, a)):
        missing = x.join(y, "id", "left_anti")
        count = missing.agg(F.count("*").alias("n_ids")).withColumn("side", F.lit(side))
        few = missing.orderBy("id").limit(examples).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("sample_ids")).withColumn("side", F.lit(side))
        one = count.join(few, "side").select("side", "n_ids", "sample_ids")
        out = one if out is None else out.unionByName(one)
    return out


def cartesian_size(source1: DataFrame, *others: DataFrame) -> int:
    """Number of pairs that a full comparison would need; counts only."""
    return source1.count() * sum(o.count() for o in others)


def sample_rows(df: DataFrame, n: int = 3) -> DataFrame:
    """The first `n` rows by id, nulls as ''; a bounded top-n, no full sort."""
    cols = ["entity_id", "business_name", "business_address", "country"]
    return df.select(*[F.when(is_missing(F.col(c)), F.lit("")).otherwise(F.col(c)).alias(c) for c in cols]).orderBy(*cols).limit(n)
