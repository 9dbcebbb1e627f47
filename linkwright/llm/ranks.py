"""Running numbers and totals within classes of any size, without one task per class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_sums(df: DataFrame, cls: list[str], order: list[Column], amounts: dict[str, Column], *, bucket: Column) -> DataFrame:
    """`df` with, per entry of `amounts`, the sum over the rows of its class that come before the row.

    Rows of a class are taken bucket by bucket (`bucket`: an int that spreads them) and by `order`
    within a bucket. Buckets are summed first; their running totals, a table of classes times buckets,
    are joined back. A class of any size is thus worked on by as many tasks as it has buckets.
    """
    names = list(amounts)
    b = df.withColumn("__b", bucket).withColumns({f"__a_{k}": v for k, v in amounts.items()})
    sums = b.groupBy(*cls, "__b").agg(*[F.sum(f"__a_{k}").alias(f"__s_{k}") for k in names])
    over = Window.partitionBy(*cls).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*cls, "__b", *[F.coalesce(F.sum(f"__s_{k}").over(over), F.lit(0)).alias(f"__o_{k}") for k in names])
    within = Window.partitionBy(*cls, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = b.withColumns({f"__l_{k}": F.coalesce(F.sum(f"__a_{k}").over(within), F.lit(0)) for k in names})
    out = local.join(starts, [*cls, "__b"])
    return out.withColumns({k: F.col(f"__o_{k}") + F.col(f"__l_{k}") for k in names}).drop("__b", *[f"__{x}_{k}" for x in "aol" for k in names])
