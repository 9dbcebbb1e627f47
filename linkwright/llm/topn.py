"""Top N items within every group, by two-stage salted ranking."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwright.operators.storage import durable


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, *, subgroups: int | None = None) -> DataFrame:
    """(group, item, score, rank): the `n` best items of each group, rank 1 first.

    A pair of group and item counts once, with its highest score. Null and NaN are no scores:
    a pair that has no other is left out, as are rows with a null group or item. Among equal scores
    the smaller item (by code point) is better, so the result never varies. Groups with fewer items
    give fewer rows; an empty table gives none. Other columns of `df` are not read.

    Groups that hold more than 1/`subgroups` of the rows are hashed by item into subgroups of
    about that size; each subgroup keeps its own `n` best, and the survivors are ranked again by
    group. There are fewer than `subgroups` such groups, which bounds what is broadcast. All other
    groups are one subgroup. The one large exchange is by (group, subgroup); repeated pairs meet
    there, and ranking needs no further exchange of the rows.
    """
    parts = subgroups or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(df[group].alias("g"), df[item].alias("i"), df[score].cast("double").alias("s"))
    rows = rows.filter(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
    # One count per group gives both the number of rows and the heavy groups.
    sizes = durable(df.select(df[group].alias("g")).groupBy("g").count())
    share = max(1, math.ceil((sizes.agg(F.sum("count").alias("n")).collect()[0]["n"] or 0) / parts))
    heavy = sizes.filter(F.col("count") > share).select("g", F.ceil(F.col("count") / share).cast("int").alias("pieces"))
    salted = rows.join(F.broadcast(heavy), "g", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("i"), F.col("pieces")), F.lit(0)).cast("int"))
    placed = salted.select("g", "salt", "i", "s").repartition("g", "salt")
    once = placed.groupBy("g", "salt", "i").agg(F.max("s").alias("s"))
    best = [F.col("s").desc(), F.col("i").asc()]
    first = once.withColumn("r", F.row_number().over(Window.partitionBy("g", "salt").orderBy(*best))).filter(F.col("r") <= n)
    last = first.select("g", "i", "s").withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*best))).filter(F.col("rank") <= n)
    return last.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")
