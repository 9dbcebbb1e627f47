"""Splits that keep related records together: distributed union-find, then greedy assignment."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.ranks import prefix_sums
from linkwright.operators.storage import durable

EDGES_PER_TASK = 1_000_000
#: Groups of one size that are numbered in one task, about.
GROUPS_PER_BUCKET = 100_000


#: Edges that a task holds as Python objects before it reduces them to a forest.
EDGES_AT_ONCE = 200_000


def local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over one partition's edges (a, b): (node, root) of each node that is not its own root.

    Edges are taken in some at once; what is held beyond them is the forest so far, one row per node.
    """
    forest, held, n = pd.DataFrame({"node": [], "root": []}), [], 0
    for b in batches:
        held.append(b[["a", "b"]])
        n += len(b)
        if n >= EDGES_AT_ONCE:
            forest, held, n = _grown(forest, held), [], 0
    if held:
        forest = _grown(forest, held)
    if len(forest):
        yield forest


def _grown(forest: pd.DataFrame, edges: list[pd.DataFrame]) -> pd.DataFrame:
    """The forest of `forest` and the edges together; roots are the smallest nodes."""
    e = pd.concat([*edges, forest.rename(columns={"node": "a", "root": "b"})], ignore_index=True)
    codes, names = pd.factorize(np.concatenate([e["a"].to_numpy(object), e["b"].to_numpy(object)]), sort=True)
    u, v = codes[: len(e)], codes[len(e) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while not np.array_equal(up := root[root], root):
            root = up
        if np.array_equal(before, root):
            break
    child = np.flatnonzero(root != np.arange(len(names)))
    return pd.DataFrame({"node": names[child], "root": names[root[child]]})


def components(edges: DataFrame, a: str, b: str, *, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(node, root) of every node that is connected to a smaller one; root is the smallest it reaches.

    Edges with a null end and loops say nothing. Local forests are built over the partitions as they
    lie, before anything is shuffled; each has at most one edge per node. As long as the forests
    together exceed `edges_per_task`, they are merged level by level: every node points its
    roots (one per partition at most) to the smallest of them, and new local forests are built of
    that, nodes taking over the root of their root on the way. What is left then fits one task by
    that bound, or no root has a root and every node one: then the forests are the result. Every level ends in a checkpoint.
    """
    e = edges.select(edges[a].cast("string").alias("a"), edges[b].cast("string").alias("b")).filter("a is not null and b is not null and a <> b")
    forest = durable(e.mapInPandas(local_forest, "node string, root string"))
    while True:
        n = forest.count()
        if n <= edges_per_task:
            last = forest.select(F.col("root").alias("a"), F.col("node").alias("b")).repartition(1)
            return last.mapInPandas(local_forest, "node string, root string")
        low = forest.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        roots = forest.select(F.col("root").alias("node")).distinct()
        if low.filter("low <> high").isEmpty() and low.join(roots, "node", "left_semi").isEmpty():
            return forest.distinct()
        # Of its roots a node takes the smallest, and of that one its own smallest root in turn.
        above = low.select(F.col("node").alias("low"), F.col("low").alias("top"))
        up = forest.join(low.drop("high"), "node").join(above, "low", "left").withColumn("top", F.coalesce("top", "low"))
        star = up.select(F.col("top").alias("a"), F.explode(F.array("node", "root", "low")).alias("b")).filter("a <> b").distinct()
        parts = max(1, math.ceil(n / edges_per_task))
        forest = durable(star.repartition(parts, "b").mapInPandas(local_forest, "node string, root string"))


def related_groups(df: DataFrame, record: str, link: str) -> DataFrame:
    """(record, first): every distinct record with the smallest record it is related to, itself included.

    df: one row per record and link value. Records that share a value are related, directly or
    through others. Records whose only link is null stand alone; null records are ignored.
    """
    nodes = df.select(df[record].alias("r"), df[link].alias("l")).filter(F.col("r").isNotNull())
    # Prefixes keep records and link values apart and let records sort first, so that roots are records.
    marked = nodes.select(F.concat(F.lit("0"), "r").alias("a"), F.concat(F.lit("1"), "l").alias("b"))
    c = components(marked, "a", "b").filter(F.col("node").startswith("0"))
    named = c.select(F.substring("node", 2, 1 << 30).alias("r"), F.substring("root", 2, 1 << 30).alias("first"))
    return nodes.select("r").distinct().join(named, "r", "left").select(F.col("r").alias(record), F.coalesce("first", "r").alias("first"))


def greedy_counts(sizes: list[tuple[int, int]], targets: list[float]) -> list[list[int]]:
    """How many groups of each size go to each split, largest size first.

    sizes: (size, number of groups), descending. Each group goes to the split furthest below its
    target (the first of equals). Groups of one size are interchangeable, so a whole size is placed
    at once: with n items of size s the largest deficits are lowered to one common level.
    """
    total = sum(s * c for s, c in sizes)
    deficit = [t * total for t in targets]
    out = []
    for s, c in sizes:
        low, high = min(deficit) - s * c - s, max(deficit)

        def taken(level: float) -> list[int]:
            return [max(0, math.ceil((d - level) / s)) for d in deficit]

        for _ in range(200):
            mid = (low + high) / 2
            if sum(taken(mid)) > c:
                low = mid
            else:
                high = mid
        got = taken(high)
        for _ in range(c - sum(got)):  # ties at the level: fewer than there are splits
            k = max(range(len(deficit)), key=lambda j: (deficit[j] - got[j] * s, -j))
            got[k] += 1
        deficit = [d - g * s for d, g in zip(deficit, got)]
        out.append(got)
    return out


def assign_splits(groups: DataFrame, record: str, splits: DataFrame) -> DataFrame:
    """(record, first, split_name) for `groups` (record, first) and `splits` (split_name, target_share).

    Only the histogram of group sizes reaches the driver: N records have fewer than sqrt(2 N)
    different group sizes. Groups of a size are numbered by hash in buckets and take their split by number.
    Shares are taken relative to their sum; a null or negative share counts as 0.
    """
    spark = groups.sparkSession
    sized = durable(groups.groupBy("first").agg(F.count("*").alias("size")))
    hist = [(r["size"], r["c"]) for r in sized.groupBy("size").agg(F.count("*").alias("c")).orderBy(F.desc("size")).collect()]
    named = sorted((r["split_name"], max(0.0, r["target_share"] or 0.0)) for r in splits.select("split_name", "target_share").collect())
    named.sort(key=lambda x: (-x[1], x[0]))
    whole = sum(t for _, t in named) or 1.0
    counts = greedy_counts(hist, [t / whole for _, t in named])
    ranges = []
    for (size, _), got in zip(hist, counts):
        at = 0
        for (name, _), k in zip(named, got):
            if k:
                ranges.append((size, at, at + k, name))
            at += k
    table = spark.createDataFrame(ranges, "size long, low long, high long, split_name string")
    buckets = max(64, sum(c for _, c in hist) // GROUPS_PER_BUCKET)
    numbered = prefix_sums(sized, ["size"], [F.xxhash64("first"), F.col("first")], {"number": F.lit(1)}, bucket=F.pmod(F.xxhash64("first"), F.lit(buckets)).cast("int"))
    placed = numbered.join(F.broadcast(table), "size").filter("number >= low and number < high").select("first", "split_name")
    return groups.join(placed, "first").select(record, "first", "split_name")
