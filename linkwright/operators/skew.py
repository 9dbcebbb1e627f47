"""Results per key when a handful of keys hold most rows.

Rows are range-partitioned on (key, secondary order) with sampled quantiles. The quantiles are
taken over the pair, so a key with many rows spans several partitions of about equal size instead
of one. Every partition folds its sorted rows into one small state per key; only keys
at partition boundaries have more than one, and these are stitched in partition order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.operators.storage import durable

_NONE = np.iinfo(np.int64).min
_STATE = "key string, part int, seq long, n long, first_ord long, last_ord long, max_gap long"


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """States of each run of equal keys in a sorted partition; the last run stays open over batches."""
    part, seq = TaskContext.get().partitionId(), 0
    open_: dict | None = None
    for b in batches:
        if not len(b):
            continue
        keys = b["key"].to_numpy(object)
        null = b["key"].isna().to_numpy()
        keys[null] = None
        order = b["ord"].fillna(_NONE).to_numpy(np.int64) if b["ord"].isna().any() else b["ord"].to_numpy(np.int64)
        new = np.empty(len(b), bool)
        new[0] = True
        new[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        ends = np.append(at[1:], len(b))
        real = order != _NONE
        gap = np.zeros(len(b), np.int64)
        gap[1:] = np.where(~new[1:] & real[1:] & real[:-1], order[1:] - order[:-1], 0)
        some = np.logical_or.reduceat(real, at)
        # orders ascend within a key, nulls first
        lows = np.where(real, order, np.iinfo(np.int64).max)
        out = pd.DataFrame({"key": keys[at], "n": ends - at, "first_ord": np.where(some, np.minimum.reduceat(lows, at), _NONE), "last_ord": np.maximum.reduceat(order, at), "max_gap": np.maximum.reduceat(gap, at)})
        if open_ is not None and open_["key"] == out.at[0, "key"]:
            a, z = open_, out.iloc[0]
            joined = z["first_ord"] - a["last_ord"] if a["last_ord"] != _NONE and z["first_ord"] != _NONE else 0
            out.at[0, "n"] = a["n"] + z["n"]
            out.at[0, "max_gap"] = max(a["max_gap"], z["max_gap"], joined)
            if a["first_ord"] != _NONE:
                out.at[0, "first_ord"] = a["first_ord"]
        elif open_ is not None:
            out = pd.concat([pd.DataFrame([open_]), out], ignore_index=True)
        open_ = out.iloc[-1].to_dict()
        done = out.iloc[:-1]
        if len(done):
            yield _named(done, part, seq)
            seq += len(done)
    if open_ is not None:
        yield _named(pd.DataFrame([open_]), part, seq)


def _named(out: pd.DataFrame, part: int, seq: int) -> pd.DataFrame:
    whole = {c: out[c].astype("Int64").mask(out[c] == _NONE) for c in ("first_ord", "last_ord")}
    return out.assign(part=part, seq=np.arange(seq, seq + len(out)), **whole)[["key", "part", "seq", "n", "first_ord", "last_ord", "max_gap"]]


def per_key(df: DataFrame, key: str, order: str, *, partitions: int | None = None) -> DataFrame:
    """(key, n, first_ord, last_ord, max_gap, n_parts) for each value of the string column `key`.

    order: a column that casts to long. n counts rows, first/last_ord bound the order values,
    max_gap is the largest step between neighbours in order (0 if there is none), n_parts says
    over how many partitions the key was spread. Null keys form one key (null); null orders
    count in n only. An empty table has no keys. Only `key` and `order` are read, so other columns
    cannot clash.

    partitions: of the range exchange; by default the session's shuffle partitions.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(df[key].cast("string").alias("key"), df[order].cast("long").alias("ord"))
    # The third column lets a key whose orders tie or are null be cut as well; the fold needs no order among ties.
    spread = rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(n, "key", "ord", "tie").drop("tie")
    states = durable(spread.sortWithinPartitions("key", "ord").mapInPandas(_fold, _STATE))
    # At most one state per partition and key: the list is bounded by the number of partitions.
    listed = states.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "seq", "n", "first_ord", "last_ord", "max_gap"))).alias("s"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first_ord"), F.lit(None).cast("long").alias("last_ord"), F.lit(0).cast("long").alias("max_gap"))

    def stitch(a, z):
        step = F.coalesce(z["first_ord"] - a["last_ord"], F.lit(0).cast("long"))
        return F.struct(
            (a["n"] + z["n"]).alias("n"),
            F.coalesce(a["first_ord"], z["first_ord"]).alias("first_ord"),
            F.coalesce(z["last_ord"], a["last_ord"]).alias("last_ord"),
            F.greatest(a["max_gap"], z["max_gap"], step).alias("max_gap"),
        )

    whole = listed.select("key", F.size("s").alias("n_parts"), F.aggregate("s", start, stitch).alias("t"))
    return whole.select("key", "t.n", "t.first_ord", "t.last_ord", "t.max_gap", "n_parts")


def frequent(per: DataFrame, share: float, *, group: str) -> DataFrame:
    """Rows of `per` (columns `group`, key, n) whose n is at least `share` of the group's n.

    The null key counts in the whole but is no key itself.
    """
    totals = per.groupBy(group).agg(F.sum("n").alias("__all"))
    return per.filter(F.col("key").isNotNull()).join(totals, group).filter(F.col("n") >= F.lit(share) * F.col("__all")).drop("__all")
