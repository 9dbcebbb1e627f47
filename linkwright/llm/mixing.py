"""Mixing sources to target weights: raking (iterative proportional fitting), then calibrated sampling."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.ranks import prefix_sums
from linkwright.operators.storage import durable, merging

#: Combinations of source and margin values whose rates are broadcast; more of them are joined by merging, with the same result.
MOST_CELLS = 200_000
#: Rounds over all margins.
TABLE_ROUNDS = 40
_UNIT = 1_000_000
#: Cells that are raked at a time, and rows of a batch of the result.
_PIECE, _ROWS = 1 << 20, 10_000


def rake(avail: np.ndarray, cap: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = 200, close: float = 1e-9) -> np.ndarray:
    """Token weight of each cell, at most `cap`, whose sums approach every margin in `targets`.

    codes[d]: each cell's value in margin d; margin 0, the source, is fitted last in each round. What a
    cell cannot take because of its cap goes to the open cells of the same value.
    """
    w = np.minimum(avail.astype(float), cap)
    for _ in range(rounds):
        old = w.copy()
        for d in [*range(1, len(codes)), 0]:
            for _ in range(20):
                have = np.bincount(codes[d], w, len(targets[d]))
                closed = np.bincount(codes[d], np.where(w >= cap * (1 - 1e-12), w, 0), len(targets[d]))
                with np.errstate(divide="ignore", invalid="ignore"):
                    f = np.where(have - closed > 0, (targets[d] - closed) / (have - closed), 1.0)
                grow = targets[d] >= have
                whole = np.where(have > 0, targets[d] / np.where(have > 0, have, 1), 1.0)
                scale = np.where(grow, np.maximum(f, 1.0), whole)[codes[d]]
                at_cap = w >= cap * (1 - 1e-12)
                new = np.minimum(cap, np.where(grow[codes[d]] & at_cap, w, w * scale))
                moved = np.abs(new - w).max(initial=0)
                w = new
                if moved <= close * max(1.0, w.max(initial=0)):
                    break
        if np.abs(old - w).max(initial=0) <= close * max(1.0, w.max(initial=0)):
            break
    return w


def rake_table(cells: DataFrame, dims: list[str], whole: float, *, rounds: int = TABLE_ROUNDS, close: float = 1e-5) -> DataFrame:
    """`cells` (dims, n, m, share) as (dims, n, m, w) with the token weight `w`, at most n times m: what `rake` does, for any number of cells.

    dims[0] is the source, whose target is its `share` of `whole`; the other margins keep the shares of the tokens
    available. Ends when a round over all margins moves no weight by more than `close` of the largest one, or after `rounds`.

    All rounds run in one task, so that the driver plans one job and not several a round. The task keeps the cells in files on
    its disk (some 50 bytes each) and takes them piece by piece; it holds one row per value of a margin.
    """
    kinds = ", ".join(f"{d} string" for d in dims)

    def raked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with tempfile.TemporaryDirectory() as folder:
            values: list[dict[str, int]] = [{} for _ in dims]
            share: dict[str, float] = {}
            with ExitStack() as stack:
                files = {c: stack.enter_context(open(f"{folder}/{c}", "wb")) for c in [*dims, "n", "m"]}
                for b in batches:
                    for d, known in zip(dims, values):
                        codes, found = pd.factorize(b[d])
                        files[d].write(np.array([known.setdefault(v, len(known)) for v in found], dtype="int32")[codes].tobytes())
                    files["n"].write(b["n"].to_numpy("int64").tobytes())
                    files["m"].write(b["m"].to_numpy("int64").tobytes())
                    share |= dict(zip(b[dims[0]], b["share"]))
            if not share:
                return
            codes = [np.memmap(f"{folder}/{d}", "int32", "r") for d in dims]
            n, m = np.memmap(f"{folder}/n", "int64", "r"), np.memmap(f"{folder}/m", "int64", "r")
            w, was = (np.memmap(f"{folder}/{c}", "float64", "w+", shape=n.shape) for c in ("w", "was"))
            pieces = [slice(i, i + _PIECE) for i in range(0, len(n), _PIECE)]
            sums = lambda d, of: sum((np.bincount(codes[d][s], of(s), len(values[d])) for s in pieces), np.zeros(len(values[d])))
            cap = lambda s: (n[s] * m[s]).astype(float)
            full = lambda s: w[s] >= cap(s) * (1 - 1e-9)
            total = sum(int(n[s].sum()) for s in pieces)
            goals = [np.array([share[v] for v in values[0]]) * whole, *[sums(d, lambda s: n[s]) / total * whole for d in range(1, len(dims))]]
            for s in pieces:
                w[s] = np.minimum(n[s], cap(s))
            for _ in range(rounds):
                for s in pieces:
                    was[s] = w[s]
                for d in [*range(1, len(dims)), 0]:
                    goal, have, shut = goals[d], sums(d, lambda s: w[s]), sums(d, lambda s: np.where(full(s), w[s], 0.0))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        factor = np.where(goal < have, goal / have, np.where(have > shut, np.maximum(1.0, (goal - shut) / (have - shut)), 1.0))
                    for s in pieces:
                        at = codes[d][s]
                        w[s] = np.where((goal >= have)[at] & full(s), w[s], np.minimum(cap(s), w[s] * factor[at]))
                if max(np.abs(w[s] - was[s]).max() for s in pieces) <= close * max(w[s].max() for s in pieces):
                    break
            names = [np.array(list(known), dtype=object) for known in values]
            for i in range(0, len(n), _ROWS):
                s = slice(i, i + _ROWS)
                yield pd.DataFrame({d: names[k][codes[k][s]] for k, d in enumerate(dims)} | {"n": n[s], "m": m[s], "w": w[s]})

    # In one order, so that sums come out the same each time.
    ordered = cells.select(*dims, "n", "m", "share").repartition(1).sortWithinPartitions(*dims)
    return durable(ordered.mapInPandas(raked, f"{kinds}, n long, m long, w double"))


def mix(df: DataFrame, key: str, size: str, source: str, margins: list[str], targets: DataFrame) -> DataFrame:
    """(key, source, n_tokens, n_copies): the records of the mixture, each with how often it is used.

    targets: (source, target_share of all tokens, max_repeats). Sources that hold no tokens
    cannot contribute: the shares are taken relative to the rest. The whole is as large as it can be with
    every other source at its share and no record above its source's max_repeats. Records of
    sources without target, and of size 0 or null, are not used. Within a source, tokens are raked to
    the `margins` (columns), whose targets are their shares in the usable records, as far as the
    repeats allow; null is a value like others.

    Keys must be unique. Sampling is systematic over records ordered by size: a record is used the
    whole part of its expected number of times, or once more, and token sums come out within about one
    record per bucket. The same input gives the same mixture. An empty input gives none.
    """
    spark = df.sparkSession
    want = targets.select(F.col("source").alias("__src"), F.col("target_share").cast("double").alias("__t"), F.col("max_repeats").cast("int").alias("__m"))
    want = want.filter("__src is not null and __t > 0 and __m > 0").dropDuplicates(["__src"])
    rows = df.select(df[key].alias("__k"), df[source].alias("__src"), df[size].cast("long").alias("__n"), *[F.coalesce(df[m].cast("string"), F.lit("")).alias(f"__d{i}") for i, m in enumerate(margins)])
    dims = [f"__d{i}" for i in range(len(margins))]
    # The targets are a parameter table, one row per named source.
    usable = durable(rows.filter(F.col("__n") > 0).join(want, "__src"))
    cells = usable.groupBy("__src", *dims).agg(F.sum("__n").alias("n"), F.first("__t").alias("t"), F.first("__m").alias("m"))
    cells = durable(cells)
    out_schema = f"{key} {df.schema[key].dataType.simpleString()}, {source} string, n_tokens long, n_copies long"
    per_source = cells.groupBy("__src").agg(F.sum("n").alias("n"), F.first("t").alias("t"), F.first("m").alias("m")).collect()  # at most one row per row of `targets`
    if not per_source:
        return spark.createDataFrame([], out_schema)
    targeted = sum(r["t"] for r in per_source)
    whole = min(r["n"] * r["m"] / (r["t"] / targeted) for r in per_source)
    # One way for any number of cells, so that the mixture doesn't depend on it.
    raked = rake_table(cells.select("__src", *dims, "n", "m", (F.col("t") / targeted).alias("share")), ["__src", *dims], whole)
    rates = raked.select("__src", *dims, F.least(F.floor(F.col("w") / F.col("n") * _UNIT + 0.5), F.col("m") * _UNIT).cast("long").alias("__u"))
    rated = usable.join(F.broadcast(rates) if cells.count() <= MOST_CELLS else merging(rates), ["__src", *dims])
    # By size from large to small in bands of an eighth of a doubling, each in 16 hashed parts.
    band = (F.floor(-8 * F.log2(F.col("__n").cast("double"))) * 16 + F.pmod(F.xxhash64("__k"), F.lit(16))).cast("int")
    sums = prefix_sums(rated, ["__src"], [F.col("__n").desc(), *dims, F.xxhash64("__k"), F.col("__k")], {"__c": F.col("__u").cast("long")}, bucket=band)
    half = _UNIT // 2
    copies = (F.floor((F.col("__c") + F.col("__u") + half) / _UNIT) - F.floor((F.col("__c") + half) / _UNIT)).cast("long")
    return sums.select(F.col("__k").alias(key), F.col("__src").alias(source), F.col("__n").alias("n_tokens"), copies.alias("n_copies")).filter("n_copies > 0")


def shares(mixture: DataFrame, source: str, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_records, n_copies, n_tokens) of every source with a target."""
    mixture = durable(mixture)
    own = mixture.groupBy(source).agg(F.count("*").alias("n_records"), F.sum("n_copies").alias("n_copies"), F.sum(F.col("n_copies") * F.col("n_tokens")).alias("n_tokens"))
    all_ = own.agg(F.sum("n_tokens").alias("__all"))
    total = all_.collect()[0]["__all"] or 1
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_records", "n_copies", "n_tokens")]
    return targets.select(source, "target_share").join(own, source, "left").select(source, "target_share", (F.coalesce("n_tokens", F.lit(0)) / F.lit(total)).alias("actual_share"), *zero)
