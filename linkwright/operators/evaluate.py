"""Predictions, entity-level F0.5, threshold sweep, error analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.config import DEFAULT, Settings
from linkwright.operators.pairs import KEYS


def f05(p: Column, r: Column) -> Column:
    """F-measure that weighs precision twice as much as recall; 0 where both are 0."""
    return F.when(0.25 * p + r > 0, 1.25 * p * r / (0.25 * p + r)).otherwise(0.0)


def predictions(scored: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs at or above the threshold."""
    return scored.filter(F.col("match_proba") >= threshold).select(*KEYS).distinct()


def _per_entity(predicted: DataFrame, truth: DataFrame, entities: DataFrame, by: list[str]) -> DataFrame:
    """Counts of one evaluation per entity (and `by`): predicted, true and common pairs."""
    flags = predicted.withColumn("p", F.lit(1)).join(truth.withColumn("t", F.lit(1)), KEYS, "left")
    pred = flags.groupBy("source1_entity_id", *by).agg(F.count("*").alias("n_pred"), F.count("t").alias("n_hit"))
    true = truth.groupBy("source1_entity_id").agg(F.count("*").alias("n_true"))
    base = entities.join(true, "source1_entity_id", "left")
    full = base.join(pred, ["source1_entity_id", *by], "left")
    return full.select("source1_entity_id", *by, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_pred", "n_true", "n_hit")])


def _measured(counts: DataFrame) -> DataFrame:
    empty, singleton = (F.col("n_pred") == 0), (F.col("n_true") == 0)
    p = F.when(singleton & empty, 1.0).when(empty | singleton, 0.0).otherwise(F.col("n_hit") / F.col("n_pred"))
    r = F.when(singleton, 1.0).otherwise(F.col("n_hit") / F.col("n_true"))
    f = F.when(singleton & empty, 1.0).when(singleton, 0.0).otherwise(f05(p, r))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f05", f)


def entity_metrics(predicted: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """(source1_entity_id, precision, recall, f05, n_pred, n_true) of every entity.

    No truth and no prediction is perfect; no truth and some prediction scores 0. Entities without
    prediction count as empty. Predictions of ids outside `entities` raise ValueError.
    """
    if not predicted.join(entities, "source1_entity_id", "left_anti").isEmpty():
        raise ValueError("predictions for entities that are not evaluated")
    return _measured(_per_entity(predicted, truth, entities, [])).select("source1_entity_id", "precision", "recall", "f05", "n_pred", "n_true")


def macro(metrics: DataFrame) -> DataFrame:
    """One row: macro means and counts of singletons, kept and falsely merged."""
    lone = F.col("n_true") == 0
    return metrics.agg(
        F.count("*").alias("n_entities"), F.round(F.avg("precision"), 6).alias("macro_precision"), F.round(F.avg("recall"), 6).alias("macro_recall"), F.round(F.avg("f05"), 6).alias("macro_f05"),
        F.count_if(lone).alias("n_singletons"), F.count_if(lone & (F.col("n_pred") == 0)).alias("n_singletons_kept"), F.count_if(lone & (F.col("n_pred") > 0)).alias("n_singleton_merges"),
    )


def sweep(scored: DataFrame, truth: DataFrame, entities: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(threshold, macro_f05, macro_precision, macro_recall) for all thresholds in one pass over the pairs.

    A scored pair counts for every threshold up to its score; thresholds are a constant array, so
    no pair is joined to anything but its label.
    """
    cuts = F.array(*[F.lit(t) for t in settings.thresholds])
    at = scored.groupBy(*KEYS).agg(F.max("match_proba").alias("s")).select(*KEYS, F.explode(F.filter(cuts, lambda t: t <= F.col("s"))).alias("threshold"))
    grid = entities.select("source1_entity_id", F.explode(cuts).alias("threshold"))
    m = _measured(_per_entity(at, truth, grid, ["threshold"]))
    return m.groupBy("threshold").agg(F.round(F.avg("f05"), 6).alias("macro_f05"), F.round(F.avg("precision"), 6).alias("macro_precision"), F.round(F.avg("recall"), 6).alias("macro_recall"))


def best_threshold(swept: DataFrame) -> DataFrame:
    """(threshold, macro_f05): the best, the lowest of equals."""
    best = swept.agg(F.max(F.struct("macro_f05", (-F.col("threshold")).alias("neg"))).alias("b"))
    return best.select((-F.col("b.neg")).alias("threshold"), F.col("b.macro_f05").alias("macro_f05"))


def false_positives(scored: DataFrame, truth: DataFrame, threshold: float, n: int = 20) -> DataFrame:
    """The `n` surest wrong predictions."""
    wrong = scored.filter(F.col("match_proba") >= threshold).select(*KEYS, "match_proba").join(truth, KEYS, "left_anti")
    return wrong.orderBy(F.desc("match_proba"), *KEYS).limit(n)


def false_negatives(scored: DataFrame, truth: DataFrame, entities: DataFrame, threshold: float, n: int = 20) -> DataFrame:
    """The first `n` true pairs not predicted, lowest score first; `reason` tells misses of blocking apart."""
    own = truth.join(entities, "source1_entity_id", "left_semi").join(scored.select(*KEYS, "match_proba"), KEYS, "left")
    lost = own.filter(F.col("match_proba").isNull() | (F.col("match_proba") < threshold))
    reason = F.when(F.col("match_proba").isNull(), "blocking miss").otherwise("below threshold")
    return lost.select(*KEYS, F.coalesce("match_proba", F.lit(-1.0)).alias("match_proba"), reason.alias("reason")).orderBy("match_proba", *KEYS).limit(n)


def singleton_merges(predicted: DataFrame, truth: DataFrame, entities: DataFrame, n: int = 20) -> DataFrame:
    """(source1_entity_id, examples): entities without true match that were matched, three ids each."""
    lone = entities.join(truth, "source1_entity_id", "left_anti")
    hit = predicted.join(lone, "source1_entity_id", "left_semi").groupBy("source1_entity_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("candidate_entity_id")), 1, 3), ",").alias("examples"))
    return hit.orderBy("source1_entity_id").limit(n)
