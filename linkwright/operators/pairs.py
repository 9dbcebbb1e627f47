"""Labels as tables, recall of blocking, labelled pairs, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwright.config import DEFAULT, Settings
from linkwright.functions.text import hashed, id_list
from linkwright.operators.storage import durable, merging

#: Bits of `text.hashed`, and how many of them make the buckets in which a share of all ids is cut off.
HASH_BITS, BUCKET_BITS = 32, 12
KEYS = ["source1_entity_id", "candidate_entity_id"]


def label_rows(labels: DataFrame) -> DataFrame:
    """(source1_entity_id, candidate_entity_id): one row per list entry, repeats kept."""
    return labels.select("source1_entity_id", F.explode(id_list(F.col("matched_entity_ids"))).alias("candidate_entity_id"))


def label_sets(labels: DataFrame) -> DataFrame:
    """Distinct label pairs; lists of one id delivered in several rows are united."""
    return label_rows(labels).distinct()


def label_entities(labels: DataFrame) -> DataFrame:
    """Distinct labelled source1 ids, those with empty lists too."""
    return labels.select("source1_entity_id").filter("source1_entity_id is not null").distinct()


def recovered(truth: DataFrame, cands: DataFrame) -> DataFrame:
    """Label pairs that are candidates."""
    return truth.join(merging(cands.select(*KEYS)), KEYS, "left_semi")


def missed(truth: DataFrame, cands: DataFrame) -> DataFrame:
    """Label pairs that blocking did not find."""
    return truth.join(cands.select(*KEYS), KEYS, "left_anti")


def blocking_recall(truth: DataFrame, cands: DataFrame) -> DataFrame:
    """One row: positives, recovered, missed, recall, candidate pairs and source1 ids with candidates."""
    hit = truth.join(cands.select(*KEYS).distinct().withColumn("hit", F.lit(1)), KEYS, "left").agg(F.count("*").alias("n_positives"), F.count("hit").alias("n_recovered"))
    size = cands.agg(F.count("*").alias("n_pairs"), F.countDistinct("source1_entity_id").alias("n_source1"))
    both = hit.withColumn("one", F.lit(1)).join(size.withColumn("one", F.lit(1)), "one")
    share = F.when(F.col("n_positives") > 0, F.col("n_recovered") / F.col("n_positives")).otherwise(0.0)
    return both.select("n_positives", "n_recovered", (F.col("n_positives") - F.col("n_recovered")).alias("n_missed"), F.round(share, 6).alias("recall"), "n_pairs", "n_source1")


def strategy_counts(cands: DataFrame) -> DataFrame:
    """(tag, n_pairs)."""
    return cands.select(F.explode(F.split("block_strategies", ",")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n_pairs"))


def split_entities(entities: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(source1_entity_id, split): the first share by hash is `val`, at least one id; the rest `train`.

    A histogram of the hash's first bits tells in which bucket the cut lies; only that bucket's ids, some
    few thousandths of all, are ranked.
    """
    h = durable(entities.select("source1_entity_id", hashed(F.lit(str(settings.seed)), "source1_entity_id").alias("h")))
    bucket = F.shiftright("h", HASH_BITS - BUCKET_BITS)
    counts = {r["b"]: r["n"] for r in h.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()}  # at most 2 ** BUCKET_BITS
    left = max(1, int(sum(counts.values()) * settings.val_fraction))
    cut = None
    for b in sorted(counts):
        if counts[b] >= left:
            cut = b
            break
        left -= counts[b]
    whole = F.when(bucket < F.lit(cut), "val").otherwise("train")
    if cut is None:
        return h.select("source1_entity_id", whole.alias("split"))
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy("h", "source1_entity_id"))
    at_cut = h.filter(bucket == cut).select("source1_entity_id", F.when(rank <= left, "val").otherwise("train").alias("split"))
    return h.filter(bucket != cut).select("source1_entity_id", whole.alias("split")).unionByName(at_cut)


def hard_negatives(cands: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """Candidates of labelled records that are no label pairs."""
    return cands.select(*KEYS).join(merging(entities), "source1_entity_id", "left_semi").join(merging(truth), KEYS, "left_anti")


def sampled_negatives(negatives: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """At most `negatives_per_entity` hard negatives of each record, chosen by hash."""
    w = Window.partitionBy("source1_entity_id").orderBy(hashed(F.lit(str(settings.seed)), *KEYS), "candidate_entity_id")
    return negatives.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= settings.negatives_per_entity).drop("rn")


def labelled_pairs(cands: DataFrame, truth: DataFrame, entities: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(source1_entity_id, candidate_entity_id, label, split): recovered positives and sampled negatives."""
    pos = recovered(truth, cands).withColumn("label", F.lit(1).cast("byte"))
    neg = sampled_negatives(hard_negatives(cands, truth, entities), settings).withColumn("label", F.lit(0).cast("byte"))
    return pos.unionByName(neg).join(merging(split_entities(entities, settings)), "source1_entity_id")


def pair_stats(pairs: DataFrame) -> DataFrame:
    """(split, n_pairs, n_pos, n_neg, positive_rate)."""
    return pairs.groupBy("split").agg(F.count("*").alias("n_pairs"), F.sum(F.col("label").cast("long")).alias("n_pos"), F.sum(1 - F.col("label").cast("long")).alias("n_neg"), F.round(F.avg("label"), 6).alias("positive_rate"))
