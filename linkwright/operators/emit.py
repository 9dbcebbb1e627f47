"""Result lists: one row per source1 record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.operators.pairs import KEYS


def candidate_lists(cands: DataFrame) -> DataFrame:
    """(source1_entity_id, candidate_entity_ids): ascending, comma-separated; bounded by the cap of candidates."""
    return cands.groupBy("source1_entity_id").agg(F.array_join(F.array_sort(F.collect_set("candidate_entity_id")), ",").alias("candidate_entity_ids"))


def matching_results(s1: DataFrame, predicted: DataFrame, cands: DataFrame) -> DataFrame:
    """(source1_entity_id, matched_entity_ids): every source1 id once, '' without match.

    Only candidates can be matches; source1 ids among the matches are dropped.
    """
    kept = predicted.join(cands.select(*KEYS), KEYS, "left_semi").filter(~F.col("candidate_entity_id").startswith("S1-"))
    lists = kept.groupBy("source1_entity_id").agg(F.array_join(F.array_sort(F.collect_set("candidate_entity_id")), ",").alias("l"))
    ids = s1.select(F.col("entity_id").alias("source1_entity_id")).distinct()
    return ids.join(lists, "source1_entity_id", "left").select("source1_entity_id", F.coalesce("l", F.lit("")).alias("matched_entity_ids"))


def result_summary(results: DataFrame) -> DataFrame:
    """(n_source1, n_with_match, n_without_match)."""
    some = F.col("matched_entity_ids") != ""
    return results.agg(F.count("*").alias("n_source1"), F.count_if(some).alias("n_with_match"), F.count_if(~some).alias("n_without_match"))
