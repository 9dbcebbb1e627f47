"""Queries of the general problems: packed fields (p2) and hot keys (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.operators.packed import unpack
from linkwright.operators.skew import frequent, per_key
from linkwright.sources.tables import table

VALUE_START = "S[23]-"
SHARE = 0.02
#: Between field name and key in the composite key; occurs in neither.
BAR = "\x1f"


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "train_matches", "source1_entity_id", "matched_entity_ids")
    return unpack(labels, ["source1_entity_id"], "matched_entity_ids", VALUE_START, value="matched_entity_id")


def _keyed(spark: SparkSession, folder: str) -> DataFrame:
    """(fk, ord): both fields' keys, marked with the field; a missing key leaves the mark alone."""
    tags = F.regexp_extract_all("block_strategies", F.lit(r"(\w+)"), F.lit(1))
    pairs = table(spark, folder, "candidate_pairs", "block_strategies", "scored_at")
    pairs = pairs.select(F.lit("block_strategies").alias("f"), F.array_join(F.array_sort(F.array_distinct(tags)), ",").alias("k"), F.unix_micros(F.col("scored_at").cast("timestamp")).alias("ord"))
    names = table(spark, folder, "train_source2", "business_name", "loaded_at")
    name = F.trim(F.regexp_replace(F.lower("business_name"), r"[ \t]+", " "))
    names = names.select(F.lit("business_name").alias("f"), name.alias("k"), F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("ord"))
    return pairs.unionAll(names).select(F.concat("f", F.lit(BAR), F.coalesce("k", F.lit(""))).alias("fk"), "ord")


def _stats(spark: SparkSession, folder: str) -> DataFrame:
    per = per_key(_keyed(spark, folder), "fk", "ord")
    split = F.split("key", BAR, 2)
    key = F.when(split[1] != "", split[1])
    return per.select(split[0].alias("field_name"), key.alias("key"), "n", "first_ord", "last_ord", "max_gap")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    hot = frequent(_stats(spark, folder), SHARE, group="field_name")
    return hot.select("field_name", F.col("key").alias("key_value"))


def p4_key_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Every key of the two fields: rows, time span and longest silence in microseconds."""
    s = _stats(spark, folder).filter(F.col("key").isNotNull())
    return s.select("field_name", F.col("key").alias("key_value"), F.col("n").alias("n_rows"), F.col("first_ord").alias("first_us"), F.col("last_ord").alias("last_us"), F.col("max_gap").alias("max_gap_us"))


_KEYS_SQL = r"""
WITH k AS (
  SELECT 'block_strategies' AS field_name, scored_at AS t,
         nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(block_strategies, '[A-Za-z0-9_]+'))), ','), '') AS key_value
  FROM candidate_pairs
  UNION ALL
  SELECT 'business_name', loaded_at,
         nullif(trim(regexp_replace(lower(business_name), '[ \t]+', ' ', 'g')), '')
  FROM train_source2)
"""

QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p4_key_stats": p4_key_stats}

SQL = {
    "p2_found": r"""
SELECT DISTINCT source1_entity_id, value_pos::INTEGER AS value_pos, regexp_replace(v, '["'']$', '') AS matched_entity_id
FROM (SELECT source1_entity_id, unnest(l) AS v, unnest(range(1, len(l) + 1)) AS value_pos
      FROM (SELECT source1_entity_id, regexp_extract_all(matched_entity_ids, 'S[23]-[0-9]+(?:[,;|/ ][a-z0-9]["''])?') AS l
            FROM train_matches WHERE matched_entity_ids IS NOT NULL))
""",
    "p4_found": _KEYS_SQL
    + """
SELECT field_name, key_value FROM
  (SELECT field_name, key_value, count(*) AS n, sum(count(*)) OVER (PARTITION BY field_name) AS total FROM k GROUP BY 1, 2)
WHERE key_value IS NOT NULL AND n >= 0.02 * total
""",
    "p4_key_stats": _KEYS_SQL
    + """
SELECT field_name, key_value, count(*) AS n_rows, epoch_us(min(t)) AS first_us, epoch_us(max(t)) AS last_us,
       coalesce(max(epoch_us(t) - epoch_us(p)), 0)::BIGINT AS max_gap_us
FROM (SELECT *, lag(t) OVER (PARTITION BY field_name, key_value ORDER BY t) AS p FROM k WHERE key_value IS NOT NULL)
GROUP BY 1, 2
""",
}
