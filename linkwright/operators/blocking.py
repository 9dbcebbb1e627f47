"""Candidate pairs from shared keys, hot keys left out, the best candidates of each record kept.

All six strategies are rows of one key table (family, priority, tag, key), so there is one
join instead of six. Hot keys are counted with partial aggregation and dropped before
the join; the attribution (first strategy of its family wins) is a minimum, combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.config import DEFAULT, Settings
from linkwright.functions import text
from linkwright.operators.storage import durable, merging

#: tag -> (family, priority within the family)
STRATEGIES = {
    "B1_name_exact": ("name", 1), "B2_name_token": ("name", 2), "B3_name_trigram": ("name", 3),
    "B4_address_token": ("address", 1), "B5_numeric_token": ("address", 2), "B6_country_name_combo": ("address", 3),
}


def latest(df: DataFrame) -> DataFrame:
    """One row per entity_id: the one loaded last; of several, the largest by text. Nulls become ''.

    Rows with a null id are dropped. A source without `loaded_at` counts as loaded at once.
    """
    at = F.col("loaded_at") if "loaded_at" in df.columns else F.lit(None).cast("timestamp")
    cols = ["business_name", "business_address", "country"]
    row = F.struct(at.alias("at"), *[F.coalesce(c, F.lit("")).alias(c) for c in cols])
    return df.filter("entity_id is not null").groupBy("entity_id").agg(F.max(row).alias("r")).select("entity_id", *[f"r.{c}" for c in cols])


def normalized(df: DataFrame, *, compat: bool = True) -> DataFrame:
    """(entity_id, name_norm, address_norm, country_norm), never null."""
    return df.select(
        "entity_id",
        text.normalize_name(F.col("business_name"), compat=compat).alias("name_norm"),
        text.normalize_address(F.col("business_address"), compat=compat).alias("address_norm"),
        text.normalize_country(F.col("country"), compat=compat).alias("country_norm"),
    )


def _tagged(tag: str, keys: Column) -> Column:
    family, priority = STRATEGIES[tag]
    return F.transform(keys, lambda k: F.struct(F.lit(family).alias("family"), F.lit(priority).alias("priority"), F.lit(tag).alias("tag"), k.alias("key")))


def block_keys(norm: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """(entity_id, family, priority, tag, key): every blocking key of every record, one row each."""
    name, names = F.col("name_norm"), text.name_tokens(F.col("name_norm"))
    some = lambda c: F.filter(F.array(c), lambda k: k.isNotNull() & (k != ""))
    keys = {
        "B1_name_exact": some(name),
        "B2_name_token": names,
        "B3_name_trigram": some(F.substring(name, 1, 3)),
        "B4_address_token": text.address_tokens(F.col("address_norm")),
        "B5_numeric_token": F.filter(text.numeric_tokens(name, F.col("address_norm")), lambda t: F.length(t) >= 3),
        "B6_country_name_combo": some(F.when(F.col("country_norm") != "", F.concat(F.col("country_norm"), F.lit("|"), F.get(names, F.lit(0))))),
    }
    all_ = F.concat(*[_tagged(t, keys[t]) for t in tags or STRATEGIES])
    return norm.select("entity_id", F.explode(all_).alias("k")).select("entity_id", "k.*")


def posting_stats(keys: DataFrame, max_posting: int) -> DataFrame:
    """(tag, n_keys, n_hot_keys, n_postings, n_kept): how much the hot-key limit takes away."""
    per = keys.groupBy("tag", "key").agg(F.count("*").alias("n"))
    hot = F.col("n") > max_posting
    return per.groupBy("tag").agg(F.count("*").alias("n_keys"), F.count_if(hot).alias("n_hot_keys"), F.sum("n").alias("n_postings"), F.sum(F.when(~hot, F.col("n")).otherwise(0)).alias("n_kept"))


def raw_pairs(s1_keys: DataFrame, candidate_keys: DataFrame, max_posting: int) -> DataFrame:
    """(source1_entity_id, candidate_entity_id, family, priority) of all pairs that share a key.

    A key with more than `max_posting` candidates is left out altogether: counted first, with partial
    aggregation, so that a key of any size never reaches the join.
    """
    cool = candidate_keys.groupBy("tag", "key").agg(F.count("*").alias("n")).filter(F.col("n") <= max_posting).select("tag", "key")
    kept = candidate_keys.join(merging(cool), ["tag", "key"], "left_semi").select("tag", "key", F.col("entity_id").alias("candidate_entity_id"))
    mine = s1_keys.select("tag", "key", "family", "priority", F.col("entity_id").alias("source1_entity_id"))
    return mine.join(merging(kept), ["tag", "key"]).select("source1_entity_id", "candidate_entity_id", "family", "priority")


def family_pairs(pairs: DataFrame) -> DataFrame:
    """(source1_entity_id, candidate_entity_id, family, tag): per family the first strategy wins."""
    tag = F.create_map(*[F.lit(x) for t, (f, p) in STRATEGIES.items() for x in (f"{f}{p}", t)])
    best = pairs.groupBy("source1_entity_id", "candidate_entity_id", "family").agg(F.min("priority").alias("p"))
    return best.select("source1_entity_id", "candidate_entity_id", "family", F.element_at(tag, F.concat("family", F.col("p").cast("string"))).alias("tag"))


def merged(pairs: DataFrame) -> DataFrame:
    """(source1_entity_id, candidate_entity_id, block_strategies): one row per pair, at most two tags."""
    tag = {f: F.create_map(*[F.lit(x) for t, (g, p) in STRATEGIES.items() if g == f for x in (p, t)]) for f in ("name", "address")}
    least = lambda f: F.min(F.when(F.col("family") == f, F.col("priority"))).alias(f)
    both = pairs.repartition("candidate_entity_id").groupBy("source1_entity_id", "candidate_entity_id").agg(least("name"), least("address"))
    tags = F.array(F.try_element_at(tag["name"], F.col("name")), F.try_element_at(tag["address"], F.col("address")))
    return both.select("source1_entity_id", "candidate_entity_id", F.array_join(F.array_sort(F.filter(tags, lambda t: t.isNotNull())), ",").alias("block_strategies"))


def token_sets(norm: DataFrame) -> DataFrame:
    """(entity_id, toks): the words that rank candidates, as hashes, which are an eighth of the size and compared faster."""
    words = F.array_union(text.name_tokens(F.col("name_norm")), text.address_tokens(F.col("address_norm")))
    return norm.select("entity_id", F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))).alias("toks"))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two distinct arrays; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 0.0).otherwise(both / either)


def ranked(cands: DataFrame, s1: DataFrame, others: DataFrame) -> DataFrame:
    """`cands` with `jaccard`, the overlap of the two records' words.

    Candidate records are joined first: pairs merged by candidate lie right for that, and what follows
    per source1 record (the join and the choice of the best) needs one exchange in all.
    """
    a = token_sets(s1).select(F.col("entity_id").alias("source1_entity_id"), F.col("toks").alias("ta"))
    b = token_sets(others).select(F.col("entity_id").alias("candidate_entity_id"), F.col("toks").alias("tb"))
    return cands.join(merging(b), "candidate_entity_id").join(merging(a), "source1_entity_id").select(*cands.columns, jaccard(F.col("ta"), F.col("tb")).alias("jaccard"))


def top_candidates(rated: DataFrame, k: int) -> DataFrame:
    """The `k` best of each source1 record by overlap, then by id (partial and final group limit)."""
    w = Window.partitionBy("source1_entity_id").orderBy(F.desc("jaccard"), "candidate_entity_id")
    return rated.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("rn")


def candidates(s1: DataFrame, s2: DataFrame, s3: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(source1_entity_id, candidate_entity_id, block_strategies) of normalised tables: the whole stage.

    The hot-key limit holds per source. Empty tables give no candidates.
    """
    mine, pairs = durable(block_keys(s1)), None
    for other in (s2, s3):
        p = raw_pairs(mine, durable(block_keys(other)), settings.max_posting)
        pairs = p if pairs is None else pairs.unionByName(p)
    rated = ranked(merged(pairs), s1, s2.unionByName(s3))
    return top_candidates(rated, settings.max_candidates).select("source1_entity_id", "candidate_entity_id", "block_strategies")
