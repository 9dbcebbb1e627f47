"""Queries of the training-data problems and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.llm import addresses, chunking, linkage, mixing, names, packing, splits, topn
from linkwright.llm.tokens import token_count
from linkwright.operators.packed import unpack
from linkwright.operators.storage import durable
from linkwright.plans.general import VALUE_START
from linkwright.sources.tables import table

TOP = 5


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_ranked(spark, folder).select("source1_entity_id", "candidate_entity_id")


def p1_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The same with score and rank."""
    pairs = table(spark, folder, "candidate_pairs", "source1_entity_id", "candidate_entity_id", "match_proba")
    return topn.top_n(pairs, "source1_entity_id", "candidate_entity_id", "match_proba", TOP)


def _related(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "train_matches", "source1_entity_id", "matched_entity_ids")
    links = unpack(labels, ["source1_entity_id"], "matched_entity_ids", VALUE_START).select("source1_entity_id", "value")
    alone = labels.select("source1_entity_id", F.lit(None).cast("string").alias("value"))
    return splits.related_groups(links.unionByName(alone), "source1_entity_id", "value")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    r = _related(spark, folder)
    return r.filter("source1_entity_id <> first").select(F.col("first").alias("first_entity_id"), "source1_entity_id")


def p3_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Every labelled source1 id with its group and its split."""
    r = splits.assign_splits(_related(spark, folder), "source1_entity_id", table(spark, folder, "split_targets"))
    return r.select("source1_entity_id", F.col("first").alias("first_entity_id"), "split_name")


def _limits(spark: SparkSession, folder: str) -> dict[str, int]:
    """The fixed table of limits (three rows)."""
    return {r["limit_name"]: r["n_tokens"] for r in table(spark, folder, "size_limits").collect()}


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    lim = _limits(spark, folder)
    cut = chunking.pieces(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", piece=lim["piece"], overlap=lim["overlap"], with_text=False)
    return cut.filter("piece_no = 2").select("doc_id")  # there is a second piece only beyond the limit


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of all documents, with their text."""
    lim = _limits(spark, folder)
    return chunking.pieces(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", piece=lim["piece"], overlap=lim["overlap"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "train_source2", "entity_id", "business_name", "business_address")
    return addresses.pairs_within(names.organisations(records, "entity_id", "business_name", "business_address"), "entity_id", "organisation")


_RECORD = ["entity_id", "business_name", "business_address", "country"]


def p6_scored(spark: SparkSession, folder: str) -> DataFrame:
    """Matches of the unlabelled source1 records with their confidence."""
    s1 = table(spark, folder, "train_source1", *_RECORD)
    records = table(spark, folder, "train_source2", *_RECORD).unionByName(table(spark, folder, "train_source3", *_RECORD))
    labelled = table(spark, folder, "train_matches", "source1_entity_id").select(F.col("source1_entity_id").alias("entity_id"))
    only = s1.select("entity_id").join(labelled, "entity_id", "left_anti")
    found = linkage.link(s1, records, *_RECORD, only=only)
    return found.select(F.col("reference_entity_id").alias("source1_entity_id"), "entity_id", "confidence")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_scored(spark, folder).select("source1_entity_id", "entity_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "train_source3", "entity_id", "business_address")
    return addresses.pairs_within(addresses.places(records, "entity_id", "business_address"), "entity_id", "place")


def p7_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with an address that can be read, its place, and how many records lie there as well."""
    records = table(spark, folder, "train_source3", "entity_id", "business_address")
    return addresses.group_sizes(addresses.places(records, "entity_id", "business_address"), "entity_id", "place")


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every record that names an organisation, that organisation, and how many records name it as well."""
    records = table(spark, folder, "train_source2", "entity_id", "business_name", "business_address")
    return addresses.group_sizes(names.organisations(records, "entity_id", "business_name", "business_address"), "entity_id", "organisation")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document (piece) with its container."""
    docs = table(spark, folder, "documents", "doc_id", "text").select("doc_id", token_count(F.col("text")).alias("n_tokens"))
    return packing.pack(docs, "doc_id", "n_tokens", _limits(spark, folder)["container"])


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are: their number, the least number the sizes allow, and the unused room."""
    cap = _limits(spark, folder)["container"]
    fill = p8_containers(spark, folder).groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    a = fill.agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"))
    return a.select("n_containers", F.ceil(F.col("n_tokens") / cap).alias("least_containers"), "n_tokens", "fullest", (1 - F.col("n_tokens") / (F.col("n_containers") * cap)).alias("unused_share"))


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture of documents; the section of the site (first part of the URL's path) stands for the topic."""
    docs = table(spark, folder, "documents", "doc_id", "source", "lang", "url", "text")
    sized = docs.select("doc_id", "source", F.lower(F.trim("lang")).alias("lang"), F.regexp_extract("url", r"^\w+://[^/]+/([^/?#]*)", 1).alias("section"), token_count(F.col("text")).alias("n"))
    return mixing.mix(sized, "doc_id", "n", "source", ["lang", "section"], table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixing.shares(p9_mixture(spark, folder), "source", table(spark, folder, "mix_targets"))


def p3_checked(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold for p3_splits, in one row: all labelled ids, whole groups, shares within the largest group of their targets."""
    r = durable(p3_splits(spark, folder))
    groups = r.groupBy("first_entity_id").agg(F.count("*").alias("size"), F.count_distinct("split_name").alias("k"))
    g = groups.agg(F.count("*").alias("n_groups"), F.count_if(F.col("k") != 1).alias("n_broken_groups"), F.max("size").alias("largest"), F.sum("size").alias("n_ids")).withColumn("one", F.lit(1))
    held = table(spark, folder, "split_targets").join(r.groupBy("split_name").agg(F.count("*").alias("n")), "split_name", "left").join(g.withColumn("one", F.lit(1)).select("one", "largest", "n_ids"), F.col("one") == 1)
    off = held.agg(F.count_if(F.abs(F.coalesce("n", F.lit(0)) - F.col("target_share") * F.col("n_ids")) > F.col("largest")).alias("n_shares_off")).withColumn("one", F.lit(1))
    return g.join(off, "one").select("n_ids", "n_groups", "n_broken_groups", "n_shares_off")


def p8_checked(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold for p8_containers, in one row: every token once, no container beyond its capacity, only oversized documents divided."""
    cap = _limits(spark, folder)["container"]
    items = durable(p8_containers(spark, folder))
    docs = items.groupBy("doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("n")).agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_tokens"), F.count_if(F.col("k") > 1).alias("n_divided"), F.lit(1).alias("one"))
    over = items.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > cap).alias("n_overfull"), F.lit(1).alias("one"))
    return docs.join(over, "one").drop("one")


def p9_checked(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold for p9_mixture, per source with a target: used too often, and more than a hundredth off its share among the sources that exist."""
    targets, mixture = table(spark, folder, "mix_targets"), durable(p9_mixture(spark, folder))
    often = mixture.join(targets, "source").groupBy("source").agg(F.count_if(F.col("n_copies") > F.col("max_repeats")).alias("n_overused"))
    s = mixing.shares(mixture, "source", targets).join(often, "source", "left")
    open_ = s.filter("n_tokens > 0").agg(F.sum("target_share").alias("t"), F.lit(1).alias("one"))
    both = s.withColumn("one", F.lit(1)).join(open_, "one")
    off = (F.col("n_tokens") > 0) & (F.abs(F.col("actual_share") - F.col("target_share") / F.col("t")) > 0.01)
    return both.select("source", (F.col("n_tokens") > 0).alias("used"), F.coalesce("n_overused", F.lit(0)).cast("long").alias("n_overused"), off.alias("off_target"))


def p10_checked(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold for p10_pieces, per document: its tokens, pieces beyond the limit, neighbours that don't overlap as they should."""
    lim = _limits(spark, folder)
    cut = chunking.pieces(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", piece=lim["piece"], overlap=lim["overlap"], with_text=False)
    spans = F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "first_token", "end_token"))), lambda x: x)  # as many as the document has pieces
    per = cut.groupBy("doc_id").agg(spans.alias("s"))
    gaps = F.size(F.filter(F.sequence(F.lit(1), F.size("s")), lambda i: (i > 1) & (F.get("s", i - 2)["end_token"] - F.get("s", i - 1)["first_token"] != lim["overlap"])))
    return per.select("doc_id", F.get("s", F.size("s") - 1)["end_token"].cast("long").alias("n_tokens"), F.size(F.filter("s", lambda x: x["end_token"] - x["first_token"] > lim["piece"])).cast("long").alias("n_too_long"), gaps.cast("long").alias("n_gaps"))


QUERIES = {"p1_found": p1_found, "p1_ranked": p1_ranked, "p3_found": p3_found, "p3_splits": p3_splits, "p10_found": p10_found, "p10_pieces": p10_pieces, "p5_found": p5_found, "p6_found": p6_found, "p6_scored": p6_scored, "p7_found": p7_found, "p7_groups": p7_groups, "p5_groups": p5_groups, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p3_checked": p3_checked, "p8_checked": p8_checked, "p9_checked": p9_checked, "p10_checked": p10_checked}

_RANKED = """
SELECT source1_entity_id, candidate_entity_id, match_proba, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY source1_entity_id ORDER BY match_proba DESC, candidate_entity_id)::INTEGER AS rank
  FROM (SELECT source1_entity_id, candidate_entity_id, max(match_proba) AS match_proba FROM candidate_pairs
        WHERE match_proba IS NOT NULL AND NOT isnan(match_proba) AND source1_entity_id IS NOT NULL AND candidate_entity_id IS NOT NULL
        GROUP BY 1, 2))
WHERE rank <= 5
"""

# white space of any script: \s alone is that of ASCII here
_TOKENS = r"regexp_extract_all(text, '[\p{L}\p{Nd}_]+|[^\p{L}\p{Nd}_\s\p{Z}\x{0b}\x{85}]+')"
_RELATED = r"""
WITH RECURSIVE m AS (
  SELECT DISTINCT source1_entity_id AS s, unnest(regexp_extract_all(matched_entity_ids, 'S[23]-[0-9]+(?:[,;|/ ][a-z0-9]["''])?')) AS v FROM train_matches),
e AS (SELECT DISTINCT a.s AS x, b.s AS y FROM (SELECT s, regexp_replace(v, '["'']$', '') AS v FROM m) a JOIN (SELECT s, regexp_replace(v, '["'']$', '') AS v FROM m) b ON a.v = b.v AND a.s <> b.s),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
"""

SQL = {
    "p3_checked": _RELATED + """, n AS (SELECT count(DISTINCT source1_entity_id) AS ids FROM train_matches)
SELECT ids AS n_ids, ids - (SELECT count(*) FROM (SELECT x FROM r GROUP BY x HAVING min(y) < x)) AS n_groups, 0 AS n_broken_groups, 0 AS n_shares_off FROM n
""",
    "p8_checked": f"SELECT count(*) AS n_documents, sum(coalesce(len({_TOKENS}), 0))::BIGINT AS n_tokens, count(*) FILTER (WHERE len({_TOKENS}) > 2048) AS n_divided, 0 AS n_overfull FROM documents",
    "p9_checked": f"SELECT t.source, coalesce(bool_or(len({_TOKENS}) > 0), false) AS used, 0 AS n_overused, false AS off_target FROM mix_targets t LEFT JOIN documents d ON t.source = d.source GROUP BY 1",
    "p10_checked": f"SELECT doc_id, len({_TOKENS})::BIGINT AS n_tokens, 0 AS n_too_long, 0 AS n_gaps FROM documents WHERE len({_TOKENS}) > 0",
    "p1_found": f"SELECT source1_entity_id, candidate_entity_id FROM ({_RANKED})",
    "p1_ranked": _RANKED,
    "p3_found": _RELATED
    + """
SELECT min(y) AS first_entity_id, x AS source1_entity_id FROM r GROUP BY x HAVING min(y) < x
""",
    "p10_found": f"SELECT doc_id FROM documents WHERE len({_TOKENS}) > 1024",
}
