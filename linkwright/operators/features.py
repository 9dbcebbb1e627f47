"""Pair features: attributes joined once per side, then column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.functions import text
from linkwright.functions.fuzzy import FUZZY, fuzzy_features
from linkwright.operators.blocking import jaccard
from linkwright.operators.pairs import KEYS
from linkwright.operators.storage import merging
from linkwright.operators.tfidf import cosine

ATTRIBUTES = ["name1", "addr1", "country1", "name2", "addr2", "country2"]
EXACT = ["name_exact", "addr_exact", "country_same"]
TOKEN = ["name_token_jaccard", "name_token_overlap", "addr_token_jaccard", "num_shared_numeric"]
STRUCTURE = ["name_len_ratio", "addr_len_ratio", "name_tok_count_diff", "addr_tok_count_diff"]
TFIDF = ["name_tfidf_cosine", "addr_tfidf_cosine"]
ALL = [*EXACT, *TOKEN, *STRUCTURE, *FUZZY, *TFIDF]


def with_attributes(pairs: DataFrame, s1: DataFrame, others: DataFrame) -> DataFrame:
    """`pairs` with both records' normalised texts; '' where a record is unknown."""
    side = lambda n, key, i: n.select(F.col("entity_id").alias(key), F.col("name_norm").alias(f"name{i}"), F.col("address_norm").alias(f"addr{i}"), F.col("country_norm").alias(f"country{i}"))
    both = pairs.join(merging(side(s1, KEYS[0], 1)), KEYS[0], "left").join(merging(side(others, KEYS[1], 2)), KEYS[1], "left")
    return both.select(*pairs.columns, *[F.coalesce(c, F.lit("")).alias(c) for c in ATTRIBUTES])


def _equal(a: str, b: str) -> Column:
    return ((F.col(a) == F.col(b)) & (F.col(a) != "")).cast("int")


def _overlap(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def _length_ratio(a: str, b: str) -> Column:
    x, y = F.length(a), F.length(b)
    return F.when((x == 0) & (y == 0), 1.0).when((x == 0) | (y == 0), 0.0).otherwise(F.least(x, y) / F.greatest(x, y))


def string_features(pairs: DataFrame) -> DataFrame:
    """`pairs` (with attributes) and the features that built-in functions express."""
    words = lambda c: F.array_distinct(text.tokens(F.col(c)))
    numbers = lambda n, a: F.filter(text.numeric_tokens(F.col(n), F.col(a)), lambda t: F.length(t) >= 3)
    t = pairs.withColumns({"__n1": words("name1"), "__n2": words("name2"), "__a1": words("addr1"), "__a2": words("addr2"), "__d1": numbers("name1", "addr1"), "__d2": numbers("name2", "addr2")})
    n1, n2, a1, a2 = (F.col(f"__{x}") for x in ("n1", "n2", "a1", "a2"))
    out = t.withColumns(
        {
            "name_exact": _equal("name1", "name2"),
            "addr_exact": _equal("addr1", "addr2"),
            "country_same": _equal("country1", "country2"),
            "name_token_jaccard": jaccard(n1, n2),
            "name_token_overlap": _overlap(n1, n2),
            "addr_token_jaccard": jaccard(a1, a2),
            "num_shared_numeric": F.size(F.array_intersect("__d1", "__d2")),
            "name_len_ratio": _length_ratio("name1", "name2"),
            "addr_len_ratio": _length_ratio("addr1", "addr2"),
            "name_tok_count_diff": F.abs(F.size(n1) - F.size(n2)),
            "addr_tok_count_diff": F.abs(F.size(a1) - F.size(a2)),
        }
    )
    return out.drop("__n1", "__n2", "__a1", "__a2", "__d1", "__d2")


def with_fuzzy(pairs: DataFrame) -> DataFrame:
    """`pairs` (with attributes) and the four fuzzy ratios, one Python crossing per pair."""
    return pairs.withColumn("__f", fuzzy_features("name1", "name2", "addr1", "addr2")).select("*", *[F.col(f"__f.{c}").alias(c) for c in FUZZY]).drop("__f")


def null_features(features: DataFrame, columns: list[str]) -> DataFrame:
    """(n_null): null or NaN values among the feature columns; must be 0 before a matrix is written."""
    bad = [F.sum((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("long")) for c in columns]
    total = bad[0]
    for b in bad[1:]:
        total = total + b
    return features.agg(F.coalesce(total, F.lit(0)).alias("n_null"))


def closed_form_score(features: DataFrame) -> DataFrame:
    """`features` with `match_proba`, a fixed weighting that needs no training (weights add up to 1)."""
    s = (
        0.35 * F.col("name_token_jaccard") + 0.15 * F.col("name_token_overlap") + 0.25 * F.col("addr_token_jaccard")
        + 0.15 * F.least(F.col("num_shared_numeric"), F.lit(1)) + 0.10 * F.col("country_same")
    )
    return features.withColumn("match_proba", F.round(s, 6))


def feature_matrix(pairs: DataFrame, s1: DataFrame, others: DataFrame, name_terms: DataFrame, addr_terms: DataFrame) -> DataFrame:
    """Keys, all 17 features as float and, where `pairs` has one, the label.

    name_terms, addr_terms: fitted vocabularies (`tfidf.fit`), never fitted here.
    """
    full = with_fuzzy(string_features(with_attributes(pairs, s1, others)))
    full = full.withColumns({"name_tfidf_cosine": cosine("name1", "name2", name_terms), "addr_tfidf_cosine": cosine("addr1", "addr2", addr_terms)})
    kept = [c for c in ("label", "split") if c in pairs.columns]
    return full.select(*KEYS, *[F.col(c).cast("float").alias(c) for c in ALL], *kept)
