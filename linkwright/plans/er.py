"""Queries of the linkage pipeline over the source tables, with the SQL they are checked against.

Every query runs over its whole tables. Source tables enter the pipeline as the latest row of
each id (`blocking.latest`); label lists enter as the values `unpack` finds in them. Profile
queries read the tables as delivered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.config import DEFAULT, PREFIX
from linkwright.functions import text
from linkwright.operators import blocking, emit, evaluate, features, pairs, profile, tfidf, validate
from linkwright.operators.packed import unpack
from linkwright.operators.storage import durable
from linkwright.plans import er_sql
from linkwright.plans.general import VALUE_START
from linkwright.sources.tables import table

THRESHOLD = DEFAULT.default_threshold


class Stage:
    """The pipeline's tables over one folder. Normalised records, their keys and their words are made once and
    written; everything else is lazy."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            self._made[name] = durable(build())
        return self._made[name]

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, f"train_{name}")

    def fresh(self, name: str) -> DataFrame:
        """The normalised table, for queries that read it once."""
        return blocking.normalized(blocking.latest(self.raw(name)))

    def norm(self, name: str) -> DataFrame:
        return self.once(name, lambda: self.fresh(name))

    def others(self) -> DataFrame:
        return self.norm("source2").unionByName(self.norm("source3"))

    def keys(self, name: str, tags: list[str] | None = None) -> DataFrame:
        return blocking.block_keys(self.fresh(name), tags)

    def labels(self) -> DataFrame:
        return self.raw("matches")

    def truth(self) -> DataFrame:
        return unpack(self.labels(), ["source1_entity_id"], "matched_entity_ids", VALUE_START, value="candidate_entity_id").drop("value_pos").distinct()

    def entities(self) -> DataFrame:
        return pairs.label_entities(self.labels())

    def raw_pairs(self, tags: list[str] | None = None) -> DataFrame:
        both = [blocking.raw_pairs(self.keys("source1", tags), self.keys(s, tags), DEFAULT.max_posting) for s in ("source2", "source3")]
        return both[0].unionByName(both[1])

    def candidates(self) -> DataFrame:
        return self.once("candidates", lambda: blocking.candidates(self.norm("source1"), self.norm("source2"), self.norm("source3")))

    def labelled(self, cands: DataFrame) -> DataFrame:
        return pairs.labelled_pairs(cands, self.truth(), self.entities())

    def scored(self, p: DataFrame) -> DataFrame:
        s = features.string_features(features.with_attributes(p, self.norm("source1"), self.others()))
        return features.closed_form_score(s)

    def validation(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Scored validation pairs, their entities and the truth of these."""
        val = durable(self.scored(self.labelled(self.candidates()).filter("split = 'val'")))
        ents = val.select("source1_entity_id").distinct()
        return val, ents, self.truth().join(ents, "source1_entity_id", "left_semi")

    def results(self) -> tuple[DataFrame, DataFrame]:
        """Match lists and candidates of all source1 records."""
        c = self.candidates()
        return emit.matching_results(self.raw("source1"), evaluate.predictions(self.scored(c), THRESHOLD), c), c


def _over_sources(f):
    """One query over the three sources, results marked with the source."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        st, out = Stage(spark, folder), None
        for s in PREFIX:
            one = f(st, s).select(F.lit(s).alias("source"), "*")
            out = one if out is None else out.unionByName(one)
        return out

    return run


def _on(f):
    return lambda spark, folder: f(Stage(spark, folder))


def _block(tag: str):
    return _on(lambda st: st.raw_pairs([tag]).select("source1_entity_id", "candidate_entity_id").distinct())


def _tokens(column: str, keys) -> object:
    listed = lambda c: F.array_join(F.array_sort(keys(c)), " ")
    return _over_sources(lambda st, s: st.fresh(s).select("entity_id", listed(F.col(column)).alias("tokens")))


def _na_policy(st: Stage, s: str) -> DataFrame:
    cols = ["business_name", "business_address", "country"]
    return st.raw(s).select(*[text.na_to_null(F.col(c)).alias(c) for c in cols]).agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in cols])


def _normalized_texts(column: str, f):
    """Distinct values of the three sources, with their normal form."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        st, out = Stage(spark, folder), None
        for s in PREFIX:
            v = st.raw(s).select(F.col(column).alias("v"))
            out = v if out is None else out.unionByName(v)
        return out.distinct().select(F.md5(F.coalesce("v", F.lit("~"))).alias("value_md5"), f(F.col("v")).alias("norm"))

    return run


def _label_lists(st: Stage) -> DataFrame:
    """Delivered label lists as result lists, which the validator's rules judge."""
    return st.labels().select("source1_entity_id", F.coalesce("matched_entity_ids", F.lit("")).alias("matched_entity_ids"))


def _targets(st: Stage) -> DataFrame:
    return st.raw("source2").select("entity_id").unionByName(st.raw("source3").select("entity_id"))


def _candidate_table(st: Stage) -> DataFrame:
    """The delivered candidates as lists."""
    c = table(st.spark, st.folder, "candidate_pairs", "source1_entity_id", "candidate_entity_id")
    return emit.candidate_lists(c)


def _label_pairs(st: Stage) -> DataFrame:
    """All label pairs; pairs of which a record is unknown keep '' as attributes."""
    return st.truth()


def _all_pairs(st: Stage) -> DataFrame:
    """Every pair that training or scoring can see: all candidates, and the label pairs blocking missed."""
    return st.candidates().select(*pairs.KEYS).unionByName(_label_pairs(st)).distinct()


def _validation_query(f):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        val, ents, truth = Stage(spark, folder).validation()
        return f(val, ents, truth)

    return run


def _metrics(val: DataFrame, ents: DataFrame, truth: DataFrame) -> DataFrame:
    return evaluate.macro(evaluate.entity_metrics(evaluate.predictions(val, THRESHOLD), truth, ents))


def _rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*pairs.KEYS, *[F.round(F.col(c).cast("double"), 6).alias(c) for c in columns])


def _attributes(st: Stage, p: DataFrame) -> DataFrame:
    return features.with_attributes(p, st.norm("source1"), st.others())


def _label_features(st: Stage) -> DataFrame:
    return features.string_features(_attributes(st, _label_pairs(st)))


def _all_features(st: Stage) -> DataFrame:
    return features.string_features(_attributes(st, _all_pairs(st)))


def _names_corpus(st: Stage) -> DataFrame:
    return st.norm("source1").unionByName(st.others())


def _tfidf_cosine(st: Stage, p: DataFrame) -> DataFrame:
    terms = tfidf.fit(_names_corpus(st), "name_norm")
    return _rounded(_attributes(st, p).select(*pairs.KEYS, tfidf.cosine("name1", "name2", terms).alias("cosine")), ["cosine"])


def _matrix(st: Stage) -> DataFrame:
    corpus = _names_corpus(st)
    p = durable(st.labelled(st.candidates()))
    return features.feature_matrix(p, st.norm("source1"), st.others(), tfidf.fit(corpus, "name_norm"), tfidf.fit(corpus, "address_norm"))


QUERIES = {
    # text and profile
    "er_na_policy": _over_sources(_na_policy),
    "er_null_profile": _over_sources(lambda st, s: profile.null_profile(st.raw(s), ["entity_id", "business_name", "business_address", "country"])),
    "er_prefix_check": _over_sources(lambda st, s: st.raw(s).groupBy(F.col("entity_id").startswith(PREFIX[s]).alias("has_prefix")).agg(F.count("*").alias("n_rows"))),
    "er_normalize_name": _normalized_texts("business_name", text.normalize_name),
    "er_normalize_address": _normalized_texts("business_address", text.normalize_address),
    "er_normalize_country": _normalized_texts("country", text.normalize_country),
    "er_normalized_table": _over_sources(lambda st, s: st.fresh(s)),
    "er_sig_name_tokens": _tokens("name_norm", text.name_tokens),
    "er_sig_addr_tokens": _tokens("address_norm", text.address_tokens),
    "er_numeric_tokens": _over_sources(lambda st, s: st.fresh(s).select("entity_id", F.array_join(F.array_sort(text.numeric_tokens(F.col("name_norm"), F.col("address_norm"))), " ").alias("tokens"))),
    "er_sample_rows": _over_sources(lambda st, s: profile.sample_rows(st.raw(s))),
    "er_profile_source": _over_sources(lambda st, s: profile.source_profile(st.raw(s), PREFIX[s])),
    "er_country_hist": _over_sources(lambda st, s: profile.country_histogram(st.raw(s))),
    "er_gt_explode": _on(lambda st: pairs.label_rows(st.labels())),
    "er_gt_sets": _on(lambda st: st.entities().join(st.truth(), "source1_entity_id", "left")),
    "er_gt_profile": _on(lambda st: profile.label_profile(st.labels())),
    "er_match_hist": _on(lambda st: profile.match_histogram(st.labels())),
    "er_id_coverage": _on(lambda st: profile.id_coverage(st.raw("source1"), st.labels())),
    "er_cartesian_size": _on(lambda st: st.spark.createDataFrame([(profile.cartesian_size(st.raw("source1"), st.raw("source2"), st.raw("source3")),)], "n_pairs long")),
    "er_union_sources": _on(lambda st: _names_corpus(st).groupBy(F.substring("entity_id", 1, 3).alias("prefix")).agg(F.count("*").alias("n_records"), F.countDistinct("name_norm").alias("n_names"))),
    # blocking
    "er_block_b1": _block("B1_name_exact"),
    "er_block_b2": _block("B2_name_token"),
    "er_block_b3": _block("B3_name_trigram"),
    "er_block_b4": _block("B4_address_token"),
    "er_block_b5": _block("B5_numeric_token"),
    "er_block_b6": _block("B6_country_name_combo"),
    "er_posting_stats": lambda spark, folder: _posting_stats(Stage(spark, folder)),
    "er_name_pairs": _on(lambda st: blocking.family_pairs(st.raw_pairs(["B1_name_exact", "B2_name_token", "B3_name_trigram"])).drop("family")),
    "er_addr_pairs": _on(lambda st: blocking.family_pairs(st.raw_pairs(["B4_address_token", "B5_numeric_token", "B6_country_name_combo"])).drop("family")),
    "er_candidates_raw": _on(lambda st: blocking.merged(st.raw_pairs())),
    "er_prerank": _on(lambda st: blocking.ranked(blocking.merged(st.raw_pairs()), st.norm("source1"), st.others()).select(*pairs.KEYS, F.round("jaccard", 6).alias("jaccard"))),
    "er_candidates_topk": _on(lambda st: st.candidates().select(*pairs.KEYS)),
    "er_candidates": _on(lambda st: st.candidates()),
    "er_candidate_lists": _on(lambda st: emit.candidate_lists(st.candidates())),
    "er_recovered_pairs": _on(lambda st: pairs.recovered(st.truth(), st.candidates())),
    "er_missed_pairs": _on(lambda st: pairs.missed(st.truth(), st.candidates())),
    "er_blocking_recall": _on(lambda st: pairs.blocking_recall(st.truth(), st.candidates())),
    "er_strategy_counts": _on(lambda st: pairs.strategy_counts(st.candidates())),
    # pairs and features
    "er_split": _on(lambda st: pairs.split_entities(st.entities())),
    "er_hard_negatives": _on(lambda st: pairs.hard_negatives(st.candidates(), st.truth(), st.entities())),
    "er_neg_sample": _on(lambda st: pairs.sampled_negatives(pairs.hard_negatives(st.candidates(), st.truth(), st.entities()))),
    "er_pair_stats": _on(lambda st: pairs.pair_stats(st.labelled(st.candidates()))),
    "er_pair_attrs": _on(lambda st: _attributes(st, _label_pairs(st))),
    "er_features_exact": _on(lambda st: _label_features(st).select(*pairs.KEYS, *features.EXACT)),
    "er_features_token": _on(lambda st: _rounded(_label_features(st), features.TOKEN)),
    "er_features_structure": _on(lambda st: _rounded(_label_features(st), features.STRUCTURE)),
    "er_feature_nulls": _on(lambda st: features.null_features(_label_features(st), [*features.EXACT, *features.TOKEN, *features.STRUCTURE])),
    "er_features_fuzzy": _on(lambda st: _rounded(features.with_fuzzy(_attributes(st, _all_pairs(st))), features.FUZZY)),
    "er_feature_matrix": _on(_matrix),
    # the same over all candidates and label pairs
    "er_all_pair_attrs": _on(lambda st: _attributes(st, _all_pairs(st))),
    "er_all_features_exact": _on(lambda st: _all_features(st).select(*pairs.KEYS, *features.EXACT)),
    "er_all_features_token": _on(lambda st: _rounded(_all_features(st), features.TOKEN)),
    "er_all_features_structure": _on(lambda st: _rounded(_all_features(st), features.STRUCTURE)),
    "er_all_feature_nulls": _on(lambda st: features.null_features(_all_features(st), [*features.EXACT, *features.TOKEN, *features.STRUCTURE])),
    "er_all_tfidf_cosine": _on(lambda st: _tfidf_cosine(st, _all_pairs(st))),
    # TF-IDF, scores, evaluation
    "er_tfidf_vocab": _on(lambda st: tfidf.fit(_names_corpus(st), "name_norm").select("term", "df", "tf", F.round("idf", 6).alias("idf"))),
    "er_tfidf_addr_vocab": _on(lambda st: tfidf.fit(_names_corpus(st), "address_norm").select("term", "df", "tf", F.round("idf", 6).alias("idf"))),
    "er_tfidf_cosine": _on(lambda st: _tfidf_cosine(st, _label_pairs(st))),
    "er_predictions": _validation_query(lambda val, ents, truth: evaluate.predictions(val, THRESHOLD)),
    "er_entity_f05": _validation_query(_metrics),
    "er_threshold_sweep": _validation_query(lambda val, ents, truth: evaluate.sweep(val, truth, ents)),
    "er_best_threshold": _validation_query(lambda val, ents, truth: evaluate.best_threshold(evaluate.sweep(val, truth, ents))),
    "er_error_fp": _validation_query(lambda val, ents, truth: evaluate.false_positives(val, truth, THRESHOLD)),
    "er_error_fn": _validation_query(lambda val, ents, truth: evaluate.false_negatives(val, truth, ents, THRESHOLD)),
    "er_singleton_merges": _validation_query(lambda val, ents, truth: evaluate.singleton_merges(evaluate.predictions(val, THRESHOLD), truth, ents)),
    "er_matching_results": _on(lambda st: st.results()[0]),
    "er_result_summary": _on(lambda st: emit.result_summary(st.results()[0])),
    # validation of lists
    "er_validate_dups": _on(lambda st: validate.duplicate_rows(_label_lists(st)).unionByName(validate.repeated_ids(_label_lists(st), "matched_entity_ids"))),
    "er_validate_prefix": _on(lambda st: validate.wrong_prefixes(_label_lists(st), "matched_entity_ids")),
    "er_validate_missing": _on(lambda st: validate.missing_rows(_label_lists(st), st.raw("source1"))),
    "er_validate_unknown": _on(lambda st: validate.unknown_ids(_label_lists(st), "matched_entity_ids", _targets(st))),
    "er_validate_subset": _on(lambda st: validate.not_candidates(_label_lists(st), _candidate_table(st))),
    "er_validate_summary": _on(lambda st: validate.summary(validate.all_findings(_label_lists(st), "matched_entity_ids", st.raw("source1"), _targets(st)))),
}


def _posting_stats(st: Stage) -> DataFrame:
    out = None
    for s in ("source2", "source3"):
        one = blocking.posting_stats(st.keys(s), DEFAULT.max_posting).select(F.lit(s).alias("source"), "*")
        out = one if out is None else out.unionByName(one)
    return out


SQL = er_sql.SQL
