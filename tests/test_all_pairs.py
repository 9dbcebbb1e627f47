"""Features over all candidates and label pairs."""

import os

import pytest
import test_catalog

import __spark_entry__ as entry
from linkwright.operators.pairs import KEYS

ALL = ["er_all_pair_attrs", "er_all_features_exact", "er_all_features_token", "er_all_features_structure", "er_all_feature_nulls", "er_all_tfidf_cosine"]


@pytest.mark.skipif(not os.path.isdir(test_catalog.SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ALL)
def test_all_pairs_same_as_sql(spark, name):
    test_catalog.test_same_as_sql(spark, name)


@pytest.mark.skipif(not os.path.isdir(test_catalog.SMALL), reason="no test tables")
def test_fuzzy_ratios_of_every_candidate(spark):
    q = entry.queries()
    keys = lambda name: [tuple(r) for r in q[name](spark, test_catalog.SMALL).select(*KEYS).collect()]
    got = keys("er_features_fuzzy")
    assert len(got) == len(set(got)) and set(got) == set(keys("er_candidates")) | set(keys("er_pair_attrs"))


@pytest.mark.skipif(not os.path.isdir(test_catalog.SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["er_all_tfidf_cosine", "er_tfidf_cosine", "er_feature_matrix", "er_prerank"])
def test_records_of_pairs_are_not_broadcast(spark, name):
    df = entry.queries()[name](spark, test_catalog.SMALL)
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
