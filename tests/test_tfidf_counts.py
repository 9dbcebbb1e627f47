"""Counting the terms of many texts: no row per text and term, the same counts in any batches."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkwright.config import Settings
from linkwright.operators import tfidf


def test_terms_of_a_text_are_no_rows(spark):
    texts = ["acme foods", "acme foods", "acme  co", "été 😀x", "zeta", "", "aaaa aaaa"] * 3
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    every = Counter(g for t in texts for g in tfidf._grams(t, 2, 4))
    some = Counter(g for t in texts for g in set(tfidf._grams(t, 2, 4)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        terms = tfidf.fit(df, "t", Settings(tfidf_min_df=1))
        assert {r["term"]: (r["df"], r["tf"]) for r in terms.collect()} == {g: (some[g], every[g]) for g in every}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    in_sql = df.select(F.explode(tfidf.ngrams(F.col("t"), 2, 4)).alias("g")).groupBy("g").count()
    assert {r["g"]: r["count"] for r in in_sql.collect()} == every
    # as rows they were grouped by text and term, which took 3 GB of an executor for 0.06 GB of input
    assert "Generate" not in terms._jdf.queryExecution().executedPlan().toString()


def test_tasks_do_not_send_their_terms_to_the_driver(spark, monkeypatch):
    sent = []
    durable = tfidf.durable if hasattr(tfidf, "durable") else None
    assert durable is not None
    monkeypatch.setattr(tfidf, "durable", lambda df: sent.append(durable(df)) or sent[-1])
    df = spark.createDataFrame([("ab cd", "ab"), ("ab", "zz"), ("", "ab")], "a string, b string")
    got = df.select(tfidf.cosine("a", "b", tfidf.fit(df, "a", Settings(tfidf_min_df=1))).alias("x")).collect()
    assert [r["x"] > 0 for r in got] == [True, False, False] and got[0]["x"] == pytest.approx(2**-0.5, abs=0.2)
    assert len(sent) == 1 and "TakeOrdered" not in sent[0]._jdf.queryExecution().executedPlan().toString()
