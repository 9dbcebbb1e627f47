"""The linkage pipeline against plain Python on small tables."""

import pytest
from pyspark.sql import functions as F

from linkwright.config import Settings
from linkwright.operators import blocking, emit, evaluate, features, pairs, profile, tfidf

NORM = "entity_id string, name_norm string, address_norm string, country_norm string"


@pytest.fixture
def norms(spark):
    s1 = spark.createDataFrame([("S1-1", "acme foods limited", "12 main road 56001", "us"), ("S1-2", "zeta", "", "in"), ("S1-3", "", "", "")], NORM)
    s2 = spark.createDataFrame([(f"S2-{i}", "acme foods limited", f"{i} main road 56001", "us") for i in range(6)] + [("S2-9", "foods acme", "", "us")], NORM)
    s3 = spark.createDataFrame([("S3-1", "zetta", "7 zeta lane", "in"), ("S3-2", "", "", "")], NORM)
    return s1, s2, s3


def test_latest(spark, rows):
    df = spark.createDataFrame([("a", "x", None, None, 1), ("a", "y", None, None, 2), ("a", "y", None, None, 2), (None, "z", None, None, 3)], "entity_id string, business_name string, business_address string, country string, t long")
    got = blocking.latest(df.withColumn("loaded_at", F.timestamp_seconds("t")))
    assert rows(got) == [("a", "y", "", "")]
    assert blocking.latest(df.limit(0)).count() == 0


def test_hot_keys_are_left_out(norms):
    s1, s2, s3 = norms
    tight = {tuple(r) for r in blocking.candidates(s1, s2, s3, Settings(max_posting=5)).select("source1_entity_id", "candidate_entity_id").collect()}
    loose = {tuple(r) for r in blocking.candidates(s1, s2, s3, Settings(max_posting=10)).select("source1_entity_id", "candidate_entity_id").collect()}
    assert ("S1-1", "S2-0") not in tight and ("S1-2", "S3-1") in tight
    assert ("S1-1", "S2-0") in loose and ("S1-1", "S2-9") in loose
    assert not any(a == "S1-3" or b == "S3-2" for a, b in loose)  # empty records share nothing


def test_first_strategy_of_a_family_wins(norms):
    c = {(r[0], r[1]): r[2] for r in blocking.candidates(*norms).collect()}
    assert c["S1-1", "S2-0"] == "B1_name_exact,B5_numeric_token" or c["S1-1", "S2-0"].startswith("B1_name_exact,B4")
    assert all(len(t.split(",")) <= 2 for t in c.values())
    assert c["S1-1", "S2-9"].startswith("B2_name_token")


def test_top_k_and_ties(norms):
    k = blocking.candidates(*norms, Settings(max_candidates=3)).filter("source1_entity_id = 'S1-1'")
    assert sorted(r[1] for r in k.collect()) == ["S2-0", "S2-1", "S2-2"]  # equal overlap: smaller id


def test_empty_tables(norms):
    s1, s2, s3 = (n.limit(0) for n in norms)
    assert blocking.candidates(s1, s2, s3).count() == 0


LABELS = [("S1-1", "S2-0,S2-1,S2-77"), ("S1-1", "S2-1 , S2-2,"), ("S1-2", None), ("S1-3", "none")]


def test_labels(spark, norms, rows):
    labels = spark.createDataFrame(LABELS, "source1_entity_id string, matched_entity_ids string")
    assert pairs.label_rows(labels).count() == 5
    truth, ents = pairs.label_sets(labels), pairs.label_entities(labels)
    assert truth.count() == 4 and ents.count() == 3
    cands = blocking.candidates(*norms)
    assert rows(pairs.missed(truth, cands)) == [("S1-1", "S2-77")]
    r = pairs.blocking_recall(truth, cands).collect()[0]
    assert (r["n_positives"], r["n_recovered"], r["recall"]) == (4, 3, 0.75)
    lab = pairs.labelled_pairs(cands, truth, ents, Settings(negatives_per_entity=2)).collect()
    assert sum(r["label"] for r in lab) == 3 and sum(1 - r["label"] for r in lab if r["source1_entity_id"] == "S1-1") == 2
    assert len({r["split"] for r in lab if r["source1_entity_id"] == "S1-1"}) == 1
    assert pairs.split_entities(ents).filter("split = 'val'").count() == 1
    p = profile.label_profile(labels).collect()[0]
    assert (p["n_rows"], p["n_source1"], p["n_duplicate_rows"], p["n_zero"], p["n_matched"]) == (4, 3, 1, 2, 5)


def test_features(spark, norms):
    s1, s2, s3 = norms
    p = spark.createDataFrame([("S1-1", "S2-9"), ("S1-3", "S3-2"), ("S1-1", "S2-404")], "source1_entity_id string, candidate_entity_id string")
    f = {r[0] + r[1]: r for r in features.string_features(features.with_attributes(p, s1, s2.unionByName(s3))).collect()}
    a = f["S1-1S2-9"]
    assert (a["name_token_jaccard"], a["name_token_overlap"], a["country_same"]) == (2 / 3, 1.0, 1)
    assert f["S1-3S3-2"]["name_len_ratio"] == 1.0 and f["S1-3S3-2"]["name_exact"] == 0
    assert f["S1-1S2-404"]["name_token_jaccard"] == 0.0 and f["S1-1S2-404"]["name2"] == ""
    bad = spark.createDataFrame([(1.0, None), (float("nan"), 2.0)], "x double, y double")
    assert features.null_features(bad, ["x", "y"]).collect()[0]["n_null"] == 2


def test_tfidf_against_plain_python(spark):
    import math
    from collections import Counter

    texts = ["acme foods", "acme co", "zeta foods", "a", ""]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "entity_id string, t string")
    grams = lambda t: [w[i : i + n] for w in (f" {x} " for x in t.split()) for n in (2, 3, 4) for i in range(len(w) - n + 1)]
    terms = tfidf.fit(df, "t", Settings(tfidf_min_df=2))
    dfs = Counter(g for t in texts for g in set(grams(t)))
    want = {g: (n, sum(grams(t).count(g) for t in texts), math.log(6 / (1 + n)) + 1) for g, n in dfs.items() if n >= 2}
    got = {r["term"]: (r["df"], r["tf"], r["idf"]) for r in terms.collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)
    w = {r["entity_id"]: r["w"] for r in tfidf.weights(df, "t", terms).collect()}
    assert all(sum(x * x for x in m.values()) == pytest.approx(1) for m in w.values()) and "4" not in w


def test_f05_of_the_worked_case(spark):
    p, r = 0.75, 0.6
    got = spark.range(1).select(evaluate.f05(F.lit(p), F.lit(r)).alias("f")).collect()[0]["f"]
    assert got == pytest.approx(0.714, abs=5e-4)


def test_entity_metrics(spark, rows):
    pair = "source1_entity_id string, candidate_entity_id string"
    ents = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "source1_entity_id string")
    truth = spark.createDataFrame([("a", "1"), ("a", "2"), ("d", "9")], pair)
    pred = spark.createDataFrame([("a", "1"), ("b", "5")], pair)
    got = {r[0]: (r["precision"], r["recall"], round(r["f05"], 4)) for r in evaluate.entity_metrics(pred, truth, ents).collect()}
    assert got == {"a": (1.0, 0.5, 0.8333), "b": (0.0, 1.0, 0.0), "c": (1.0, 1.0, 1.0), "d": (0.0, 0.0, 0.0)}
    with pytest.raises(ValueError):
        evaluate.entity_metrics(spark.createDataFrame([("zz", "1")], pair), truth, ents)


def test_sweep_and_ties(spark):
    s = spark.createDataFrame([("a", "1", 0.9), ("a", "2", 0.4), ("b", "3", 0.35)], "source1_entity_id string, candidate_entity_id string, match_proba double")
    truth = spark.createDataFrame([("a", "1")], "source1_entity_id string, candidate_entity_id string")
    ents = s.select("source1_entity_id").distinct()
    swept = evaluate.sweep(s, truth, ents)
    assert swept.count() == 14
    assert tuple(evaluate.best_threshold(swept).collect()[0]) == (0.45, 1.0)  # the lowest of the perfect ones
    assert [r["candidate_entity_id"] for r in evaluate.false_positives(s, truth, 0.3).collect()] == ["2", "3"]


def test_results(spark, norms, rows):
    cands = blocking.candidates(*norms)
    pred = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-0"), ("S1-1", "S2-555"), ("S1-1", "S2-0")], "source1_entity_id string, candidate_entity_id string")
    out = emit.matching_results(norms[0], pred, cands)
    assert rows(out) == [("S1-1", "S2-0,S2-1"), ("S1-2", ""), ("S1-3", "")]
    assert tuple(emit.result_summary(out).collect()[0]) == (3, 1, 2)
