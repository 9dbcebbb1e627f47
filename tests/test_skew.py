import random

from linkwright.operators.skew import frequent, per_key


def brute(data):
    out = {}
    for k, o in data:
        out.setdefault(k, []).append(o)
    want = {}
    for k, v in out.items():
        x = sorted(o for o in v if o is not None)
        gap = max([b - a for a, b in zip(x, x[1:])], default=0)
        want[k] = (len(v), x[0] if x else None, x[-1] if x else None, gap)
    return want


def test_against_brute_force(spark):
    rng = random.Random(2)
    data = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None, ""]), rng.choice([None, rng.randrange(1000)])) for _ in range(5000)]
    df = spark.createDataFrame(data, "key string, ord long").withColumnRenamed("ord", "n")  # a column named like a result
    got = {r["key"]: (r["n"], r["first_ord"], r["last_ord"], r["max_gap"]) for r in per_key(df, "key", "n", partitions=7).collect()}
    assert got == brute(data)


def test_hot_key_is_spread(spark):
    df = spark.range(20_000).selectExpr("if(id % 10 < 8, 'hot', cast(id as string)) as k", "id as o")
    hot = {r["key"]: r for r in per_key(df, "k", "o", partitions=8).collect()}["hot"]
    assert hot["n_parts"] >= 5 and hot["n"] == 16_000 and hot["max_gap"] == 3


def test_hot_key_of_ties_is_spread(spark):
    """Orders that are all the same, or all null, do not keep a key in one task."""
    df = spark.range(20_000).selectExpr("if(id % 10 < 8, 'tied', 'null') as k", "if(id % 10 < 8, 5L, null) as o")
    got = {r["key"]: r for r in per_key(df, "k", "o", partitions=8).collect()}
    assert got["tied"]["n_parts"] >= 4 and got["null"]["n_parts"] >= 2
    assert (got["tied"]["n"], got["tied"]["first_ord"], got["tied"]["max_gap"]) == (16_000, 5, 0)
    assert (got["null"]["n"], got["null"]["first_ord"], got["null"]["last_ord"]) == (4_000, None, None)


def test_small_batches(spark):
    """Keys that reach over Arrow batches keep one state."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        data = [("k", i) for i in range(20)] + [("j", None)]
        got = {r["key"]: (r["n"], r["first_ord"], r["last_ord"], r["max_gap"]) for r in per_key(spark.createDataFrame(data, "k string, o long"), "k", "o", partitions=2).collect()}
        assert got == brute(data)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_empty_and_shares(spark):
    empty = spark.createDataFrame([], "k string, o long")
    assert per_key(empty, "k", "o").count() == 0
    per = spark.createDataFrame([("f", "a", 2), ("f", "b", 1), ("f", None, 97), ("g", "x", 1)], "g string, key string, n long")
    assert {(r["g"], r["key"]) for r in frequent(per, 0.02, group="g").collect()} == {("f", "a"), ("g", "x")}
