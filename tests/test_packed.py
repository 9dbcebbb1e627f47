import pytest

from linkwright.operators.packed import unpack

CASES = [
    ("S2-1,S3-2", ["S2-1", "S3-2"]),
    (' S2-1;; S3-2 | S2-1.', ["S2-1", "S3-2", "S2-1"]),
    ('"S3-1,b" & S2-2', ["S3-1,b", "S2-2"]),
    ("'S3-1 c'/S2-2", ["S3-1 c", "S2-2"]),
    ('"S2-1;S3-2;S2-1"', ["S2-1", "S3-2", "S2-1"]),
    ('["S2-1", "S3-2|d"]', ["S2-1", "S3-2|d"]),
    ("{S2-1,S3-2}", ["S2-1", "S3-2"]),
    ("S2-1，S3-2\tS2-3\nS2-4", ["S2-1", "S3-2", "S2-3", "S2-4"]),
    ('"S2-1', ["S2-1"]),
    ('S2-1"S3-2"', ["S2-1", "S3-2"]), ('"S3-2"S2-1', ["S3-2", "S2-1"]), ('S2-1"S3-2;S2-3"S2-4', ["S2-1", "S3-2", "S2-3", "S2-4"]),
    ("S2-10", ["S2-10"]),
    ("none", []), ("", []), ('""', []), ("[]", []), (",", []), (None, []), ("NA", []),
]


@pytest.mark.parametrize(("field", "want"), CASES)
def test_values(spark, field, want):
    df = spark.createDataFrame([("k", field)], "k string, f string")
    got = sorted((r["value_pos"], r["value"]) for r in unpack(df, ["k"], "f", "S[23]-").collect())
    assert got == list(enumerate(want, 1))


def test_round_trip(spark):
    """Whatever is packed with quotes where needed comes out again."""
    import random

    rng = random.Random(1)
    data, want = [], set()
    for i in range(300):
        vals = [f"S{rng.choice('23')}-{rng.randrange(10**9):09d}" + rng.choice(["", "", "", ",b", " c", "|d"]) for _ in range(rng.randrange(0, 8))]
        sep = rng.choice([",", ";", " | ", " & ", "\t", "，", " / "])
        data.append((str(i), sep.join(f'"{v}"' if len(v) > 12 or rng.random() < 0.2 else v for v in vals)))
        want |= {(str(i), p, v) for p, v in enumerate(vals, 1)}
    got = {tuple(r) for r in unpack(spark.createDataFrame(data, "k string, f string"), ["k"], "f", "S[23]-").collect()}
    assert got == want


def test_edges(spark):
    df = spark.createDataFrame([("a", "S2-1"), ("a", "S2-1"), (None, "S2-2")], "k string, f string").withColumnRenamed("k", "value_pos_")
    assert unpack(df, ["value_pos_"], "f", "S[23]-").count() == 2  # repeated rows once, null keys kept
    assert unpack(df.limit(0), ["value_pos_"], "f", "S[23]-").count() == 0
    long = spark.createDataFrame([("a", ",".join(f"S2-{i}" for i in range(20_000)))], "k string, f string")
    assert unpack(long, ["k"], "f", "S[23]-").count() == 20_000
