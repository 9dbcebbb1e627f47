"""Keys of hand-typed rows are made as rows, and those of usual names written out, with the same result."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from linkwright.llm import linkage, reading

NAMES = ["dovil sarumit", "dovil dovan", "ab sarumit", "ab cd", "dovil sarumit helat", "dovil dovan sarumit", "ab dovil sarumit", "ab cd sarumit", "ab de fi", "dovilekamen sarumit", "dovil sarumitamen helat", "dovil", "dovilekamen", "ab", "dovil sarumit helat bar"]
# Fields of the texts below, as they were read before.
WANT = [('12', 'ab', 'road', [], '33757'), ('12', 'main', '', ['st'], ''), ('5', 'main', 'street', [], ''), ('5', 'main', 'street', ['town'], ''), ('5', 'main', 'street', [], ''), ('5', 'main', '', ['st'], ''), (None, None, None, None, None)]


def expected(sounds, clean):
    long = [w for w in sounds if len(w) > 3]
    begins = {"<" + w[:5] + v[0] for w in long for v in sounds if v != w}
    ends = {">" + "+".join(sorted((v[-4:], w[-4:]))) for v, w in combinations(long, 2)}
    lone = [w for w in long if clean or len(w) > 9 or len(sounds) == 1]
    return begins | ends | {k for w in lone for k in ("<" + w[:5], ">" + w[-5:])}


def test_keys_of_usual_and_other_names(spark):
    df = spark.createDataFrame([(n, n.split()) for n in NAMES], "name string, sounds array<string>")
    for clean in (False, True):
        for r in df.select("sounds", linkage._ends(clean).alias("e")).collect():
            assert {x for x in r["e"] if x is not None} == expected(r["sounds"], clean), (r["sounds"], clean)


def test_keys_asked_are_rows(spark):
    rows = [(f"b{i}", n, "12 and 12345 and 40 Main Road" if i % 3 else "Main Road", "US") for i, n in enumerate(NAMES)] + [("c1", None, "7 Helat Road", "US"), ("c2", None, "Helat", "US"), ("c3", "x", None, "US"), ("c4", "", "9 Main Road", None)]
    df = spark.createDataFrame(rows, "id string, name string, address string, country string")
    asked = linkage._asked(df, [])
    assert asked.columns == ["h", "k"] and asked.filter("k is null").isEmpty()
    got = {tuple(r) for r in asked.collect()}
    sides = linkage._own(df, []).withColumn("named", linkage._named())
    want = []
    for r in sides.select("id", "name", "address", "country", "own", "sounds", "named", linkage._row()).collect():
        if r["name"] is None:
            want += [(r["h"], n, w, None) for n, w in (("7", "helat"), ("7", "road")) if "7" in r["address"]]
        elif "12" in (r["address"] or ""):
            want += [(r["h"], n, w, None) for n in ("12", "40") for w in expected(r["sounds"], False)]
        elif "9" in (r["address"] or ""):
            want += [(r["h"], "9", w, None) for w in expected(r["sounds"], False)]
        elif r["own"]:
            want += [(r["h"], None, None, k) for k in r["named"]]
    keys = spark.createDataFrame(want, "h long, n string, w string, k long").select("h", F.coalesce("k", F.xxhash64("n", "w")))
    assert got == {tuple(r) for r in keys.collect()} and len(got) > 100


def test_given_names_are_asked_of_a_set(spark):
    df = spark.createDataFrame([(["zed", "peg", "bob"],), (["zed"],), ([],), (None,)], "w array<string>")
    read = df.select(reading.given_name(F.col("w")).alias("g"))
    assert [r["g"] for r in read.collect()] == ["margaret", "", "", ""]
    assert "transform(" not in read._jdf.queryExecution().executedPlan().toString()


def test_guards_of_addresses_lose_nothing(spark):
    texts = ["12 A.B. Road, 33757-1234", "12;  ,Main -  St # 4", "5 Main St near old bank", "5 Main St, opp the bank, Town", "5  Main   St", "5\tMain\r\nSt", "next 5 Main Rd"]
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    got = [(r["number"], r["street"], r["kind"], r["rest"], r["code"]) for r in reading.with_address(df, "a").collect()]
    assert got == WANT
