"""Reading runs in methods that the JVM compiles; cheap looks ahead find what the alternatives did."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkwright.llm import linkage, reading

LIMIT = "spark.sql.codegen.hugeMethodLimit"


def test_reading_is_written_in_small_methods(spark, monkeypatch):
    before, limits, durable = spark.conf.get(LIMIT), [], linkage.durable
    monkeypatch.setattr(linkage, "durable", lambda df: limits.append(spark.conf.get(LIMIT)) or durable(df))
    cols = "id string, name string, address string, country string"
    ref = spark.createDataFrame([("a1", "Dovilek Bakery", "12 Sarumit Road, Helatown, 560001", "US")], cols)
    hand = spark.createDataFrame([("b1", "Dovilek Bakry", "12 Sarumit Rd, Helatown 560001", "us"), ("b2", "Other Shop", "99 Else Street, Farville", "US")], cols)
    got = {(r["reference_id"], r["id"]) for r in linkage.link(ref, hand, "id", "name", "address", "country", least=0.0).collect()}
    assert got == {("a1", "b1")}
    assert limits.count("8000") >= 4 and spark.conf.get(LIMIT) == before


def test_looks_ahead_lose_nothing(spark):
    names = ["M/s. Sarumit & Sons", "abc p. ltd", "abc pltd", "A.B. Stores (Formerly XY)", "Foo f0rmerly Bar", "Bob's Shop", "x fka y", "abc (p) limited", "plain name", "a previously b", "Messrs K"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r["words"] for r in reading.with_words(df, "name").select("words").collect()]
    assert got == [["sarumit"], ["abc"], ["abc"], ["ab", "stores"], ["foo"], ["bobs", "shop"], ["x"], ["abc"], ["plain", "name"], ["a"], ["k"]]
    at = ["12345-6789 x", "560 001", "sector 5, 17 rd", "shop no. 4 and 0012", "21st", "fl 3", "unit#7 900000", "a1b"]
    read = spark.createDataFrame([(x,) for x in at], "t string").select(F.regexp_extract_all("t", F.lit(linkage._NUMBERS), F.lit(1)).alias("n"))
    assert [[n for n in r["n"] if n] for r in read.collect()] == [[], [], ["17"], ["12"], [], [], ["900000"], ["1"]]
