import pytest
from pyspark.sql import functions as F
from test_linking import corpus

from linkwright.llm import linkage
from linkwright.llm.reading import given_name, sounding, with_address, with_words
from linkwright.llm.wording import sound


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("M/s. Tanix B0nab Traders (P) Ltd.", ["tanix", "bonab", "traders"]),
        ("Foo Holdings d/b/a Pákíklín Fovebran 'n' Sons L.L.C. (formerly Old Name)", ["pakiklin", "fovebran"]),
        ("J. Lodrotar N. Bakery & Co", ["j", "lodrotar", "n", "bakery"]),
        ("Bakery bakery 24", ["bakery", "24"]), ("", []), (None, []), ("  \t", []),
    ],
)
def test_words_of_names(spark, name, want):
    df = spark.createDataFrame([(name, 1)], "name string, number int")
    assert with_words(df, "name").collect()[0]["words"] == want


def test_sounds_and_given_names(spark):
    words = ["tanniks", "pheezooq", "vajicc", "thoo", "b00k", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(sounding(F.col("w"))).collect()] == [sound(w) for w in words]
    g = spark.createDataFrame([(["x", "peggy"],), (["x"],), ([],)], "w array<string>")
    assert [r[0] for r in g.select(given_name(F.col("w"))).collect()] == ["margaret", "", ""]


def test_addresses_keep_other_columns(spark):
    df = spark.createDataFrame([("12 Main Street, Town", "x"), (None, "y")], "address string, other string")
    got = {r["other"]: (r["number"], r["rest"]) for r in with_address(df, "address").collect()}
    assert got == {"x": ("12", ["town"]), "y": (None, None)}


def test_hot_keys_are_refined_without_loss(spark, monkeypatch):
    """One organisation with a branch at the same number of many streets: its keys are hot, its matches stay."""
    orgs, rows, _ = corpus()
    streets = [f"{a}{b}wood" for a in ("al", "bir", "ce", "do", "el") for b in ("ta", "mo", "ri", "ku")]
    ref = [(f"S1-{i}", n, f"{i + 1} Alderwood Road, Townsend, XA 10000", "US") for i, (_, n, _) in enumerate(rows)]
    ref += [(f"S1-h{i}", "Zanditov Kelimor Bakery Ltd", f"77 {s} Road, Townsend, XA 10000", "US") for i, s in enumerate(streets)]
    recs = [(f"S2-{i}", n, f"{i + 1} Alderwood rd, Townsend", "usa") for i, (_, n, _) in enumerate(rows)]
    recs += [(f"S2-h{i}", "Zanditov Kelimor Bakery", f"77 {s} rd, Townsend 10000", "US") for i, s in enumerate(streets)]
    schema = "id string, name string, address string, country string"
    run = lambda: {(r[0], r[1]) for r in linkage.link(spark.createDataFrame(ref, schema), spark.createDataFrame(recs, schema), "id", "name", "address", "country").collect()}
    plain = run()
    monkeypatch.setattr(linkage, "HOT_KEY", 3)
    assert {(f"S1-h{i}", f"S2-h{i}") for i in range(len(streets))} <= plain == run()


def test_hot_keys_lose_no_pair(spark, monkeypatch):
    """Records with a hot key and no further word as the reference writes it are candidates all the same."""
    ref = spark.createDataFrame([(i, [1]) for i in range(20)] + [(20, [2])], "arow long, keys array<long>")
    ref = ref.select("arow", F.lit(0).cast("long").alias("n"), "keys", F.array(F.concat(F.lit("a"), "arow")).alias("more"))
    asks = spark.createDataFrame([(1, [1, 2]), (2, [2]), (3, None)], "h long, keys array<long>").withColumn("more", F.array(F.lit("b")))
    monkeypatch.setattr(linkage, "HOT_KEY", 3)
    got = [tuple(r) for r in linkage._candidates(ref, asks).select("h", "arow").collect()]
    assert len(got) == len(set(got)) and set(got) == {(1, i) for i in range(21)} | {(2, 20)}
