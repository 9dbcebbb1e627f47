import unicodedata

import pytest
from pyspark.sql import functions as F

from linkwright.functions import text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Café & Co. Pvt.", "café and company private"),
        ("ＡＢＣ ﬁne Ltd", "abc fine limited"),
        ("A_B-C/D", "a_b c d"),
        ("x²½ Ⅳ", unicodedata.normalize("NFKC", "x²½ Ⅳ").lower().replace("⁄", " ")),
        ("  Acme Inc \t", "acme incorporated"),
        ("O’Brien", "o brien"),
        ("Café", "café"),
        ("   ", ""),
        ("&", "and"),
        ("!!!", ""),
        (None, ""),
        ("word " * 50_000, " ".join(["word"] * 50_000)),
    ],
)
def test_normalize_name(spark, raw, want):
    assert one(spark, raw, text.normalize_name) == want


def test_address_and_country(spark):
    assert one(spark, "12 Main St., Apt #4\nNo 7", text.normalize_address) == "12 main street apartment 4 number 7"
    assert one(spark, None, text.normalize_address) == ""
    assert one(spark, " U.S. ", text.normalize_country) == "u.s."


def test_tokens(spark):
    assert one(spark, "the a acme of acme x1", text.name_tokens) == ["acme", "x1"]
    assert one(spark, "", text.name_tokens) == []
    assert one(spark, "12 main road 12 ab near abc", text.address_tokens) == ["12", "main", "abc"]
    assert one(spark, "a123b 45 ٣٤ 45", lambda c: text.numeric_tokens(c, c)) == ["123", "45", "٣٤"]


def test_missing(spark):
    for v in ("", " NaN ", "None", "na", None, "NULL"):
        assert one(spark, v, text.is_missing) is True
    assert one(spark, "n/a", text.is_missing) is False
    assert one(spark, "n/a", text.na_to_null) is None
    assert one(spark, " a , ,b,", text.id_list) == ["a", "b"]
    assert one(spark, None, text.id_list) == []
