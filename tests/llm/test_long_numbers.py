import pytest

from test_linking import read_address

from linkwright.llm import names


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("10000 Goserex Lane, Klefejalville, XA 12137", ("10000", "", "", "goserex", "lane", ("klefejalville", "xa"), "12137")),
        ("12500 B East Goserex Ln, Suite 4, Klefejalville", ("12500", "b", "e", "goserex", "lane", ("klefejalville",), "")),
        ("Klefejalville; Suite 4, No. 10000 Goserex Lane; XA 12137", ("10000", "", "", "goserex", "lane", ("klefejalville", "xa"), "12137")),
        ("10000 Goserex, Klefejalville, 234 623", ("10000", "", "", "goserex", "", ("klefejalville",), "234623")),
        ("107919, Kleheregaon, 38 Bojobor Nagar", ("38", "", "", "bojobor", "nagar", ("kleheregaon",), "107919")),
        ("38 Bojobor Nagar, 107919 Otto Road", ("38", "", "", "bojobor", "nagar", ("otto", "road"), "107919")),
        ("XA 12137", None),
    ],
)
def test_house_numbers_of_five_digits(spark, text, want):
    assert read_address(spark, text) == want


def test_house_number_column(spark):
    rows = [("10000 Goserex Lane, Klefejalville, XA 12137", "10000"), ("Suite 5, 12137 38 Bojobor Nagar", "38"), ("Klefejalville, XA 12137", ""), ("38 Bojobor Nagar 107919", "38")]
    df = spark.createDataFrame(rows, "a string, want string")
    assert df.filter(names.house_number(df["a"]) != df["want"]).count() == 0
