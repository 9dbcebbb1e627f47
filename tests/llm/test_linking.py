import random

import numpy as np
import pytest

from linkwright.llm import addresses, linkage, names
from linkwright.llm.reading import with_address
from linkwright.llm.wording import distance, is_short_for, same_stem, sound


def test_distance():
    assert distance("bafakix", "bafacix") == 1 and distance("abcd", "acbd") == 1 and distance("abc", "xyz", 2) == 3
    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(0, 7))) for _ in range(2))
        assert distance(a, b, 9) == slow(a, b)
    assert sound("tanniks") == sound("tanix") and is_short_for("mfg", "manufacturing") and same_stem("trading", "traders")


def slow(a, b):
    d = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i == 0 or j == 0:
                d[i, j] = i + j
                continue
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Plot No. 38, Bojobor Nagar, Sector 3, Kleheregaon, Mogifol Pradesh 107919", ("38", "", "", "bojobor", "nagar", ("kleheregaon", "mogifol", "pradesh"), "107919")),
        ("51 B East Refafar Hway, Unit 10, QD 73352-1234", ("51", "b", "e", "refafar", "highway", ("qd",), "73352")),
        ("Sarekin City; 151 FEJODRAL BLVD E.; STE 4", ("151", "", "e", "fejodral", "boulevard", ("sarekin", "city"), "")),
        ("num 25/A redratux stret opp clock tower 234 623", ("25", "a", "", "redratux", "street", (), "234623")),
        ("112 28th Av, Fl 2", ("112", "", "", "28th", "avenue", (), "")),
        ("#9, First Galli, Takufas", ("9", "", "", "1st", "gali", ("takufas",), "")),
        ("Main Street", None), ("", None), (None, None), ("12", None), ("12345", None),
    ],
)
def test_read_address(spark, text, want):
    assert read_address(spark, text) == want


def read_address(spark, text):
    r = with_address(spark.createDataFrame([(text,)], "a string"), "a").collect()[0]
    return (r["number"], r["letter"], r["direction"], r["street"], r["kind"], tuple(r["rest"]), r["code"]) if r["number"] is not None else None


def test_very_long_address(spark):
    assert read_address(spark, "word " * 100_000 + "12 main street")[:4] == ("12", "", "", "main")
    assert read_address(spark, "plot, no " * 20_000) is None


def pairs_of(spark, rows):
    df = spark.createDataFrame(rows, "place string, business_address string").withColumnRenamed("place", "entity_id")
    p = addresses.places(df, "entity_id", "business_address")
    return {tuple(r) for r in addresses.pairs_within(p, "entity_id", "place").collect()}


def test_places(spark):
    rows = [
        ("a", "38 Bojobor Nagar, Kleheregaon, 107919"), ("b", "plot no. 38 bojobbor ngr, 107 919"), ("c", "H.No. 38 Bojobor Nagar; Kleheregaon"), ("d", "38, Bojobor, Kleheregaon"),
        ("e", "39 Bojobor Nagar, Kleheregaon"), ("f", "38B Bojobor Nagar, Kleheregaon"), ("g", "38 East Bojobor Nagar, Kleheregaon"), ("h", "38 Bojobor Nagar, Otherton, 555555"),
        ("i", "38 Bojobor Road, Kleheregaon"), ("j", None), ("k", ""), ("a", "38 Bojobor Nagar, Kleheregaon, 107919"), ("l", "40 Otto Road, Otherton 555555"), ("m", "41 Otto Road, Otherton 555555"),
        ("n", "1 Long Road, Kleheregaon 107919"), ("o", "2 Long Road, Kleheregaon 107919"),  # towns are learned from codes
    ]
    want = {(x, y) for x in "abcd" for y in "abcd" if x < y}
    assert pairs_of(spark, rows) == want
    assert pairs_of(spark, [("x", None)]) == set()


def test_places_empty(spark):
    df = spark.createDataFrame([], "entity_id string, business_address string")
    assert addresses.places(df, "entity_id", "business_address").count() == 0


def corpus():
    """Names of invented organisations in enough copies for trade words to be common."""
    rng = random.Random(2)
    syl = ["ba", "ke", "lo", "mi", "nu", "ra", "so", "tu", "vi", "ze"]
    word = lambda: "".join(rng.choice(syl) for _ in range(4))
    orgs = [(word(), word(), rng.choice(["bakery", "traders", "laboratories"])) for _ in range(120)]
    rows = [(f"o{i:03d}", f"{a.title()} {b.title()} {t.title()} Ltd", f"{i} Main Road") for i, (a, b, t) in enumerate(orgs)]
    labels = [(f"z{i:03d}", "General Store", f"{i} Side Lane") for i in range(60)] + [("z900", "Genral Store", "7 Side Lane"), ("z901", "general  store", "8 Side Lane")]
    return orgs, rows, labels


def test_organisations(spark):
    orgs, rows, labels = corpus()
    (a, b, t), (c, d, u) = orgs[0], orgs[1]
    short = {"bakery": "bkry", "traders": "trading", "laboratories": "labs"}[t]
    extra = [
        ("v1", f"{b.upper()} {a.upper()} {t.upper()}", None), ("v2", f"M/s {a[:3]}{a[4:]} {b} {short}", ""), ("v3", f"x holdings dba {a} {b} {t}", "1 Main Road"), ("v4", f"{a} {b[0]}. {t}", None),
        ("v5", f"{a}{b} {t} (formerly {d})", None), ("v6", None, "5 Main Road"), ("v7", "  ", None), ("v1", f"{b.upper()} {a.upper()} {t.upper()}", None),
        ("n1", f"{a} {d} {t}", None), ("n2", f"{a} {b} {'bakery' if t != 'bakery' else 'traders'}", None),
    ]
    df = spark.createDataFrame(rows + labels + extra, "form string, name string, house string")  # columns named like inner ones
    got = {r[0]: r[1] for r in names.organisations(df, "form", "name", "house").collect()}
    assert {got[k] for k in ("v1", "v2", "v3", "v4", "v5")} == {got["o000"]}
    assert got["n1"] != got["o000"] and got["n2"] != got["o000"]
    assert not any(k.startswith("z") for k in got) and "v6" not in got and "v7" not in got
    assert names.organisations(df.limit(0), "form", "name", "house").count() == 0


def test_label_model_learns_without_labels():
    rng = np.random.default_rng(3)
    n, d = 4000, 8
    y = rng.random(n) < 0.3
    right = np.array([0.95, 0.9, 0.9, 0.85, 0.8, 0.8, 0.6, 0.6])
    votes = np.where(rng.random((n, d)) < right, np.where(y, 1, -1)[:, None], np.where(y, -1, 1)[:, None])
    votes[rng.random((n, d)) < 0.2] = 0
    votes[:, 7] = votes[:, 6]  # two votes that are one
    pat, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post = linkage.LabelModel().fit(pat, counts.astype(float)).posterior(pat)[inverse.ravel()]
    assert ((post > 0.5) == y).mean() > 0.96


def test_link(spark):
    orgs, rows, _ = corpus()
    ref = spark.createDataFrame([(f"S1-{i}", n, f"{i + 1} {('Alderwood', 'Birchwood', 'Cedarwood')[i % 3]} Road, Townsend, XA 1000{i % 3}", "US") for i, (_, n, _) in enumerate(rows)], "id string, name string, address string, country string")
    name = lambda i: rows[i][1]
    recs = []
    for i in range(100):
        a, b, t = orgs[i]
        recs.append((f"S2-{i}", f"{a} {b} {t}", f"{i + 1} {('Alderwood', 'Birchwood', 'Cedarwood')[i % 3]} rd, Townsend", "usa"))
        recs.append((f"S3-{i}", f"{b.upper()} {a.upper()} {t}", f"no. {i + 1} {('Aldarwood', 'Bircwhood', 'Cedrwood')[i % 3]} road townsend 1000{i % 3}", None))
        recs.append((f"S4-{i}", name(i), f"{i + 500} Walnut Road, Elsewhere 20000", "US"))  # another branch
    recs += [("S2-x", name(3), None, None), ("S2-y", None, "5 Birchwood Road, Townsend", "US"), ("S2-z", None, None, None), (None, name(4), None, None), ("S2-0", recs[0][1], recs[0][2], "usa")]
    records = spark.createDataFrame(recs, "id string, name string, address string, country string")
    out = linkage.link(ref, records, "id", "name", "address", "country").collect()
    got = {(r[0], r[1]) for r in out}
    want = {(f"S1-{i}", f"{s}-{i}") for i in range(100) for s in ("S2", "S3")} | {("S1-3", "S2-x"), ("S1-4", "S2-y")}
    assert len(out) == len(got) and not got - want and len(got) >= 0.97 * len(want)
    only = linkage.link(ref, records, "id", "name", "address", "country", only=spark.createDataFrame([("S1-5",)], "id string"))
    assert {(r[0], r[1]) for r in only.collect()} <= got
    assert linkage.link(ref, records.limit(0), "id", "name", "address", "country").count() == 0
