from test_linking import corpus

from linkwright.llm import linkage, names


def test_branches_are_no_label(spark):
    orgs, rows, labels = corpus()
    lots = [(f"{k}-{c}", n, h) for k, n, h in rows for c in "ab"]
    few = [(f"b{i:03d}", "Zanditov Kelimor Bakery Ltd", f"{i % 24 + 300} Main Road") for i in range(150)]  # 24 branches
    many = [(f"c{i:03d}", "Somidek Barofut Traders Ltd", f"{i + 700} Main Road") for i in range(60)]  # each at a place of its own
    df = spark.createDataFrame(lots + labels + few + many, "id string, name string, house string")
    named = df.select(names.key_of(df["name"]).alias("k"), names.house_number(df["house"]).alias("house"))
    assert names.general_labels(named) == ["general store"]
    got = {r[0]: r[1] for r in names.organisations(df, "id", "name", "house").collect()}
    for own in (few, many):
        assert len({got.get(k) for k, _, _ in own}) == 1 and own[0][0] in got
    assert not any(k.startswith("z") for k in got)


def test_name_in_the_reference_is_no_label(spark):
    _, rows, _ = corpus()
    ref = spark.createDataFrame([(f"S1-{i}", n, f"{i + 1} Alderwood Road, Townsend, XA 10000", "US") for i, (_, n, _) in enumerate(rows)] + [("S1-z", "Zanditov Kelimor", "7 Birchwood Road, Townsend, XA 10000", "US")], "id string, name string, address string, country string")
    recs = [(f"S2-{i}", n, f"{i + 1} Alderwood rd, Townsend", "usa") for i, (_, n, _) in enumerate(rows)]
    recs += [(f"S3-{i}", "Zanditov Kelimor", f"{i + 7} Birchwood Road, Townsend", "US") for i in range(60)]
    records = spark.createDataFrame(recs, "id string, name string, address string, country string")
    got = {(r[0], r[1]) for r in linkage.link(ref, records, "id", "name", "address", "country", least=0.0).collect() if r[1].startswith("S3")}
    assert got == {("S1-z", "S3-0")}
