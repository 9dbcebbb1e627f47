from test_linking import corpus

from linkwright.llm import linkage


def test_record_with_neither_address_nor_trade(spark):
    orgs, rows, _ = corpus()
    rows = [*rows, ("o120", f"{orgs[7][0]} {orgs[7][1]} {'bakery' if orgs[7][2] != 'bakery' else 'traders'}".title(), "121 Main Road")]
    streets = ("Alderwood", "Birchwood", "Cedarwood")
    ref = spark.createDataFrame([(f"S1-{i}", n, f"{i + 1} {streets[i % 3]} Road, Townsend, XA 1000{i % 3}", "US") for i, (_, n, _) in enumerate(rows)], "id string, name string, address string, country string")
    recs = [(f"S2-{i}", f"{a} {b} {t}", f"{i + 1} {streets[i % 3]} rd, Townsend", "usa") for i, (a, b, t) in enumerate(orgs)]
    recs += [(f"S3-{i}", f"{orgs[i][0]} {orgs[i][1]} Ltd".title(), None, "US") for i in range(5)]
    recs += [("S3-joined", f"{orgs[5][1]}{orgs[5][0]} LLP", "", "US"), ("S3-two", f"{orgs[7][0]} {orgs[7][1]} Ltd", None, "US")]  # two trades: either could be meant
    records = spark.createDataFrame(recs, "id string, name string, address string, country string")
    got = {(r[0], r[1]) for r in linkage.link(ref, records, "id", "name", "address", "country", least=0.0).collect() if r[1].startswith("S3")}
    assert got == {(f"S1-{i}", f"S3-{i}") for i in range(5)} | {("S1-5", "S3-joined")}
    only = linkage.link(ref, records, "id", "name", "address", "country", only=spark.createDataFrame([("S1-2",)], "id string"), least=0.0)
    assert {(r[0], r[1]) for r in only.collect()} == {("S1-2", "S2-2"), ("S1-2", "S3-2")}
