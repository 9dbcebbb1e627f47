"""Files: reading policy, header checks, result validation, cached tables, command line pieces."""

import pytest

from linkwright.operators import validate
from linkwright.sources import store, tsv

HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


@pytest.fixture
def write(tmp_path):
    def go(name, text, mode="w"):
        p = tmp_path / name
        p.write_bytes(text) if isinstance(text, bytes) else p.write_text(text, encoding="utf-8")
        return str(p)

    return go


def test_read_policy(spark, write):
    body = 'S1-1\t"A ""B"" \\ C"\t"two\nlines"\tUS\nS1-2\tNA\t\tnan\nS1-3\ta\tb\tc\td\nS1-4\tshort\n'
    got = {r["entity_id"]: tuple(r)[1:] for r in tsv.read_source(spark, write("s.tsv", HEAD + body)).collect()}
    assert got["S1-1"] == ('A "B" \\ C', "two\nlines", "US")
    assert got["S1-2"] == (None, None, None)
    assert "S1-3" not in got and got["S1-4"] == ("short", None, None)


def test_columns(spark, write):
    path = write("x.tsv", "entity_id\tbusiness_name\nS1-1\ta\n")
    with pytest.raises(ValueError):
        tsv.read_source(spark, path)
    with pytest.raises(FileNotFoundError):
        tsv.read_source(spark, path + "-none")
    extra = write("y.tsv", "country\tmore\tentity_id\tbusiness_name\tbusiness_address\nUS\t1\tS1-1\ta\tb\n")
    assert tsv.read_source(spark, extra, columns=("entity_id", "country")).collect()[0]["country"] == "US"
    assert tsv.read_source(spark, write("z.tsv", HEAD)).count() == 0


def test_headers(spark, write):
    assert tsv.source_issues(spark, write("a.tsv", HEAD), "source1") == []
    assert "commas" in tsv.source_issues(spark, write("b.tsv", HEAD.replace("\t", ",")), "source1")[0]
    assert "expected" in tsv.source_issues(spark, write("c.tsv", "x\ty\n"), "source1")[0]
    assert "empty" in tsv.source_issues(spark, write("d.tsv", ""), "source1")[0]
    assert "not found" in tsv.label_issues(spark, "/nowhere/x.tsv")[0]
    assert "unknown" in tsv.source_issues(spark, "x", "source9")[0]


def test_written_lists_pass_their_own_check(spark, tmp_path):
    req = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    m = spark.createDataFrame([("S1-1", "S2-1,S3-2"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string")
    tsv.write_tsv(m.coalesce(1), str(tmp_path / "m"))
    tsv.write_tsv(m.withColumnRenamed("matched_entity_ids", "candidate_entity_ids").coalesce(1), str(tmp_path / "c"))
    targets = spark.createDataFrame([("S2-1",), ("S3-2",)], "entity_id string")
    r = validate.validate_files(spark, str(tmp_path / "m"), str(tmp_path / "c"), req, targets)
    assert r.passed and not r.warnings and r.counts["matched_entity_ids_empty"] == 1


M = "source1_entity_id\tmatched_entity_ids\n"


@pytest.mark.parametrize(
    ("text", "rule"),
    [
        ("", "empty"),
        (M.replace("\t", ","), "commas"),
        ("a\tb\nS1-1\t\n", "header"),
        (M + "S1-1\t\nnonsense\n", "malformed"),
        (M + "S1-1\t\nS1-1\t\n", "duplicate_row"),
        (M + "S1-1\tS2-1,S2-1\n", "repeated_id"),
        (M + "S1-1\tS1-9\n", "self_match"),
        (M + "S1-1\tX9\n", "wrong_prefix"),
        (M + "S1-1\tS2-404\n", "unknown_id"),
        (M, "missing"),
        (M + "S1-1\t\nS1-77\t\n", "not_required"),
    ],
)
def test_broken_files(spark, write, text, rule):
    req = spark.createDataFrame([("S1-1",)], "entity_id string")
    targets = spark.createDataFrame([("S2-1",)], "entity_id string")
    r = validate.validate_files(spark, write("m.tsv", text), None, req, targets)
    assert not r.passed and any(rule in e for e in r.errors) and r.warnings


def test_not_utf8_and_subset(spark, write):
    req = spark.createDataFrame([("S1-1",)], "entity_id string")
    assert any("UTF-8" in e for e in validate.validate_files(spark, write("m.tsv", (M + "S1-1\t").encode() + b"\xff\xfe\n"), None, req).errors)
    c = write("c.tsv", "source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-2\n")
    r = validate.validate_files(spark, write("k.tsv", M + "S1-1\tS2-1\n"), c, req)
    assert r.passed and any("not_candidate" in w for w in r.warnings)


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    built = []
    for _ in range(2):
        s.materialize("t", lambda: built.append(1) or spark.range(3))
    assert len(built) == 1 and s.load("t").count() == 3
    s.materialize("t", lambda: spark.range(5), force=True)
    assert s.load("t").count() == 5
    with pytest.raises(FileNotFoundError):
        s.load("none")
    store.save_threshold(str(tmp_path / "t.json"), 0.7, 0.9)
    assert store.load_threshold(str(tmp_path / "t.json")) == (0.7, None)
    assert store.load_threshold(str(tmp_path / "no.json"))[1]


def test_stream(spark, tmp_path, write):
    from linkwright.streaming.micro_batches import normalize_stream

    (tmp_path / "in").mkdir()
    write("in/a.tsv", HEAD + "S1-1\tAcme Ltd\t\tUS\n")
    args = [str(tmp_path / x) for x in ("in", "out", "check")]
    normalize_stream(spark, *args)
    write("in/b.tsv", HEAD + "S1-2\tZeta\t\tUS\n")
    normalize_stream(spark, *args)
    assert sorted(r["name_norm"] for r in spark.read.parquet(args[1]).collect()) == ["acme limited", "zeta"]


def test_checkpoint_folder_on_a_cluster():
    from linkwright.operators.storage import checkpoint_folder

    class Conf:
        def get(self, k, d=None):
            return d

    class Context:
        master = "spark://x:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: Conf())

    with pytest.raises(RuntimeError):
        checkpoint_folder(type("S", (), {"sparkContext": Context()})())
