import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwright.llm import chunking, mixing, packing
from linkwright.llm.tokens import COMPILED, token_count


def test_tokens(spark):
    texts = ["", None, "  ", "a_b, c!?  d", "x²y", "é١٢", "a b　c", "--- ..."]
    from pyspark.sql import functions as F

    got = [r["n"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(token_count(F.col("t")).alias("n")).collect()]
    assert got == [0, 0, 0, 5, 3, 1, 3, 2]
    assert got == [len(COMPILED.findall(t or "")) for t in texts]


def brute_cuts(text, piece, overlap):
    """Greedy cuts one after the other."""
    s = [m.span() for m in COMPILED.finditer(text)]
    n, at, out = len(s), 0, []

    def pause(p):
        gap = text[s[p - 1][1] : s[p][0]]
        if not gap:
            return 0
        mark = text[s[p - 1][1] - 1]
        return 2 if "\n" in gap or "\r" in gap or mark in chunking.SENTENCE else 1 if mark in chunking.CLAUSE else 0

    while n:
        if n - at <= piece:
            out.append((at, n))
            break
        window = range(at + piece, at + overlap, -1)
        end = next((p for p in window if pause(p) == 2), None) or next((p for p in window if pause(p) >= 1), None) or at + piece
        out.append((at, end))
        at = end - overlap
    return [(a, z, s[a][0], s[z - 1][1]) for a, z in out]


def test_cuts_against_brute_force():
    rng = random.Random(4)
    texts = ["".join(rng.choice(["word ", "x, ", "end. ", "line\n", "a", " ", "- ", "longer "]) for _ in range(rng.randrange(0, 400))) for _ in range(60)]
    for piece, overlap in ((1, 0), (7, 3), (20, 0), (50, 49)):
        got = chunking.cut_batch(texts, piece, overlap)
        for t, c in zip(texts, got):
            want = brute_cuts(t, piece, overlap)
            assert c == want, (piece, overlap, t)


def test_pieces(spark):
    long = "word " * 30_000
    df = spark.createDataFrame([(1, "a b c. d e f g"), (2, None), (3, ""), (4, long), (5, "x"), (5, "x")], "piece_no long, t string")
    got = {}
    for k, *rest in chunking.pieces(df, "piece_no", "t", piece=4, overlap=1).toDF("k", "no", "a", "z", "text").collect():
        got.setdefault(k, []).append(tuple(rest))
    assert [p[3] for p in sorted(got[1])] == ["a b c.", ". d e f", "f g"]
    assert 2 not in got and 3 not in got and got[5] == [(1, 0, 1, "x")] * 2
    spans = sorted((a, z) for _, a, z, _ in got[4])
    assert spans[0][0] == 0 and spans[-1][1] == 30_000 and all(p[1] - q[0] == 1 for p, q in zip(spans, spans[1:]))
    assert chunking.pieces(df.limit(0), "piece_no", "t", piece=4, overlap=1).count() == 0
    with pytest.raises(ValueError):
        chunking.pieces(df, "piece_no", "t", piece=4, overlap=4)


def least_bins(sizes, cap):
    """Fewest containers by exhaustive search."""
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i] and rooms[k] not in rooms[:k]:
                go(i + 1, rooms[:k] + [rooms[k] - sizes[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, cap - sizes[i]])

    go(0, [])
    return best


def test_bin_completion_finds_the_least_number():
    rng = random.Random(6)
    for _ in range(150):
        cap = rng.choice([10, 17, 100])
        sizes = sorted((rng.randrange(0, cap + 1) for _ in range(rng.randrange(1, 10))), reverse=True)
        bins = packing.complete(sizes, cap)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= cap for b in bins)
        assert len(bins) == least_bins([s for s in sizes if s] or [0], cap)


def test_completion_beats_best_fit():
    sizes, cap = sorted([6, 6, 6, 5, 5, 5, 7, 7, 7, 4, 4, 4, 8, 3, 9], reverse=True), 18
    assert len(packing.complete(sizes, cap)) <= len(packing.best_fit(sizes, cap))
    hard = [51, 27, 26, 23, 21, 21, 18, 16, 15, 2]  # best-fit decreasing needs one more than the least
    assert len(packing.complete(hard, 55)) == least_bins(hard, 55)


def test_pack(spark):
    rng = random.Random(7)
    data = [(i, rng.choice([None, 0, rng.randrange(1, 900), rng.randrange(1, 90)])) for i in range(3000)] + [(90_001, 4096), (90_002, 2048), (90_003, 5000)]
    df = spark.createDataFrame(data, "b long, size long")  # a key named like an inner column
    out = packing.pack(df.withColumnRenamed("b", "key_"), "key_", "size", 2048, items_per_group=500).collect()
    size = {k: s or 0 for k, s in data}
    held, fill = {}, {}
    for r in out:
        held.setdefault(r["key_"], []).append((r["piece_no"], r["first_token"], r["n_tokens"]))
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
    assert held.keys() == size.keys()
    for k, p in held.items():
        p.sort()
        assert sum(x[2] for x in p) == size[k] and (len(p) == 1 or size[k] > 2048)
        assert [x[1] for x in p] == [sum(y[2] for y in p[:i]) for i in range(len(p))]
    assert max(fill.values()) <= 2048
    assert len(fill) <= sum(size.values()) / 2048 * 1.01 + 1
    assert packing.pack(df.limit(0), "b", "size", 2048).count() == 0


def test_rake_reaches_margins():
    codes = [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])]
    w = mixing.rake(np.array([50.0, 50, 10, 90]), np.array([500.0] * 4), codes, [np.array([60.0, 40]), np.array([30.0, 70])])
    assert w[:2].sum() == pytest.approx(60, rel=1e-4) and w[[0, 2]].sum() == pytest.approx(30, rel=1e-4)
    capped = mixing.rake(np.array([50.0, 50, 10, 90]), np.array([10.0, 500, 10, 500]), codes, [np.array([60.0, 40]), np.array([30.0, 70])])
    assert capped[0] <= 10 and capped[:2].sum() == pytest.approx(60, rel=1e-3)


def test_mix(spark):
    rng = random.Random(8)
    src = ["big"] * 3000 + ["mid"] * 600 + ["small"] * 60 + ["other"] * 100 + [None] * 20
    data = [(i, s, rng.choice(["en", "de", None]), rng.choice([None, 0, *[rng.randrange(1, 400) for _ in range(8)]])) for i, s in enumerate(src)]
    df = spark.createDataFrame(data, "k long, source string, n_copies string, size long")  # a margin named like a result
    t = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.3, 2), ("small", 0.06, 4), ("absent", 0.04, 2)], "source string, target_share double, max_repeats int")
    m = mixing.mix(df, "k", "size", "source", ["n_copies"], t).collect()
    most = {"big": 1, "mid": 2, "small": 4}
    assert len({r["k"] for r in m}) == len(m) and all(1 <= r["n_copies"] <= most[r["source"]] for r in m)
    total = sum(r["n_copies"] * r["n_tokens"] for r in m)
    for s, want in (("big", 0.6), ("mid", 0.3), ("small", 0.06)):
        share = sum(r["n_copies"] * r["n_tokens"] for r in m if r["source"] == s) / total
        assert share == pytest.approx(want / 0.96, abs=0.01)
    s = {r["source"]: r for r in mixing.shares(spark.createDataFrame(m), "source", t).collect()}
    assert s["absent"]["n_tokens"] == 0 and s["big"]["actual_share"] == pytest.approx(0.625, abs=0.01)
    assert mixing.mix(df.limit(0), "k", "size", "source", ["n_copies"], t).count() == 0
    again = {r["k"]: r["n_copies"] for r in mixing.mix(df.repartition(7), "k", "size", "source", ["n_copies"], t).collect()}
    assert again == {r["k"]: r["n_copies"] for r in m}


def test_mix_of_more_cells_than_the_driver_rakes(spark, monkeypatch):
    rng = random.Random(9)
    data = [(i, rng.choice(["big"] * 5 + ["mid", "small"]), rng.choice(["en", "de", None]), rng.randrange(1, 400)) for i in range(3000)]
    df = spark.createDataFrame(data, "k long, source string, lang string, size long")
    t = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.3, 2), ("small", 0.1, 4)], "source string, target_share double, max_repeats int")
    monkeypatch.setattr(mixing, "MOST_CELLS", 2)
    m = mixing.mix(df, "k", "size", "source", ["lang"], t).collect()
    total = sum(r["n_copies"] * r["n_tokens"] for r in m)
    most = {"big": 1, "mid": 2, "small": 4}
    assert len({r["k"] for r in m}) == len(m) and all(1 <= r["n_copies"] <= most[r["source"]] for r in m)
    for s, want in (("big", 0.6), ("mid", 0.3), ("small", 0.1)):
        assert sum(r["n_copies"] * r["n_tokens"] for r in m if r["source"] == s) / total == pytest.approx(want, abs=0.01)


def test_texts_within_the_limit_are_their_own_piece(spark):
    texts = ["  Ab, cd.\n ", "x" + " " * 50_000 + "y  ", " ", "", None, "one two three four five"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {(r["k"], r["piece_no"]): (r["first_token"], r["end_token"], r["piece_text"]) for r in chunking.pieces(df, "k", "t", piece=4, overlap=1).collect()}
    assert got[0, 1] == (0, 4, "Ab, cd.") and got[1, 1] == (0, 2, "x" + " " * 50_000 + "y")
    assert {k for k, _ in got} == {0, 1, 5} and got[5, 2][1] == 5


def test_items_that_fit_badly_stay_in_bounded_groups(spark):
    df = spark.createDataFrame([(i, 1200) for i in range(300)], "k long, n int")  # two never fit one container
    got = packing.pack(df, "k", "n", 2048, items_per_group=50).collect()
    assert len(got) == 300 and len({r["container_id"] for r in got}) == 300
    assert {r["container_id"].split("-")[0] for r in got} == {"0"}  # one round


def test_mixture_does_not_depend_on_the_number_of_cells_held(spark, monkeypatch):
    rng = random.Random(10)
    data = [(i, rng.choice(["big"] * 5 + ["mid", "small"]), rng.choice(["en", "en", "de", None]), rng.choice("aab"), rng.randrange(1, 400)) for i in range(1500)]
    df = spark.createDataFrame(data, "k long, source string, lang string, section string, size long")
    t = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.3, 2), ("small", 0.1, 4)], "source string, target_share double, max_repeats int")
    run = lambda: {r["k"]: r["n_copies"] for r in mixing.mix(df, "k", "size", "source", ["lang", "section"], t).collect()}
    few = run()
    monkeypatch.setattr(mixing, "MOST_CELLS", 2)
    assert run() == few


def test_all_rounds_of_raking_are_one_job(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_PIECE", 7, raising=False)
    rng = random.Random(11)
    data = [(s, lang, str(x), rng.randrange(1, 900), m, share) for s, m, share in (("big", 1, 0.6), ("mid", 2, 0.3), ("small", 4, 0.1)) for lang in ("en", "de", "") for x in range(9)]
    n = {s: sum(r[3] for r in data if r[0] == s) for s in ("big", "mid", "small")}
    whole = min(n[s] * m / share for s, m, share in (("big", 1, 0.6), ("mid", 2, 0.3), ("small", 4, 0.1)))
    cells = spark.createDataFrame(data, "src string, lang string, section string, n long, m long, share double").withColumn("cap", (F.col("n") * F.col("m")).cast("double"))
    spark.sparkContext.setJobGroup("rake", "rake")
    got = mixing.rake_table(cells, ["src", "lang", "section"], whole)
    spark.sparkContext.setJobGroup("other", "other")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("rake")) <= 3
    got = got.collect()
    assert len(got) == len(data) and all(r["w"] <= r["n"] * r["m"] * (1 + 1e-9) for r in got)
    for s, share in (("big", 0.6), ("mid", 0.3), ("small", 0.1)):
        assert sum(r["w"] for r in got if r["src"] == s) == pytest.approx(share * whole, rel=1e-6)
    all_n = sum(n.values())
    for lang in ("en", "de", ""):
        assert sum(r["w"] for r in got if r["lang"] == lang) == pytest.approx(sum(r[3] for r in data if r[1] == lang) / all_n * whole, rel=0.05)
    assert mixing.rake_table(cells.limit(0), ["src", "lang", "section"], 1.0).count() == 0
