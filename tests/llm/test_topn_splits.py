import random

import pytest

from linkwright.llm import splits, topn

NAN = float("nan")


def brute_top(data, n):
    best = {}
    for g, i, s in data:
        if g is None or i is None or s is None or s != s:
            continue
        best[g, i] = max(s, best.get((g, i), -9))
    out = set()
    for g in {g for g, _ in best}:
        ranked = sorted(((s, i) for (h, i), s in best.items() if h == g), key=lambda x: (-x[0], x[1]))
        out |= {(g, i, r) for r, (s, i) in enumerate(ranked[:n], 1)}
    return out


@pytest.mark.parametrize("subgroups", [1, 3, 50])
def test_top_n_against_brute_force(spark, subgroups):
    rng = random.Random(subgroups)
    data = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.choice(["x", "y", None, *map(str, range(40))]), rng.choice([None, NAN, 0.5, 0.5, round(rng.random(), 1)])) for _ in range(1500)]
    df = spark.createDataFrame(data, "g string, rank string, s double")  # a column named like a result
    got = {(r[0], r[1], r[3]) for r in topn.top_n(df, "g", "rank", "s", 5, subgroups=subgroups).toDF("g", "i", "s", "r").collect()}
    assert got == brute_top(data, 5)


def test_top_n_empty(spark):
    df = spark.createDataFrame([], "g string, i string, s double")
    assert topn.top_n(df, "g", "i", "s", 3).count() == 0
    only_null = spark.createDataFrame([("a", "x", None), ("a", "y", NAN)], "g string, i string, s double")
    assert topn.top_n(only_null, "g", "i", "s", 3).count() == 0


def brute_groups(data):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r, v in data:
        if r is None:
            continue
        parent.setdefault("r" + r, "r" + r)
        if v is not None:
            parent.setdefault("v" + v, "v" + v)
            a, b = find("r" + r), find("v" + v)
            parent[max(a, b)] = min(a, b)
    return {(x[1:], find(x)[1:]) for x in parent if x[0] == "r"}


@pytest.mark.parametrize("per_task", [1_000_000, 40])
def test_groups_against_union_find(spark, monkeypatch, per_task):
    monkeypatch.setattr(splits.components, "__kwdefaults__", {"edges_per_task": per_task})
    rng = random.Random(per_task)
    data = [(f"{rng.randrange(150):04d}", rng.choice([None, f"{rng.randrange(200)}"])) for _ in range(260)]
    data += [(f"9{i:03d}", "chain%d" % (i + j)) for i in range(60) for j in (0, 1)]  # a long chain
    data += [(f"8{i:03d}", "hub") for i in range(80)] + [(None, "hub"), ("0001", "hub"), ("0001", "hub")]
    df = spark.createDataFrame(data, "record string, link string").repartition(5)
    assert {tuple(r) for r in splits.related_groups(df, "record", "link").collect()} == brute_groups(data)


def test_greedy_counts_is_the_greedy_order():
    rng = random.Random(5)
    for _ in range(60):
        sizes = sorted({rng.randrange(1, 12): rng.randrange(1, 30) for _ in range(4)}.items(), reverse=True)
        targets = [0.8, 0.1, 0.1]
        total = sum(s * c for s, c in sizes)
        deficit, want = [t * total for t in targets], []
        for s, c in sizes:
            got = [0, 0, 0]
            for _ in range(c):
                k = max(range(3), key=lambda j: (round(deficit[j], 9), -j))
                deficit[k] -= s
                got[k] += 1
            want.append(got)
        assert splits.greedy_counts(sizes, targets) == want


def test_splits_keep_groups_and_shares(spark):
    rng = random.Random(3)
    groups = [(f"r{i:05d}", f"r{i - i % rng.choice([1, 1, 1, 2, 5]):05d}") for i in range(3000)]
    g = spark.createDataFrame(groups, "rec string, first string")
    t = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), ("none", None)], "split_name string, target_share double")
    out = splits.assign_splits(g, "rec", t).collect()
    assert len(out) == 3000
    by_group, n = {}, {}
    for r in out:
        assert by_group.setdefault(r["first"], r["split_name"]) == r["split_name"]
        n[r["split_name"]] = n.get(r["split_name"], 0) + 1
    assert abs(n["train"] - 2400) <= 5 and abs(n["test"] - 300) <= 5 and "none" not in n
    assert splits.assign_splits(g.limit(0), "rec", t).count() == 0


def test_local_forest_in_small_steps(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(splits, "EDGES_AT_ONCE", 3)
    rng = random.Random(11)
    edges = [(f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}") for _ in range(30)]
    edges = [e for e in edges if e[0] != e[1]]
    batches = [pd.DataFrame(edges[i : i + 2], columns=["a", "b"]) for i in range(0, len(edges), 2)]
    whole = pd.concat(list(splits.local_forest(iter([pd.DataFrame(edges, columns=["a", "b"])]))))
    steps = pd.concat(list(splits.local_forest(iter(batches))))
    assert dict(zip(steps["node"], steps["root"])) == dict(zip(whole["node"], whole["root"]))
