from hypothesis import given, settings
from hypothesis import strategies as st

from linkwright.functions import fuzzy

words = st.text(alphabet="abc é", max_size=12)


def slow_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_lcs(a, b):
    assert fuzzy.lcs(a, b) == slow_lcs(a, b)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_properties(a, b):
    for f in (fuzzy.ratio, fuzzy.token_sort_ratio, fuzzy.token_set_ratio, fuzzy.partial_ratio, fuzzy.weighted_ratio):
        assert 0 <= f(a, b) <= 100
        assert abs(f(a, b) - f(b, a)) < 1e-9
    assert fuzzy.ratio(a, a) == 100


@settings(max_examples=100, deadline=None)
@given(words, words)
def test_partial_is_best_window(a, b):
    s, long = (a, b) if len(a) <= len(b) else (b, a)
    if not s:
        return
    windows = {long[max(0, i) : i + len(s)] for i in range(1 - len(s), len(long))}
    want = max(fuzzy.ratio(s, w) for w in windows if w)
    got = fuzzy.partial_ratio(a, b)
    assert got >= want - 1e-9 if len(a) == len(b) else abs(got - want) < 1e-9


def test_known():
    assert fuzzy.token_set_ratio("acme limited", "limited acme private") == 100
    assert fuzzy.partial_ratio("acme", "the acme company") == 100
    assert fuzzy.weighted_ratio("", "x") == 0


def test_udf(spark):
    df = spark.createDataFrame([("acme ltd", "ltd acme", "", "")], "a string, b string, c string, d string")
    r = df.select(fuzzy.fuzzy_features("a", "b", "c", "d").alias("f")).collect()[0]["f"]
    assert r["name_token_sort_sim"] == 1.0 and r["addr_lev_sim"] == 0.0


longer = st.text(alphabet="abcdé 1", max_size=90)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.tuples(words, words), st.tuples(words, longer), st.tuples(longer, longer)), max_size=30))
def test_many_pairs_as_one_by_one(some):
    a, b = [x for x, _ in some], [y for _, y in some]
    for all_, one in ((fuzzy.lcs_all, fuzzy.lcs), (fuzzy.ratio_all, fuzzy.ratio), (fuzzy.partial_all, fuzzy.partial_ratio), (fuzzy.weighted_all, fuzzy.weighted_ratio)):
        assert [*all_(a, b)] == [one(x, y) for x, y in some]
