import random

from pyspark.sql import functions as F
from test_linking import corpus

from linkwright.llm import names


def misspelt(rng, word):
    i = rng.randrange(1, len(word) - 1)
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + word[i] + word[i:], word[:i] + rng.choice("abcdefgh") + word[i + 1 :]])


def test_organisation_with_a_third_of_the_rows(spark):
    rng = random.Random(4)
    orgs, rows, _ = corpus()
    rows = [(f"{k}-{c}", n, h) for k, n, h in rows for c in "abcd"]
    hot = []
    for i in range(240):  # two words of its own and a trade that others have too
        a, b, t = "zanditov", "kelimor", rng.choice(["bakery", "bakery", "bkry"])
        a, b = rng.choice([(a, b), (a, b), (b, a), (misspelt(rng, a), b), (a, misspelt(rng, b))])
        hot.append((f"h{i:03d}", f"{a} {b} {t} Ltd".title(), f"{i % 5 + 1} Main Road"))
    df = spark.createDataFrame(rows + hot, "id string, name string, house string")
    common = set(names.common_words(df.select(names.key_of(F.col("name")).alias("k"))))
    assert {"bakery", "traders", "laboratories"} <= common and not common & {"zanditov", "kelimor"}
    got = {r[0]: r[1] for r in names.organisations(df, "id", "name", "house").collect()}
    found = [got.get(k) for k, _, _ in hot]
    best = max(set(found), key=found.count)
    assert best and found.count(best) >= 0.95 * len(hot)
    assert not any(got[k] == best for k, _, _ in rows)
