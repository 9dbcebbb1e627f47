import os

import pytest

from linkwright.llm import queries

SMALL = "/root/testdata/sf0.001"


def test_every_problem_has_a_query():
    have = {k.split("_")[0] for k in queries.QUERIES}
    assert have == {"p1", "p3", "p5", "p6", "p7", "p8", "p9", "p10"}
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["p1_ranked", "p3_found", "p10_found"])
def test_same_as_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    cur = c.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    df = queries.QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[k] for k in names) for r in df.collect()))) == sorted(map(str, cur.fetchall()))
