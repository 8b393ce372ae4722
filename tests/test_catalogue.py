"""Every catalogue query against its SQL on the smallest test tables."""

import math
import os
from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")

from navspark.catalogue import all_queries  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")
CATALOGUE = all_queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return float(v) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return Counter(tuple(plain(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_query(spark, duck, name):
    query = CATALOGUE[name]
    df = query.run(spark, DATA)
    mine = [tuple(r) for r in df.collect()]
    assert mine
    if query.sql is None:
        return
    result = duck.execute(query.sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, mine) == rows(columns, result.fetchall())


def test_every_query_has_sql_unless_it_cannot():
    assert {n for n, q in CATALOGUE.items() if q.sql is None} == set()
