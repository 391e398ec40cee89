"""Every query of the engine against its SQL on the smallest test data."""

import os

import duckdb
import pytest

from talktree.queries import ORACLE_SQL as OLD_SQL
from talktree.queries import QUERIES as OLD
from talktree.queries_more import MORE, MORE_SQL
from talktree.queries_stored import STORED, STORED_SQL

QUERIES, ORACLE_SQL = OLD | MORE | STORED, OLD_SQL | MORE_SQL | STORED_SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    result = duck.sql(ORACLE_SQL[name])
    assert sorted(result.columns) == columns
    want = sorted(repr(r) for r in result.select(*(f'"{c}"' for c in columns)).fetchall())
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, DATA).limit(1).count() == 1


def test_times_of_many_events(spark, tmp_path):
    ids = [None, -900_000, -720_000, -1, 0, 99_999, 2_938_650, 2_938_651, 5_999_999, 106_000_000]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = dict(con.sql(ORACLE_SQL["times"]).fetchall())
    assert {r.event_id: r.text for r in QUERIES["times"](spark, str(tmp_path)).collect()} == want and len(want) == len(ids)
