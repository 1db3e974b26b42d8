import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry
from millwright.plans import queries as machine

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("events", "orders", "lineitem", "supplier", "nation", "region")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the provided tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def one(v):
        if isinstance(v, datetime.datetime):
            return v.isoformat()
        return str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(machine.queries()))
def test_query_equals_sql(spark, duck, name):
    df = machine.queries()[name](spark, SF)
    columns = sorted(df.columns)
    sql = duck.sql(f"SELECT {', '.join(columns)} FROM ({machine.oracle_sql()[name]})").fetchall()
    assert plain(df.select(*columns).collect()) == plain(sql)


def test_entry(spark):
    assert set(machine.queries()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
