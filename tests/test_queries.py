"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from fleetlens.plans import registry

DATA = os.environ.get("FLEETLENS_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    got = sorted(tuple(plain(v) for v in r) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = duck.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())


def test_stream_of_alerts_decides_as_the_batch(spark):
    stream = {(r.event_id, r.is_sent) for r in registry.queries()["stream_alerts"](spark, DATA).collect()}
    batch = {(r.event_id, r.is_sent) for r in registry.queries()["flood_control"](spark, DATA).collect()}
    assert stream == batch


def test_every_query_has_its_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
