"""Every series query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from chronoloom.plans import queries as series

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", series.queries())
def test_query_equals_sql(name, spark, duck):
    got = series.queries()[name](spark, SF)
    want = duck.execute(series.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["key", "ts_nanos", "v1", "v2"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_selections_are_pushed(spark):
    plan = series.queries()["key_range_incl"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # the adapters' keys are computed, so the scan reads all, but nothing moves
