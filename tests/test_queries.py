import decimal
import os

import duckdb
import pytest

from meterloom import queries as engine

NAMES = sorted(engine.queries())


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


def _plain(v):
    return int(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, sf_dir, duck, name):
    df = engine.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in engine.oracle_sql():
        assert got
        return
    found = duck.execute(engine.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)


def test_entry_keeps_working_without_the_optional_operators(spark):
    import __spark_entry__

    assert set(engine.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    from meterloom.plans.compiler import compile_plan
    from meterloom.plans.query import Metric, QueryPlan
    from meterloom.sources.usage import events_as_usage

    raw = events_as_usage(spark, sf_dir)
    plan = compile_plan(QueryPlan(group_by=("meter_id",), metrics=(("quantity", Metric.SUM),)), raw)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[1]
    assert plan.count("Exchange") == 1
