import math
import numbers

import duckdb
import pytest

from factloom.plans import registry

from .conftest import MEDIUM

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{MEDIUM}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool) or not isinstance(v, numbers.Number):
        return str(v)
    return round(float(v), 9)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query_equals_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, MEDIUM)
    wanted = duck.sql(registry.ORACLE[name])
    names = sorted(got.columns)
    assert names == sorted(wanted.columns)
    at = [wanted.columns.index(n) for n in names]
    left = sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=str)
    right = sorted((tuple(plain(r[i]) for i in at) for r in wanted.fetchall()), key=str)
    assert left == right and left


def test_known_counts(spark):
    assert registry.state_as_of(spark, MEDIUM).count() == 122
    assert registry.vacuum_survivors(spark, MEDIUM).count() == 8648
    assert registry.edge_state_raw(spark, MEDIUM).count() == 5141
    assert registry.edges_visible(spark, MEDIUM).count() == 2424
    assert registry.edges_visible_later(spark, MEDIUM).count() == 3314


def test_resolution_shuffles_once_and_never_collects_a_chain(spark):
    plan = registry.state_as_of(spark, MEDIUM)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_max_by" in plan
