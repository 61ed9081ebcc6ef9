import re
from pathlib import Path

import duckdb
import pytest

from framewright.plans.catalog import CORE

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def norm(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(CORE.queries))
def test_query_agrees_with_sql(spark, con, name):
    df = CORE.queries[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    assert name in CORE.oracles
    rel = con.execute(CORE.oracles[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr([norm(r[i]) for i in at]) for r in rel.fetchall())


def test_no_python_in_core_plans(spark):
    for name, fn in CORE.queries.items():
        plan = fn(spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Python|Pandas|ArrowEval|CartesianProduct|NestedLoop", plan), name


@pytest.mark.parametrize("name", ["group_advantage", "group_stats_to_members"])
def test_one_exchange(spark, name):
    plan = CORE.queries[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) <= 1
