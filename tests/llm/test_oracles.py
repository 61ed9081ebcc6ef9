"""Queries whose SQL can run on the whole tables agree with it."""

from pathlib import Path

import duckdb
import pytest

from framewright.llm.queries import LLM

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not there")
@pytest.mark.parametrize("name", sorted(LLM.oracles))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    df = LLM.queries[name](spark, str(DATA))
    cols = sorted(df.columns)
    rel = con.execute(LLM.oracles[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    tidy = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    want = sorted(repr([tidy(r[names.index(c)]) for c in cols]) for r in rel.fetchall())
    assert sorted(repr([tidy(r[c]) for c in cols]) for r in df.collect()) == want
