"""A few registered queries against their DuckDB oracle at sf0.001 (the driver runs all of them at sf0.01)."""

import math

import duckdb
import pytest

from conftest import SF_SMALL

KEYS = ["threshold_sweep", "eval_all", "batch_plan", "energy_rollup", "rouge_2", "embed_match", "cost_quality", "stream_energy"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, key):
    import __spark_entry__ as E
    from tiergate.sources.tables import TABLES

    df = E.queries()[key](spark, SF_SMALL)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    rel = con.sql(E.oracle_sql()[key])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    a = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    idx = [rel.columns.index(c) for c in cols]
    b = sorted(tuple(_norm(r[i]) for i in idx) for r in rel.fetchall())
    assert a == b


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"strategy", "threshold", "n", "unlabelled", "m_pre", "m_rec", "m_f1"}
