"""Every registered query against its DuckDB twin at sf0.001 (the driver
runs the same comparison at sf0.01)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from oracle_check import TABLES, digest  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from conftest import SF_SMALL  # noqa: E402

NAMES = sorted(oracle_sql())


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    from trade_insights.catalog import QUERIES
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, name):
    df = queries()[name](spark, SF_SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(oracle_sql()[name])
    d_cols = [c[0] for c in cur.description]
    d_rows = [tuple(r) for r in cur.fetchall()]
    assert sorted(df.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    hs, ls = digest(df.columns, s_rows)
    hd, ld = digest(d_cols, d_rows)
    assert hs == hd, (sorted(set(ls) - set(ld))[:3], sorted(set(ld) - set(ls))[:3])


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.columns == ["exporter_name", "shipment_count", "total_fob"]
    assert df.count() > 0
