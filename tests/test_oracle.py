"""Every registered query against its DuckDB oracle (sf0.001, whole tables)."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from vectriage.sources.tables import TABLES

import os
import sys
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check_oracle import _digest, _types  # noqa: E402

KEYS = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    sdf = entry.queries()[key](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(entry.oracle_sql()[key])
    assert not _types(sdf, cur)
    dcols = [d[0] for d in cur.description]
    drows = [tuple(r) for r in cur.fetchall()]
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _digest(sdf.columns, srows)[0] == _digest(dcols, drows)[0]


@pytest.mark.parametrize("key", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs_without_oracle(spark, key):
    assert entry.queries()[key](spark, SF_SMALL).count() > 0
