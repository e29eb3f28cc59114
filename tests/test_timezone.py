"""Results must not depend on the session time zone (the data is wall-clock timestamp_ntz)."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from vectriage.sources.tables import TABLES

from test_oracle import _digest

KEYS = ["reviews_enrich", "review_statistics", "time_weighted_search", "multi_factor_search",
        "trending_issues", "production_triage"]


@pytest.mark.parametrize("key", KEYS)
def test_non_utc_session(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        sdf = entry.queries()[key](spark, SF_SMALL)
        got = _digest(sdf.columns, [tuple(r) for r in sdf.collect()])[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    cur = con.execute(entry.oracle_sql()[key])
    assert got == _digest([d[0] for d in cur.description], cur.fetchall())[0]
