"""Every query with SQL gives what DuckDB gives; every query runs."""

from __future__ import annotations

import decimal
import math

import duckdb
import pytest

from frameloom.plans import file_queries, fusion_queries, join_queries, online_queries, review_queries, scalar_queries, stateful_queries, summary_queries, track_queries, upkeep_queries  # noqa: F401
from frameloom.plans.catalog import REGISTRY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(float(x)) if isinstance(x, int | float) else str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, duck, small, name):
    q = REGISTRY[name]
    df = q.build(spark, small)
    columns = sorted(df.columns)
    rows = ordered([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    if q.sql is None:
        assert rows
        return
    cur = duck.execute(q.sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert rows == ordered([tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()])


def test_entry_needs_no_training_data_operators(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == REGISTRY["overlap_conflicts"].build(spark, "/root/testdata/sf0.001").columns
    assert set(REGISTRY) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_entry_points_load_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True).returncode == 0
