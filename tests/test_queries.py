"""Every registered query that SQL can express gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal
from pathlib import Path

import pytest

from ledgerloom.plans.registry import ORACLE_SQL, QUERIES, compatible_times

duckdb = pytest.importorskip("duckdb")


def cell(value):
    if isinstance(value, (float, Decimal)):
        return round(float(value), 6) + 0.0
    return str(value) if hasattr(value, "isoformat") else value


def rows(columns, values) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in values)


@pytest.fixture(scope="module")
def oracle(sf_dir):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, oracle, name):
    found = QUERIES[name](spark, sf_dir)
    result = oracle.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    assert sorted(found.columns) == sorted(columns)
    assert rows(found.columns, found.collect()) == rows(columns, expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).columns


def test_day_buckets_lose_no_pair_across_midnight(spark):
    sf = "/root/testdata/sf0.01"
    assert rows(["a", "b"], QUERIES["window_300s"](spark, sf).collect()) == rows(["a", "b"], compatible_times(spark, sf).collect())


def test_entry_module_has_all(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() >= 0
