"""Every registered query at the smallest scale, next to its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, compare

SF_DIR = entry.SMALL
QUERIES, SQL = entry.QUERIES, entry.SQL


@pytest.fixture(scope="module")
def connection():
    made = duckdb.connect()
    made.execute("SET TimeZone='UTC'")
    for name in TABLES:
        made.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return made


def test_registry():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["incurred_bucket", "exposure_bucket", "value"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in SQL:
        verdict = compare(df, connection, SQL[name])
        assert verdict.startswith("ok"), verdict
    else:
        assert df.count() > 0
