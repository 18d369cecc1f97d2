"""Each registered query against its SQL in DuckDB, on the smallest data."""

from __future__ import annotations

import os

import duckdb
import pytest

from lodestone.queries import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(table):
    """Rows as sorted tuples of text, columns by name."""
    columns = sorted(table)
    show = lambda v: "" if v is None else repr(float(v)) if isinstance(v, float | int) and not isinstance(v, bool) else str(v)
    return columns, sorted(tuple(show(v) for v in r) for r in zip(*(table[c] for c in columns), strict=True))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    expected = rows(db.sql(SQL[name]).to_arrow_table().to_pydict())
    assert rows(QUERIES[name](spark, DATA).toArrow().to_pydict()) == expected


def test_entry_and_queries_without_sql(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, DATA).count() > 0
