"""Each registered query against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from strandwise.plans import registry


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, small, name):
    ours = registry.QUERIES[name](spark, small).toPandas()
    theirs = duck.execute(registry.ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (ours, theirs))
    assert len(a) == len(b) > 0
    for c in columns:
        assert a[c].dtype == b[c].dtype and (a[c].fillna(-99) == b[c].fillna(-99)).all(), c


def test_queries_without_sql(spark, small):
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"correct_reads_ranked"}
    assert registry.QUERIES["correct_reads_ranked"](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["kmer", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
