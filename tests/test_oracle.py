"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def plain(row):
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else str(round(v, 6) + 0.0) if isinstance(v, float) else str(v) for v in row)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    df, want = QUERIES[name](spark, FOLDER), duck.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert sorted(plain(r) for r in df.select(*columns).collect()) == sorted(plain(r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(ORACLE) if not n.startswith("op") and n != "pipeline"))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "n_sections", "tokens", "root", "terms"]
