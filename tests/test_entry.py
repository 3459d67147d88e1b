"""Every registered query against its oracle SQL in DuckDB, at the smallest size."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def rows(df, whole=()):
    """Names and sorted rows; whole: integer columns, which pandas may hold as floats where they have nulls."""

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return None
        return v.item() if hasattr(v, "item") else v

    for c in whole:
        df[c] = df[c].astype("Int64")
    names = sorted(df.columns)
    return names, sorted(repr(tuple(map(plain, r))) for r in df[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in NAMES if n in SQL])
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    assert rows(df.toPandas(), [c for c, kind in df.dtypes if kind in ("int", "bigint")]) == rows(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", [n for n in NAMES if n not in SQL and not n.startswith("op") and n != "pipeline"])
def test_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
