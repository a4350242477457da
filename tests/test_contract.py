"""Every registered query against its SQL, in DuckDB, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from curatrix.plans import io_queries, state_queries, value_queries  # noqa: E402, F401
from curatrix.plans.fixtures import TABLES  # noqa: E402
from curatrix.plans.queries import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v) or str(v) in ("<NA>", "NaT"):
        return None
    return round(v, 6) if isinstance(v, float) else v


def rows_of(frame, columns):
    return sorted((tuple(str(plain(v)) for v in r) for r in frame[columns].astype(object).itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, small, con):
    got, want = QUERIES[name](spark, small).toPandas(), con.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert len(want) > 0
    a, b = rows_of(got.convert_dtypes(), columns), rows_of(want.convert_dtypes(), columns)
    assert len(a) == len(b)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_query_runs(name, spark, small):
    assert QUERIES[name](spark, small).count() > 0


def test_entry_and_guard(spark, small):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
