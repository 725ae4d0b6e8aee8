"""Every registered query against its SQL, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from tools.check_oracle import rows_of  # noqa: E402

SF = Path("/root/testdata/sf0.001")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in SF.glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_contract(spark):
    assert set(ORACLE) <= set(QUERIES)
    without = {name for name in set(QUERIES) - set(ORACLE) if not name.startswith("op") and name != "pipeline"}
    assert not without  # the training-data operators that SQL cannot express have tests of their own
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not SF.exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    result = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(result.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(result.columns, result.fetchall())
