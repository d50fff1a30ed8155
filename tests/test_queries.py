"""Every registered query on the smallest tables, against SQL where there is one."""

import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_point  # noqa: E402

SF_DIR = Path("/root/testdata/sf0.001")
QUERIES = entry_point.queries()
ORACLES = entry_point.oracle_sql()

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    rows = []
    for row in frame.itertuples(index=False):
        gone = [pd.api.types.is_scalar(v) and pd.isna(v) for v in row]
        rows.append(tuple(None if g else v for g, v in zip(gone, row)))
    return sorted(rows, key=repr)


NOT_AT_SCALE = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, plan, name):
    query = QUERIES[name](spark, str(SF_DIR))
    physical = plan(query).split("== Physical Plan ==")[1]
    assert not [node for node in NOT_AT_SCALE if node in physical]
    got = query.toPandas()
    wanted = duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows_of(got) == rows_of(wanted)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, plan, name):
    query = QUERIES[name](spark, str(SF_DIR))
    physical = plan(query).split("== Physical Plan ==")[1]
    assert not [node for node in NOT_AT_SCALE if node in physical]
    assert query.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    matrix = entry_point.entry(spark)
    assert matrix.columns == ["given", "pred", "n", "p", "given_name", "pred_name"]
    assert matrix.count() == 4
