"""Every query against its check SQL on the small tables, and the shape of key plans."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from seatward.plans import ORACLES, QUERIES
from seatward.sources.fixtures import TABLES

FOLDER = os.environ.get("SEATWARD_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not there")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    plain = lambda v: None if v is pd.NaT or v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else str(v)
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_check_sql(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    # Spark hands whole numbers with nulls over as floats, the check engine as nullable integers.
    got = got.astype({c: "Int64" for c in got.columns if str(want[c].dtype) == "Int64" and str(got[c].dtype) == "float64"})
    assert rows(got) == rows(want)


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 3


def test_every_query_has_check_sql_and_streams_agree(spark):
    """Queries of the optional subpackage aside, whose own tests say how they are checked."""
    assert not set(QUERIES) - set(ORACLES)
    batch = entry.queries()["replay_requests"](spark, FOLDER)
    stream = entry.queries()["stream_admission"](spark, FOLDER).select(batch.columns)
    assert batch.count() == stream.count() and batch.exceptAll(stream).count() == 0



def plan(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["stock_final", "stock_timeline", "waitlist_position", "apply_status", "replay_battles", "dedupe_holds", "validate_requests", "admit_batch"])
def test_plan_stays_in_the_jvm(spark, name):
    text = plan(spark, name)
    for node in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "Pandas"):
        assert node not in text


def test_flagship_scans_few_columns_with_filters(spark):
    text = plan(spark, "stock_final")
    assert "o_totalprice" not in text and "c_name" not in text
    assert "c_acctbal" not in text and "c_phone" not in text
    # Holds are counted per e-mail before they meet the payers.
    assert "LeftAnti" in plan(spark, "unpaid_holds") and "LeftAnti" not in text
