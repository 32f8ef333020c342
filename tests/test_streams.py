"""A stream fed file by file ends where the batch operator ends."""

import os
from datetime import timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException

from seatward.functions import dims
from seatward.operators import dedupe, replay, stock
from seatward.sources.streams import drain, drain_to_table, run_folder, stream_table
from seatward.streaming.admission import stream_admission
from seatward.streaming.dedupe import stream_dedupe
from seatward.streaming.live_stock import latest_stock, stream_stock
from test_replay import HOLD, START, admission_frames, clicks, request_log


def feed(spark, df, folder, name, parts, order):
    """Write the rows in ``order`` as numbered files and read them one per trigger."""
    rows = sorted(df.collect(), key=lambda r: tuple(r[o] for o in order))
    size = -(-len(rows) // parts)
    for i in range(parts):
        path = f"{folder}/{name}{i}.parquet"
        pq.write_table(spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).toArrow(), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return (
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", f"{name}*.parquet").parquet(str(folder))
    )


def test_stream_source_reads_folders_and_files(spark, tmp_path):
    """A table is a folder of any file names, or one file; neighbours whose names start alike are not read."""
    spark.range(100).repartition(4).write.parquet(f"{tmp_path}/part.parquet")
    pq.write_table(spark.range(7).toArrow(), tmp_path / "partial.parquet")
    pq.write_table(spark.range(9).toArrow(), tmp_path / "orders.parquet")
    spark.range(50).write.parquet(f"{tmp_path}/orders_old.parquet")
    for name, rows in (("part", 100), ("partial", 7), ("orders", 9), ("orders_old", 50)):
        assert drain_to_table(stream_table(spark, str(tmp_path), name, 1), name).count() == rows
    with pytest.raises(AnalysisException):
        stream_table(spark, str(tmp_path), "missing")


def test_ids_of_any_size(spark, tmp_path):
    """Batch, slices and stream hand on ids near 2^63 as they are."""
    log, cap, payers = admission_frames(spark, request_log(3))
    top = 2**63 - 10_000_000
    large = log.withColumn("seq", log["seq"] + top)
    small = {(r["seq"], r["action"], r["row_id"]) for r in replay.replay_requests(log, cap, payers, HOLD)[0].collect()}
    want = {(s + top, a, None if i is None else i + top) for s, a, i in small}
    for given in ({}, {"slice_rows": 20}):
        decisions, rows = replay.replay_requests(large, cap, payers, HOLD, **given)
        assert {(r["seq"], r["action"], r["row_id"]) for r in decisions.collect()} == want
        assert all(r["id"] > top - 1 for r in rows.collect())
    stream = feed(spark, large, tmp_path, "l", 2, ["ts", "seq"])
    out = drain_to_table(stream_admission(stream, cap, payers, HOLD), "a").filter("seq is not null")
    assert {(r["seq"], r["action"], r["row_id"]) for r in out.collect()} == want


def test_dedupe_stream(spark, tmp_path):
    df = spark.createDataFrame(clicks(7, 200), "k string, t timestamp_ntz, id long")
    out = drain_to_table(stream_dedupe(feed(spark, df, tmp_path, "c", 4, ["t", "id"]), ["k"], "t", "id", HOLD), "t").cache()
    want = {tuple(r) for r in dedupe.dedupe_holds(df, ["k"], "t", "id", HOLD).collect()}
    assert {(r["k"], r["t"], r["id"]) for r in out.filter("outcome = 'kept'").collect()} == want
    assert out.count() == 200 and out.filter("outcome = 'late'").count() == 0


def test_late_click_is_reported(spark, tmp_path):
    rows = [("a", START + timedelta(minutes=50), 0), ("a", START, 1)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, id long")
    out = drain_to_table(stream_dedupe(feed(spark, df, tmp_path, "c", 2, ["id"]), ["k"], "t", "id", HOLD), "t")
    assert {r["id"]: r["outcome"] for r in out.collect()} == {0: "kept", 1: "late"}


@pytest.mark.parametrize("parts", [1, 5])
def test_admission_stream(spark, tmp_path, parts):
    log, cap, payers = admission_frames(spark, request_log(3))
    stream = feed(spark, log, tmp_path, "l", parts, ["ts", "seq"])
    out = drain_to_table(stream_admission(stream, cap, payers, HOLD), "a").filter("seq is not null")
    decisions, _ = replay.replay_requests(log, cap, payers, HOLD)
    key = lambda df: {r["seq"]: (r["action"], r["row_id"], r["waitlist_position"]) for r in df.collect()}
    got, want = key(out), key(decisions)
    late = [s for s, v in got.items() if v[0] == "late"]
    assert late == [] and got == want


def test_live_stock(spark, tmp_path, requests_df, payers_df):
    rows = [
        dict(id=i, email=f"u{i}@x", pool="equipe" if i % 3 else "narratif", created_at=START + timedelta(minutes=4 * i), is_waitlist=i % 5 == 0)
        for i in range(30)
    ]
    reqs, payers = requests_df(rows), payers_df([dict(id=1, email="U29@x", pool="equipe")])
    base = run_folder(spark, "live")
    cap = dims.inscription_pools(spark)
    stream = feed(spark, reqs, tmp_path, "r", 3, ["created_at"])
    drain(spark, stream_stock(stream, cap, payers, f"{base}/rows", f"{base}/out", HOLD), f"{base}/p")
    got = latest_stock(spark, f"{base}/out").select("pool", "taken", "remaining", "waitlist_count")
    want = stock.stock(cap, payers, reqs, rows[-1]["created_at"], HOLD)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


@pytest.mark.parametrize("parts", [1, 3, 10])
def test_live_stock_of_changing_rows(spark, tmp_path, requests_df, payers_df, parts):
    """Rows that come again with another status or flag replace the earlier ones, however the input is cut."""
    first = [
        dict(id=i, email=f"u{i}@x", pool="equipe" if i % 3 else "narratif", created_at=START + timedelta(minutes=i), is_waitlist=i % 4 == 0, promoted_at=START)
        for i in range(24)
    ]
    change = {0: dict(payment_status="cancelled"), 1: dict(is_waitlist=False), 2: dict(payment_status="paid"), 3: dict()}
    second = [r | change[r["id"] % 4] | dict(promoted_at=START + timedelta(minutes=60)) for r in first if r["id"] % 2 == 0]
    stream = feed(spark, requests_df(first + second), tmp_path, "r", parts, ["promoted_at", "id"])
    base, cap, payers = run_folder(spark, "live"), dims.inscription_pools(spark), payers_df([dict(id=1, email="u5@x", pool="equipe")])
    drain(spark, stream_stock(stream, cap, payers, f"{base}/rows", f"{base}/out", HOLD, version="promoted_at"), f"{base}/p")
    final = requests_df(list(({r["id"]: r for r in first} | {r["id"]: r for r in second}).values()))
    want = stock.stock(cap, payers, final, START + timedelta(minutes=23), HOLD)
    got = latest_stock(spark, f"{base}/out").select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
