"""Streams whose files come in any order, state that ends, and jobs that go on by timer."""

import os
import random
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest

from seatward.functions import dims
from seatward.operators import dedupe, queue, replay, stock
from seatward.sources.streams import closable, drain, drain_to_table, run_folder, shuffled_files
from seatward.streaming import expiry, reorder
from seatward.streaming.admission import stream_admission
from seatward.streaming.dedupe import stream_dedupe
from seatward.streaming.expiry import apply_changes, stream_expiry
from seatward.streaming.live_stock import LiveStock, latest_stock, stock_at, stream_stock
from test_replay import HOLD, START, admission_frames, clicks, request_log

CLICKS = "k string, t timestamp_ntz, id long"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """A state store per partition is written in each micro-batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def minutes(n):
    return timedelta(minutes=n)


def feed_files(spark, parts, schema, folder):
    """Lists of rows as files that are read one per trigger."""
    for i, part in enumerate(parts):
        path = f"{folder}/f{i:03d}.parquet"
        pq.write_table(spark.createDataFrame(part, schema).toArrow(), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def displaced(rows, at, parts, most, seed):
    """Rows in ``parts`` lists by time, each up to ``most`` lists late."""
    rng = random.Random(seed)
    ordered = sorted(rows, key=at)
    size = -(-len(ordered) // (parts - most))
    out = [[] for _ in range(parts)]
    for i, row in enumerate(ordered):
        out[i // size + rng.randrange(most + 1)].append(row)
    for part in out:
        rng.shuffle(part)
    return [p for p in out if p]


def finished(stream, at, build, name):
    whole, finish = closable(stream, at)
    return drain_to_table(build(whole), name, finish)


@pytest.mark.parametrize("piece_rows", [50_000, 7])
def test_dedupe_of_shuffled_files(spark, tmp_path, monkeypatch, piece_rows):
    monkeypatch.setattr(reorder, "PIECE_ROWS", piece_rows)
    rows = clicks(11, 400) + [(None, START + minutes(5 * i), 1000 + i) for i in range(40)]
    stream = feed_files(spark, displaced(rows, lambda r: r[1], 5, 2, 1), CLICKS, tmp_path)
    build = lambda s: stream_dedupe(s, ["k"], "t", "id", HOLD, delay=minutes(900), buckets=3)
    out = finished(stream, "t", build, "t").cache()
    want = {tuple(r) for r in dedupe.dedupe_holds(spark.createDataFrame(rows, CLICKS), ["k"], "t", "id", HOLD).collect()}
    assert {(r["k"], r["t"], r["id"]) for r in out.filter("outcome = 'kept'").collect()} == want
    assert out.count() == len(rows) and out.filter("outcome = 'late'").count() == 0
    # Every row names the row that holds its place.
    kept = {i: (k, t) for k, t, i in want}
    for r in out.collect():
        k, t = kept[r["kept_id"]]
        assert k == r["k"] and t <= r["t"] < t + HOLD


def test_delay_decides_what_is_late(spark, tmp_path):
    """In the third file the watermark is 10 minutes behind the latest row of the files before."""
    parts = [[("a", START + minutes(60), 0)], [("a", START + minutes(100), 1)], [("a", START + minutes(91), 2), ("a", START + minutes(80), 3), ("a", None, 4)]]
    stream = feed_files(spark, parts, CLICKS, tmp_path)
    out = finished(stream, "t", lambda s: stream_dedupe(s, ["k"], "t", "id", HOLD, delay=minutes(10)), "t").collect()
    assert {r["id"]: (r["outcome"], r["kept_id"]) for r in out} == {
        0: ("kept", 0), 1: ("reused", 2), 2: ("kept", 2), 3: ("late", None), 4: ("late", None)
    }
    assert {r["id"]: r["t"] for r in out}[3] == START + minutes(80) and {r["id"]: r["t"] for r in out}[4] is None


def test_state_of_dedupe_ends(spark, tmp_path):
    """New keys all the time: the store holds what came within delay and hold, however long the stream runs."""
    parts = [[(f"k{p}-{i}", START + minutes(30 * p + i), 100 * p + i) for i in range(30)] for p in range(14)]
    stream = feed_files(spark, parts, CLICKS, tmp_path)
    out = stream_dedupe(stream, ["k"], "t", "id", HOLD, delay=minutes(30), buckets=2)
    base = run_folder(spark, "state")
    progress = drain(spark, out.writeStream.format("parquet").option("path", f"{base}/out"), f"{base}/p")
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert len(sizes) >= 14 and max(sizes[7:]) <= max(sizes[:7]) + 2


@pytest.mark.parametrize("piece_rows", [50_000, 9])
def test_admission_of_shuffled_files(spark, tmp_path, monkeypatch, piece_rows):
    monkeypatch.setattr(reorder, "PIECE_ROWS", piece_rows)
    rows = request_log(4)
    log, cap, payers = admission_frames(spark, rows)
    stream = feed_files(spark, displaced(rows, lambda r: (r[1], r[0]), 4, 2, 2), log.schema, tmp_path)
    out = finished(stream, "ts", lambda s: stream_admission(s, cap, payers, HOLD, delay=minutes(240)), "a")
    decisions, _ = replay.replay_requests(log, cap, payers, HOLD)
    key = lambda df: {r["seq"]: (r["action"], r["row_id"], r["waitlist_position"]) for r in df.filter("seq is not null").collect()}
    assert key(out) == key(decisions)


def test_late_entries_of_admission(spark, tmp_path):
    parts = [[(1, START + minutes(50), "create", "e5@x", "equipe")], [(2, START + minutes(20), "create", "e6@x", "equipe"), (3, START + minutes(45), "create", "e7@x", "equipe")]]
    log, cap, payers = admission_frames(spark, request_log(4))
    stream = feed_files(spark, parts, log.schema, tmp_path)
    out = finished(stream, "ts", lambda s: stream_admission(s, cap, payers, HOLD, delay=minutes(10)), "a").filter("seq is not null")
    assert {r["seq"]: r["action"] for r in out.collect()} == {1: "held", 2: "late", 3: "held"}


def test_shuffled_files_have_all_rows(spark):
    df = spark.createDataFrame(clicks(3, 200) + [("a", None, 999)], CLICKS)
    folder, delay = shuffled_files(df, "t", 6, 2)
    assert timedelta(minutes=400) < delay < timedelta(minutes=500)
    got = spark.read.parquet(folder)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))


def bookings(seed, n=160):
    """Holds and waitlist entries of two pools; some waiting rows are paid, some holds are paid or cancelled later."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        status = rng.choice(["pending"] * 6 + ["paid", "cancelled"])
        rows.append(dict(id=i, email=f"u{i}@x", pool=rng.choice(["equipe", "narratif", "narratif"]), payment_status=status, is_waitlist=rng.random() < 0.45,
                         created_at=START + minutes(rng.randrange(0, 400)), admin_notes=rng.choice([None, "n"])))
    return rows


@pytest.mark.parametrize(("hold_from", "entries"), [("created_at", 4096), ("promoted_at", 3)])
def test_expiry_equals_the_batch_job_at_each_instant(spark, tmp_path, monkeypatch, requests_df, hold_from, entries):
    monkeypatch.setattr(expiry, "ENTRIES", entries)
    rows = bookings(5, 60)
    df = requests_df(rows)
    parts = displaced(df.collect(), lambda r: (r["created_at"], r["id"]), 4, 2, 3)
    stream = feed_files(spark, parts, df.schema, tmp_path)
    out = finished(stream, "created_at", lambda s: stream_expiry(s, minutes(400), HOLD, minutes(40), hold_from=hold_from), "e").cache()
    assert out.filter("action = 'late'").count() == 0
    # The job of the batch operator, over what is there at each instant, until nothing changes any more.
    want = brute_job(rows, 40, hold_from)
    assert sorted((r["id"], r["action"], r["created_at"]) for r in out.collect()) == sorted(want)
    got = apply_changes(df, out)
    snapshot = df.limit(0)
    now, last = START, max(t for *_, t in want)
    while now <= last:
        now += minutes(40)
        fresh = df.filter((df["created_at"] <= now) & (df["created_at"] > now - minutes(40)) | ((now == START + minutes(40)) & (df["created_at"] <= now)))
        snapshot = spark.createDataFrame(queue.expire_holds(snapshot.unionByName(fresh), now, HOLD, hold_from=hold_from).collect(), df.schema)
    assert sorted(map(str, got.collect())) == sorted(map(str, snapshot.select(got.columns).collect()))


def brute_job(rows, period, hold_from="created_at"):
    """Each instant of the job over a plain list of rows."""
    changes = []
    for pool in {r["pool"] for r in rows}:
        live = [dict(r, start=r["created_at"]) for r in rows if r["pool"] == pool and r["payment_status"] != "cancelled"]
        now = START
        while now < START + minutes(60 * 24 * 30):
            now += minutes(period)
            here = [r for r in live if r["created_at"] <= now and r["payment_status"] != "cancelled"]
            stale = [r for r in here if r["payment_status"] == "pending" and not r["is_waitlist"] and r["start"] < now - HOLD]
            line = sorted((r for r in here if r["is_waitlist"]), key=lambda r: (r["created_at"], r["id"]))
            for r in stale:
                r["payment_status"] = "cancelled"
                changes.append((r["id"], "expired", now))
            for r in line[: len(stale)]:
                r["is_waitlist"] = False
                r["start"] = now if hold_from == "promoted_at" else r["start"]
                changes.append((r["id"], "promoted", now))
            if not stale and now > START + minutes(400) and not any(r["payment_status"] == "pending" and not r["is_waitlist"] for r in here):
                break
    return changes


def test_changes_of_rows_end_their_hold_or_free_their_place(spark, tmp_path):
    """A paid hold does not expire; a cancelled one promotes at once; a cancelled queue entry is passed over; cancelling an expired row does nothing."""
    row = lambda id, at, status, waits, made: (id, "equipe", status, waits, START + minutes(made), START + minutes(at))
    parts = [
        [row(1, 0, "pending", False, 0), row(2, 1, "pending", False, 1), row(3, 2, "pending", True, 2), row(4, 3, "pending", True, 3), row(5, 4, "pending", True, 4)],
        [row(1, 10, "paid", False, 0), row(3, 11, "cancelled", True, 2), row(2, 12, "cancelled", False, 1), row(6, 13, "pending", False, 13)],
        [row(6, 90, "cancelled", False, 13), row(1, 95, "cancelled", False, 0)],
    ]
    stream = feed_files(spark, parts, "id long, pool string, payment_status string, is_waitlist boolean, created_at timestamp_ntz, at timestamp_ntz", tmp_path)
    out = finished(stream, "at", lambda s: stream_expiry(s, minutes(5), HOLD, minutes(10), at="at"), "e").collect()
    # 4 is promoted by the cancellation of 2 at 12 and is stale at 40; that promotes 5, which is stale at 50; 6 expires at 50 too.
    want = {(4, "promoted", 12), (4, "expired", 40), (5, "promoted", 40), (5, "expired", 50), (6, "expired", 50)}
    assert {(r["id"], r["action"], round((r["at"] - START) / minutes(1))) for r in out} == want


def live_rows(n):
    return [
        dict(id=i, email=f"u{i}@x", pool="equipe" if i % 3 else "narratif", created_at=START + minutes(10 * i), is_waitlist=i % 7 == 0, promoted_at=START)
        for i in range(n)
    ]


def test_live_stock_reads_no_history(spark, tmp_path, requests_df, payers_df):
    """The tables that a micro-batch reads stay as small as what is active; older versions are gone."""
    rows = [r | dict(is_waitlist=False) for r in live_rows(60)]
    schema = requests_df([]).schema
    frame = requests_df(rows).collect()
    stream = feed_files(spark, [frame[i : i + 10] for i in range(0, 60, 10)], schema, tmp_path)
    base, cap, payers = run_folder(spark, "live"), dims.inscription_pools(spark), payers_df([])
    drain(spark, stream_stock(stream, cap, payers, f"{base}/rows", f"{base}/out", HOLD), f"{base}/p")
    store = LiveStock(spark, f"{base}/rows", stored_schema(spark, f"{base}/rows"))
    assert store.newest() == 5
    assert [(store.read("rows", n).count(), store.read("steps", n).count()) for n in (4, 5)] == [(3, 3), (3, 3)]
    assert sorted(os.listdir(f"{base}/rows/rows")) == ["version=4", "version=5"] and os.listdir(f"{base}/rows/landed") == ["version=5"]


def stored_schema(spark, table):
    return spark.read.parquet(f"{table}/rows/version=5").schema


@pytest.mark.parametrize("parts", [1, 4])
def test_stock_when_holds_merely_expire(spark, tmp_path, requests_df, payers_df, parts):
    rows = live_rows(24)
    df, payers = requests_df(rows), payers_df([dict(id=1, email="U22@x", pool="equipe"), dict(id=2, email="z@x", pool="jeu_libre")])
    frame = df.collect()
    size = -(-24 // parts)
    stream = feed_files(spark, [frame[i : i + size] for i in range(0, 24, size)], df.schema, tmp_path)
    base, cap = run_folder(spark, "live"), dims.inscription_pools(spark)
    drain(spark, stream_stock(stream, cap, payers, f"{base}/rows", f"{base}/out", HOLD), f"{base}/p")
    for late in (0, 5, 10, 20, 29, 30, 300):
        now = rows[-1]["created_at"] + minutes(late)
        want = stock.stock(cap, payers, df, now, HOLD)
        got = stock_at(spark, f"{base}/rows", cap, payers, now)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_repeated_batch_changes_nothing(spark, tmp_path, requests_df, payers_df):
    """A micro-batch that runs again after a failure leaves what it left the first time."""
    frame = requests_df(live_rows(30)).collect()
    stream = feed_files(spark, [frame[i : i + 10] for i in range(0, 30, 10)], requests_df([]).schema, tmp_path)
    base, cap, payers = run_folder(spark, "live"), dims.inscription_pools(spark), payers_df([])
    writer = stream_stock(stream, cap, payers, f"{base}/rows", f"{base}/out", HOLD)
    drain(spark, writer, f"{base}/p")
    before = sorted(map(str, latest_stock(spark, f"{base}/out").collect()))
    os.remove(f"{base}/p/commits/2")
    if os.path.exists(f"{base}/p/commits/.2.crc"):
        os.remove(f"{base}/p/commits/.2.crc")
    drain(spark, stream_stock(stream, cap, payers, f"{base}/rows", f"{base}/out", HOLD), f"{base}/p")
    assert sorted(map(str, latest_stock(spark, f"{base}/out").collect())) == before
