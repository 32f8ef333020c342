"""Battles on a stream against the batch replay and undo."""

import random
from datetime import timedelta

import pytest

from seatward.functions.dims import dim_df
from seatward.operators import territory
from seatward.streaming.battles import cells_of_stream, stream_battles
from test_replay import START
from test_stream_order import displaced, feed_files, few_partitions, finished, minutes  # noqa: F401

LOG = "id long, ts timestamp_ntz, winner_email string, loser_email string, round int, cell_id string, undo_of long"
REGIONS = ["Alsace", "Bourgogne", "Centre", "Lorraine"]


def field(spark):
    champions = spark.createDataFrame([(f"c{i}@x", f"p{i}", REGIONS[i % 4]) for i in range(8)], "email string, pseudo string, region string")
    dim = dim_df(spark, list(zip(REGIONS, "ABCD", strict=True)), [("region", "string"), ("alliance", "string")])
    return champions, dim, territory.create_cells(champions, dim)


def battles(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w, l = rng.randrange(8), rng.randrange(9)
        cell = rng.choice([f"c{rng.randrange(8)}@x#{rng.randrange(2)}", "c0@x#0", None if rng.random() < 0.1 else "none"])
        rows.append((i, START + timedelta(minutes=rng.randrange(300)), f"c{w}@x", f"c{l}@x", rng.randrange(1, 7), cell, None))
    return rows


def test_log_and_cells_equal_the_batch(spark, tmp_path):
    champions, dim, cells = field(spark)
    rows = battles(1)
    parts = displaced(rows, lambda r: (r[1], r[0]), 3, 1, 5)
    stream = feed_files(spark, parts, LOG, tmp_path).drop("undo_of")
    log = finished(stream, "ts", lambda s: stream_battles(s, champions, cells, dim, minutes(300), buckets=3), "b").cache()
    want, after = territory.replay_battles(spark.createDataFrame(rows, LOG).drop("undo_of"), champions, cells, dim)
    assert sorted(map(str, log.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert log.filter("outcome = 'transfer'").count() > 10
    assert sorted(map(str, cells_of_stream(cells, log).collect())) == sorted(map(str, after.collect()))


@pytest.mark.parametrize("k", [8])
def test_undo_entries_equal_the_batch_undo(spark, tmp_path, k):
    """Undoing the last k battles one by one, the newest first, leaves the cells that the batch undo leaves."""
    champions, dim, cells = field(spark)
    rows = battles(2)
    want, after = territory.replay_battles(spark.createDataFrame(rows, LOG).drop("undo_of"), champions, cells, dim)
    moves = want.filter("outcome = 'transfer'")
    last = sorted(moves.collect(), key=lambda r: (r["ts"], r["id"]))[-k:]
    undo = [(1000 + i, START + minutes(400 + i), None, None, None, r["cell_transferred_id"], r["id"]) for i, r in enumerate(reversed(last))]
    # An entry for a battle that is not its cell's last transfer changes nothing.
    undo.append((2000, START + minutes(500), None, None, None, last[0]["cell_transferred_id"], -5))
    stream = feed_files(spark, [rows, undo], LOG, tmp_path)
    log = finished(stream, "ts", lambda s: stream_battles(s, champions, cells, dim, minutes(10), buckets=2, depth=150), "b").cache()
    assert log.filter("outcome = 'undone'").count() == k and log.filter("outcome = 'unmatched'").count() == 1
    _, back = territory.undo_last(moves, after, k)
    assert sorted(map(str, cells_of_stream(cells, log).collect())) == sorted(map(str, back.collect()))
