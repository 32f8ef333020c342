"""What a replay of many rounds leaves in the driver does not grow with the rounds, and a slice's output takes little beside its rows."""

import tracemalloc
from datetime import timedelta
from pathlib import Path

import pandas as pd
import pytest

from seatward.operators import replay
from test_replay import HOLD, START
from test_row_commands import frames, row_log


def plan_size(df):
    """(lines of the plan, digits of the size that the planner expects)"""
    plan = df._jdf.queryExecution().optimizedPlan()
    return len(plan.toString().splitlines()), int(plan.stats().sizeInBytes()).bit_length()


@pytest.mark.parametrize("by_id", [True, False])
def test_plans_do_not_grow_with_the_rounds(spark, by_id):
    few, many = [], []
    for slice_rows, sizes in ((6, few), (2, many)):
        log, cap, payers = frames(spark, [r for r in row_log(7, 40) if r[4] == "equipe"][:12])
        log = log if by_id else log.drop("target").filter("kind not in ('admin', 'promote')")
        for df in replay.replay_requests(log, cap, payers, HOLD, slice_rows):
            sizes.append(plan_size(df))
    for (lines, _), (more, bits) in zip(few, many, strict=True):
        assert more == lines and bits < 128


def test_rows_of_earlier_rounds_are_removed(spark):
    """Of the rows carried on, only those of the last round stay in the shared folder."""
    root = Path(replay.shared_dir(spark).removeprefix("file:"))
    before = set(root.glob("replay-*/rows/*"))
    log, cap, payers = frames(spark, row_log(8, 30))
    replay.replay_requests(log, cap, payers, HOLD, 8)
    assert len(set(root.glob("replay-*/rows/*")) - before) == 1


def test_a_pool_without_a_name(spark):
    """Its waiting rows count, and are promoted, in later slices too."""
    minute = lambda m: START + timedelta(minutes=m)
    log = [(i, minute(i), "create", f"e{i}@y", None, None) for i in range(1, 5)]
    log += [(5, minute(5), "admin", "e5@y", None, None), (6, minute(6), "cancel", "e5@y", None, None), (7, minute(7), "create", "e7@y", None, None)]
    decisions, rows = replay.replay_requests(*frames(spark, log), HOLD, 2)
    got = {r["seq"]: (r["pool"], r["action"], r["waitlist_position"]) for r in decisions.collect()}
    assert got[4] == (None, "waitlisted", 4) and got[6] == (None, "cancel", None) and got[7] == (None, "waitlisted", 4)
    assert {r["id"]: (r["pool"], r["is_waitlist"], r["promoted_at"]) for r in rows.collect()}[1] == (None, False, minute(6))


def test_the_output_of_a_slice_takes_little_beside_its_rows():
    n = 5000
    log = pd.DataFrame({"n": range(1, n + 1), "seq": range(n), "ts": pd.Timestamp("2026-05-01") + pd.to_timedelta(range(n), unit="s"), "kind": "create",
                        "email": [f"user{i}@example.com" for i in range(n)], "pool": "equipe", "is_payer": False})
    tracemalloc.start()
    desk = replay.PoolDesk(100, 0, 0, int(HOLD.total_seconds() * 1_000_000))
    out = replay.replay_entries(desk, log)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(out) == 2 * n and peak < 1.3 * held
