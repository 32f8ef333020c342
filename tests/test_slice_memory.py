"""What a task of the replay holds is bounded by the slice, whatever the log."""

import tracemalloc
from datetime import timedelta

import pandas as pd

from seatward.operators.replay import SLICE_ROWS, PoolDesk, replay_entries


def test_a_slice_of_creations_fits_a_worker():
    n = 5000
    log = pd.DataFrame({"n": range(1, n + 1), "seq": range(n), "ts": pd.Timestamp("2026-05-01") + pd.to_timedelta(range(n), unit="s"), "kind": "create",
                        "email": [f"user{i}@example.com" for i in range(n)], "pool": "equipe", "is_payer": False})
    tracemalloc.start()
    desk = PoolDesk(100, 0, 0, int(timedelta(minutes=30).total_seconds() * 1_000_000))
    out = replay_entries(desk, log)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Four tasks an executor, and as much again for the rows in reach, in 4,000 MB.
    assert len(out) == 2 * n and peak / n * SLICE_ROWS * 4 * 2 < 4e9
