"""Replay with commands by row id, fairness and holds from promotion, against a sequential program."""

import random
from datetime import timedelta

import pytest

from seatward.operators import replay
from test_replay import CAPS, HOLD, PAID, POOLS, START

LOG = "seq long, ts timestamp_ntz, kind string, email string, pool string, target long"
TOP = 2**63 - 10_000_000


def row_log(seed, n=260):
    rng = random.Random(seed)
    kinds = ["create"] * 7 + ["admin", "pay", "waive", "cancel", "cancel", "cancel", "unmark", "unmark", "promote", "promote"]
    log, made = [], []
    for i in range(n):
        seq, kind, pool = TOP + i * 3, rng.choice(kinds), POOLS[rng.random() < 0.3]
        target = None
        if kind not in ("create", "admin") and rng.random() < 0.8:
            target = rng.choice(made) if made and rng.random() < 0.95 else TOP - 1
        log.append((seq, START + timedelta(minutes=i * 240 // n + rng.randrange(3)), kind, f"e{rng.randrange(14)}@x.org", pool, target))
        made.append(seq)
    return log


def sequential(log, fair=False, anew=False):
    payers = {e for e, _ in PAID}
    paid = {p: sum(q == p for _, q in PAID) for p in POOLS}
    rows, decisions = [], {}
    start = lambda r: r["promoted"] if anew and r["promoted"] else r["at"]
    for seq, t, kind, email, pool, target in sorted(log, key=lambda r: (r[1], r[0])):
        mine = [r for r in rows if r["pool"] == pool]
        live = [r for r in mine if r["status"] != "cancelled"]
        line = [r for r in live if r["wait"]]
        if kind in ("create", "admin"):
            active = [r for r in live if r["status"] == "pending" and not r["wait"] and start(r) > t - HOLD]
            same = [r for r in active if r["email"] == email]
            if kind == "create" and same:
                decisions[seq] = ("reused", same[-1]["id"], None)
                continue
            taken = paid[pool] + sum(r["email"] not in payers for r in active)
            wait = kind == "create" and (CAPS[pool] - taken <= 0 or (fair and bool(line)))
            rows.append(dict(id=seq, pool=pool, email=email, at=t, status="pending", wait=wait, promoted=None, paid=None, gone=None))
            decisions[seq] = ("created", seq, None) if kind == "admin" else ("waitlisted", seq, len(line) + 1) if wait else ("held", seq, None)
            continue
        found = [r for r in mine if r["id"] == target] if target is not None else [r for r in live if r["email"] == email]
        row = found[-1] if found else None
        if row is None or (kind == "promote" and (row["status"] == "cancelled" or not row["wait"])):
            decisions[seq] = ("unmatched", None, None)
            continue
        decisions[seq] = (kind, row["id"], None)
        if kind == "promote":
            row["wait"], row["promoted"] = False, t
            continue
        was, row["status"] = row["status"], {"pay": "paid", "waive": "waived", "unmark": "pending", "cancel": "cancelled"}[kind]
        if kind == "cancel":
            row["gone"] = t
            line = [r for r in line if r is not row]
            if was != "cancelled" and not row["wait"] and line:
                line[0]["wait"], line[0]["promoted"] = False, t
        else:
            row["gone"], row["paid"] = None, t if kind in ("pay", "waive") else None
    return decisions, {r["id"]: (r["status"], r["wait"], r["promoted"], r["paid"], r["gone"]) for r in rows}


def frames(spark, log):
    cap = spark.createDataFrame(list(CAPS.items()), "pool string, capacity int")
    payers = spark.createDataFrame([(e.upper(), p) for e, p in PAID], "email string, pool string")
    return spark.createDataFrame(log, LOG), cap, payers


@pytest.mark.parametrize(("seed", "slice_rows", "fair", "hold_from"), [
    (1, 1_000_000, False, "created_at"), (2, 30, False, "created_at"), (3, 1_000_000, True, "promoted_at"), (4, 25, True, "promoted_at"), (5, 8, False, "promoted_at"),
])
def test_commands_by_id(spark, seed, slice_rows, fair, hold_from):
    log = row_log(seed)
    decisions, rows = replay.replay_requests(*frames(spark, log), HOLD, slice_rows, fair=fair, hold_from=hold_from)
    want, want_rows = sequential(log, fair, hold_from == "promoted_at")
    assert {r["seq"]: (r["action"], r["row_id"], r["waitlist_position"]) for r in decisions.collect()} == want
    got = {r["id"]: (r["payment_status"], r["is_waitlist"], r["promoted_at"], r["paid_at"], r["cancelled_at"]) for r in rows.collect()}
    assert got == want_rows
    # The log does meet the cases: rows that come back, and rows that wait again.
    assert {"created", "promote", "unmatched", "cancel", "unmark"} <= {a for a, _, _ in want.values()}


@pytest.mark.parametrize("slice_rows", [1_000_000, 1])
def test_cancelled_then_paid(spark, slice_rows):
    """The same row cancelled and then paid; a waiting one that comes back is at its old place in the queue."""
    minute = lambda m: START + timedelta(minutes=m)
    log = [(i, minute(i), "create", f"e{i + 20}@x", "equipe", None) for i in range(1, 7)]  # 1, 2 held (one place is paid), 3 to 6 wait
    log += [
        (10, minute(10), "cancel", "-", "equipe", 3), (11, minute(11), "cancel", "-", "equipe", 1), (12, minute(12), "unmark", "-", "equipe", 3),
        (13, minute(13), "pay", "-", "equipe", 1), (14, minute(14), "cancel", "-", "equipe", 2), (15, minute(15), "promote", "-", "equipe", 6),
        (16, minute(16), "pay", "-", "jeu_libre", 1), (17, minute(17), "cancel", "-", "equipe", 2), (18, minute(18), "cancel", "-", "equipe", 4),
    ]
    decisions, rows = replay.replay_requests(*frames(spark, log), HOLD, slice_rows)
    got = {r["id"]: (r["payment_status"], r["is_waitlist"], r["promoted_at"]) for r in rows.collect()}
    assert got == {
        1: ("paid", False, None), 2: ("cancelled", False, None), 3: ("pending", False, minute(14)), 4: ("cancelled", False, minute(11)),
        5: ("pending", False, minute(18)), 6: ("pending", False, minute(15)),
    }
    assert {r["seq"]: r["action"] for r in decisions.collect()}[16] == "unmatched"


def test_a_round_reads_its_own_slice(spark):
    """The log lies in a folder per round, and only that folder is read."""
    log, cap, payers = frames(spark, row_log(6, 90))
    known = replay.prepare_log(log, cap, payers)
    ranked = replay.rank_rows(known, ["pool"], ["ts", "seq"], "n")
    folder = replay._slices(ranked, 20)
    parts = [spark.read.parquet(f"{folder}/_round={k}") for k in range(3)]
    assert all(p.agg({"n": "min"}).first()[0] == 20 * k + 1 and p.agg({"n": "max"}).first()[0] <= 20 * k + 20 for k, p in enumerate(parts))
    assert len(parts[0].inputFiles()) <= 4
