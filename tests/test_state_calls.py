"""Stateful rules on a store of plain dictionaries that counts its calls: they go by pages and pieces, not by rows."""

import random
from datetime import timedelta

import pandas as pd
import pytest

from seatward.operators.replay import PoolDesk, replay_entries
from seatward.streaming import admission, reorder
from seatward.streaming.admission import OrderedPoolAdmission, PoolAdmission
from seatward.streaming.battles import CellsInOrder
from seatward.streaming.dedupe import KeepFirstOfHold
from seatward.streaming.expiry import ExpireAndPromote
from seatward.streaming.reorder import INSTANT, NEVER, Paged


class Store:
    """A handle, its value and map states, and the timer values of one key."""

    def __init__(self):
        self.calls, self.mark = 0, 0

    def getValueState(self, name, schema):
        return _Value(self)

    def getMapState(self, name, key, value):
        return _Map(self)

    def registerTimer(self, at):
        self.timer = at

    def deleteTimer(self, at):
        self.timer = None

    def getCurrentWatermarkInMs(self):
        return self.mark


class _Value:
    def __init__(self, store):
        self.store, self.value = store, None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.store.calls += 1
        self.value = value

    def clear(self):
        self.value = None


class _Map:
    def __init__(self, store):
        self.store, self.values = store, {}

    def containsKey(self, key):
        self.store.calls += 1
        return key in self.values

    def getValue(self, key):
        self.store.calls += 1
        return self.values.get(key)

    def updateValue(self, key, value):
        self.store.calls += 1
        self.values[key] = value

    def removeKey(self, key):
        self.store.calls += 1
        self.values.pop(key, None)

    def iterator(self):
        return iter(list(self.values.items()))


def feed(processor, store, key, frame, mark):
    """Rows of a micro-batch, then the timer at the watermark ``mark`` (milliseconds)."""
    out = list(processor.handleInputRows(key, iter([frame]), store)) if frame is not None else []
    store.mark = mark
    return out + list(processor.handleExpiredTimer(key, store, None))


def test_pages_hold_what_was_put(monkeypatch):
    monkeypatch.setattr("seatward.streaming.reorder.PAGES", 3)
    pages, want = Paged(Store(), "p", lambda k: k % 7), {}
    for turn in range(5):
        pages.load()
        for k in range(40):
            if (k + turn) % 3 == 0:
                pages.remove(k)
                want.pop(k, None)
            else:
                pages.put(k, (turn, k))
                want[k] = (turn, k)
        pages.save()
    pages.load()
    assert {k: pages.get(k) for k in range(40) if pages.get(k) is not None} == want


@pytest.mark.parametrize("n", [4000])
def test_expiry_calls_go_by_pages(n):
    store, hold = Store(), timedelta(minutes=30)
    rule = ExpireAndPromote(hold, timedelta(minutes=10), False)
    rule.init(store)
    minute = 60_000_000
    at = [minute * (1 + i // 10) for i in range(n)]
    rows = pd.DataFrame({INSTANT: at, "id": range(n), "start": at, "is_waitlist": [i % 3 == 0 for i in range(n)], "open": [i % 4 < 3 for i in range(n)],
                         "cancelled": [i % 4 == 3 for i in range(n)], "changed": False})
    out = pd.concat(feed(rule, store, ("k",), rows, 10**9))
    opened = [i for i in range(n) if i % 4 < 3]
    assert sorted(out["id"][out["action"] == "expired"]) == opened
    assert sorted(out["id"][out["action"] == "promoted"]) == [i for i in opened if i % 3 == 0]
    # Index, buffer, lists, clock and marks; one call a row or more before.
    assert store.calls < 60


def _served(processor, frames, late):
    """Rows through a processor, each frame a micro-batch; the decisions by ``seq``."""
    store, out = Store(), []
    processor.init(store)
    for frame in frames:
        cut = [frame.iloc[i : i + 50] for i in range(0, len(frame), 50)]
        out += list(processor.handleInputRows(("equipe",), iter(cut), store))
        if late:
            store.mark = int(frame["ts"].max().timestamp() * 1000)
            out += list(processor.handleExpiredTimer(("equipe",), store, None))
    if late:
        store.mark = 10**14
        out += list(processor.handleExpiredTimer(("equipe",), store, None))
    told = pd.concat(out)
    return {r["seq"]: (r["action"], r["row_id"]) for r in told[told["seq"].notna()].to_dict("records")}, store, processor


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("run", "piece", "stack"), [(200_000, 10_000, 256), (120, 17, 2)])
def test_admission_in_runs_equals_one_step(monkeypatch, seed, run, piece, stack):
    """Entries in any order within a micro-batch, served in steps with little state in memory, as in one step over all."""
    monkeypatch.setattr(reorder, "RUN_ROWS", run)
    monkeypatch.setattr(reorder, "PIECE_ROWS", piece)
    monkeypatch.setattr(admission, "STACK", stack)
    monkeypatch.setattr(admission, "ENTRIES", 5)
    rng = random.Random(seed)
    kinds = ["create"] * 6 + ["pay", "cancel", "cancel", "unmark", "waive"]
    start = pd.Timestamp("2026-05-01")
    rows = [(s, start + pd.Timedelta(minutes=s // 3), rng.choice(kinds), f"e{rng.randrange(25)}") for s in range(1500)]
    log = pd.DataFrame(rows, columns=["seq", "ts", "kind", "email"]).assign(pool="equipe", capacity=9, paid=1, is_payer=False)
    hold = timedelta(minutes=30)
    desk = PoolDesk(9, 1, 0, int(hold.total_seconds() * 1_000_000))
    whole = replay_entries(desk, log.assign(n=range(1, len(log) + 1)))
    want = {r["seq"]: (r["action"], r["row_id"]) for r in whole[whole["seq"].notna()].to_dict("records")}
    norm = lambda d: {k: (a, None if pd.isna(i) else int(i)) for k, (a, i) in d.items()}
    parts = [log.iloc[i : i + 500].sample(frac=1, random_state=seed) for i in range(0, 1500, 500)]
    got, store, _ = _served(PoolAdmission(hold), parts, False)
    assert norm(got) == norm(want)
    mixed = [p.assign(t_us=p["ts"].astype("datetime64[us]").astype("int64")) for p in parts]
    got, *_ = _served(OrderedPoolAdmission(hold), mixed, True)
    assert norm(got) == norm(want)


def test_admission_calls_go_by_pages():
    rng = random.Random(3)
    start = pd.Timestamp("2026-05-01")
    rows = [(s, start + pd.Timedelta(seconds=s), rng.choice(["create", "create", "pay", "cancel"]), f"e{rng.randrange(3000)}") for s in range(20_000)]
    log = pd.DataFrame(rows, columns=["seq", "ts", "kind", "email"]).assign(pool="equipe", capacity=50, paid=0, is_payer=False)
    _, store, _ = _served(PoolAdmission(timedelta(minutes=30)), [log], False)
    # Two calls a page at most, some more for the rest; several a row before.
    assert store.calls < 3 * admission.MAIL_PAGES


def test_dedupe_calls_go_by_pages(monkeypatch):
    """A group of keys in runs gives what one step gives, null times last, and its calls do not grow with its keys."""
    rng = random.Random(9)
    rows = [(f"k{rng.randrange(900)}", rng.choice([NEVER, *[10**9 * i for i in range(1, 400)]]), i) for i in range(3000)]
    frame = pd.DataFrame(rows, columns=["key_json", INSTANT, "row_id"])
    found = []
    for run, piece in ((200_000, 10_000), (500, 60)):
        monkeypatch.setattr(reorder, "RUN_ROWS", run)
        monkeypatch.setattr(reorder, "PIECE_ROWS", piece)
        store, rule = Store(), KeepFirstOfHold(timedelta(minutes=60))
        rule.init(store)
        out = []
        for half in (frame[frame[INSTANT] < 2 * 10**11], frame[frame[INSTANT] >= 2 * 10**11]):
            out += list(rule.handleInputRows((0,), iter([half.iloc[i : i + 250] for i in range(0, len(half), 250)]), store))
        told = pd.concat(out).sort_values("row_id")
        found.append([(r, t, o, None if pd.isna(k) else int(k)) for r, t, o, k in zip(told["row_id"], told[INSTANT], told["outcome"], told["kept_id"], strict=True)])
        if run == 200_000:
            assert store.calls <= 2 * 2 * 16
    assert len(found[0]) == 3000 and found[0] == found[1]


def test_battle_calls_go_by_pages():
    n = 3000
    rows = pd.DataFrame({INSTANT: range(n), "id": range(n), "cell_id": [f"c{i % 1000}" for i in range(n)], "winner_email": "w", "winner_alliance": ["B", "A", "B"] * (n // 3),
                         "loser_alliance": ["A", "B", "A"] * (n // 3), "cell_alliance": "A", "cell_owner": "o", "undo_of": None, "loser_email": "l", "round": 1})
    store, rule = Store(), CellsInOrder(16)
    rule.init(store)
    out = pd.concat(feed(rule, store, (0,), rows, 10**9))
    owner, want = {}, []
    for cell, won, lost in zip(rows["cell_id"], rows["winner_alliance"], rows["loser_alliance"], strict=True):
        good = owner.get(cell, "A") == lost
        want.append("transfer" if good else "rejected")
        if good:
            owner[cell] = won
    assert out["outcome"].tolist() == want and store.calls < 200
