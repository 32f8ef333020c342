"""Hold expiry on a stream: a job at fixed instants cancels stale holds and promotes as many heads of the waitlist.

Per pool the state store has three lists, each in order of time and read from its front only: holds as they were made, holds by
promotion, and the waitlist. A timer stands at the next instant at which a front is stale. Rows come in any order within the delay, see ``reorder``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from seatward.functions.dims import HOLD, interval
from seatward.functions.text import EXPIRED_NOTE, append_note
from seatward.operators.stock import POOL
from seatward.streaming.reorder import INSTANT, Paged, TimeOrdered, from_bytes, from_micros, micros, to_bytes, with_instant

PERIOD = timedelta(minutes=10)
# Start of a row that is no hold once it is promoted: it was paid while it waited.
NO_HOLD = 1 << 62
# Entries of a piece of a list in state.
ENTRIES = 4096
# Neighbouring ids whose marks are one page of state.
MARKED = 4096


class Line:
    """A first-in-first-out list of (start, id) in state; a call reads pieces at the front and writes pieces at the end."""

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.meta = handle.getValueState(f"{name}_meta", "head long, tail long")
        self.pieces = handle.getMapState(f"{name}_pieces", "piece long", "rows binary")

    def load(self) -> None:
        self.head, self.tail = self.meta.get() if self.meta.exists() else (0, 0)
        self.stored = (self.head, self.tail)
        self.front: list[tuple[int, int]] = []  # the first piece, reversed
        self.new: list[tuple[int, int]] = []
        self.taken = 0

    def _read(self, piece: int) -> list[tuple[int, int]]:
        rows = from_bytes(self.pieces.getValue((piece,))[0])
        return list(zip(rows["start"].tolist(), rows["id"].tolist(), strict=True))

    def first(self) -> tuple[int, int] | None:
        if not self.front and self.head < self.tail:
            self.front = self._read(self.head)[::-1]
            self.pieces.removeKey((self.head,))
            self.head += 1
        if self.front:
            return self.front[-1]
        return self.new[self.taken] if self.taken < len(self.new) else None

    def pop(self) -> None:
        if self.front:
            self.front.pop()
        else:
            self.taken += 1

    def push(self, start: int, id: int) -> None:
        self.new.append((start, id))

    def save(self) -> None:
        if self.front:
            self.head -= 1
            self._write(self.head, self.front[::-1])
        new = self.new[self.taken :]
        if new and self.head < self.tail and len(new) < ENTRIES:
            # The last piece is filled up, so that small additions do not make small pieces.
            last = self._read(self.tail - 1)
            if len(last) + len(new) <= ENTRIES:
                new, self.tail = last + new, self.tail - 1
        for at in range(0, len(new), ENTRIES):
            self._write(self.tail, new[at : at + ENTRIES])
            self.tail += 1
        if (self.head, self.tail) != self.stored:
            self.meta.update((self.head, self.tail))

    def _write(self, piece: int, entries: list[tuple[int, int]]) -> None:
        rows = pd.DataFrame({"start": [s for s, _ in entries], "id": [i for _, i in entries]})
        self.pieces.updateValue((piece,), (to_bytes(rows),))


class ExpireAndPromote(TimeOrdered):
    def __init__(self, hold: timedelta, period: timedelta, promoted_anew: bool):
        super().__init__([INSTANT, "id"])
        self.hold, self.period = (int(x.total_seconds() * 1_000_000) for x in (hold, period))
        self.promoted_anew = promoted_anew

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.made, self.moved, self.queue = (Line(handle, name) for name in ("made", "moved", "queue"))
        # Rows whose entry in a list no longer counts, as cancelled ("c") or paid ("d"); rows promoted here ("p") or expired here ("x").
        self.marks = Paged(handle, "marks", lambda id: id // MARKED)
        # The last instant of the job, and the instant of the last row.
        self.clock = handle.getValueState("clock", "job long, row long")

    def begin(self, key) -> None:
        self.job, self.row = self.stored_clock = self.clock.get() if self.clock.exists() else (-NO_HOLD, -NO_HOLD)
        for x in (self.made, self.moved, self.queue, self.marks):
            x.load()

    def _first(self, line: Line, counts: str | None) -> tuple[int, int] | None:
        """The first entry that still counts; entries of rows cancelled or paid meanwhile go, and their marks."""
        while (entry := line.first()) is not None:
            mark = self.marks.get(entry[1])
            if mark in ("c", "d"):
                self.marks.remove(entry[1])
            elif mark == counts:
                return entry
            line.pop()
        return None

    def _next(self) -> int | None:
        """The next instant of the job at which a hold is stale: more than ``hold`` after its start, and after what was done."""
        starts = [e[0] for e in (self._first(self.made, None), self._first(self.moved, "p")) if e is not None]
        if not starts:
            return None
        stale = ((min(starts) + self.hold) // self.period + 1) * self.period
        return max(stale, self.job + self.period, -(-self.row // self.period) * self.period)

    def _promote(self, count: int, now: int, out: list) -> None:
        for _ in range(count):
            entry = self._first(self.queue, None)
            if entry is None:
                return
            self.queue.pop()
            self.marks.put(entry[1], "p")
            if entry[0] < NO_HOLD:
                self.moved.push(now if self.promoted_anew else entry[0], entry[1])
            out.append((entry[1], "promoted", now))

    def _run(self, now: int, out: list) -> None:
        """The job at one instant: all stale holds first, then as many promotions, as one statement does."""
        stale, self.job = 0, now
        for line, counts in ((self.made, None), (self.moved, "p")):
            while (entry := self._first(line, counts)) is not None and entry[0] < now - self.hold:
                line.pop()
                self.marks.put(entry[1], "x")
                out.append((entry[1], "expired", now))
                stale += 1
        self._promote(stale, now, out)

    def _runs_before(self, t: int, out: list) -> None:
        while (now := self._next()) is not None and now < t:
            self._run(now, out)

    def place(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        # A row that is closed from the start changes nothing: the job runs at the same instants without it.
        rows = rows[rows["open"] | rows["changed"]]
        columns = (rows[c].tolist() for c in (INSTANT, "id", "start", "is_waitlist", "open", "cancelled"))
        for t, id, start, waits, is_open, cancelled in zip(*columns, strict=True):
            self._runs_before(t, out)
            self.row = t
            if is_open:
                (self.queue if waits else self.made).push(start, id)
                continue
            mark = self.marks.get(id)
            if mark in ("x", "c"):
                continue
            self.marks.put(id, "c" if cancelled else "d")
            if cancelled and (not waits or mark == "p"):
                self._promote(1, t, out)
        if out:
            yield self._changes(out)

    def settle(self, key, now: int) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        self._runs_before(now, out)
        if out:
            yield self._changes(out)

    def _save(self) -> None:
        # The timer stands just past the instant, when the watermark has left no row up to it behind.
        self.due = self._next()
        for x in (self.made, self.moved, self.queue, self.marks):
            x.save()
        if (self.job, self.row) != tuple(self.stored_clock):
            self.clock.update((self.job, self.row))
        super()._save()

    def wake(self) -> int | None:
        return self.due

    def _changes(self, out: list) -> pd.DataFrame:
        return pd.DataFrame({"id": [o[0] for o in out], "action": [o[1] for o in out], INSTANT: [o[2] for o in out]}).astype(
            {"id": "int64", "action": "object", INSTANT: "int64"}
        )

    def refuse(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        return self._changes([(i, "late", t) for i, t in zip(rows["id"].tolist(), rows[INSTANT].tolist(), strict=True)])


def stream_expiry(
    requests: DataFrame,
    delay: timedelta,
    hold: timedelta = HOLD,
    period: timedelta = PERIOD,
    keys: Sequence[str] = POOL,
    at: str = "created_at",
    hold_from: str = "created_at",
) -> DataFrame:
    """Changes (keys, id, action, ``at``) that the job makes at multiples of ``period``: ``expired`` holds and ``promoted`` waitlist heads.

    A request row comes when it is made, and again at a later ``at`` with another status: paid and waived rows are no holds any more, a cancelled one that
    was not waiting promotes a head at once (one that was cancelled when it was made does not). A change comes once, and open rows come in the order of ``created_at``. At an instant the job sees what came up to it; holds strictly older than ``hold`` expire, as many heads are promoted,
    and promoted rows count from their creation, or from their promotion with ``hold_from="promoted_at"``. That is ``expire_holds`` applied
    at each instant. Rows after the watermark (``delay`` behind the latest) leave as ``late``. A pool goes on by its timer where no rows come.

    State grows with live holds, the waitlist, and one mark for each row that expired or was promoted.
    """
    keys = list(keys)
    kind = dict(requests.dtypes)[at]
    known = with_instant(requests, at, delay)
    pending = F.col("payment_status") == "pending"
    made = micros(F.col("created_at"), dict(requests.dtypes)["created_at"])
    start = F.when(pending, F.greatest(made, F.lit(-NO_HOLD))).otherwise(F.lit(NO_HOLD))
    rows = known.select(
        *keys, INSTANT, "id", start.alias("start"),
        F.coalesce("is_waitlist", F.lit(False)).alias("is_waitlist"),
        # Waiting rows of any live status are in the queue, as in the batch operators.
        F.coalesce(pending | (F.col("is_waitlist") & (F.col("payment_status") != "cancelled")), F.lit(False)).alias("open"),
        F.coalesce(F.col("payment_status") == "cancelled", F.lit(False)).alias("cancelled"),
        (F.col(INSTANT) != made).alias("changed"),
    )
    types = dict(requests.dtypes)
    # As JSON, keys of any types and nulls pass through Python unchanged.
    packed = rows.select(F.to_json(F.struct(*keys)).alias("key_json"), INSTANT, "id", "start", "is_waitlist", "open", "cancelled", "changed")
    out = packed.groupBy("key_json").transformWithStateInPandas(
        _Keyed(hold, period, hold_from == "promoted_at"),
        outputStructType=f"key_json string, id long, action string, {INSTANT} long",
        outputMode="Append",
        timeMode="EventTime",
    )
    out = out.withColumn("key_json", F.from_json("key_json", ", ".join(f"{k} {types[k]}" for k in keys)))
    return out.select(*(F.col("key_json")[k].alias(k) for k in keys), "id", "action", from_micros(F.col(INSTANT), kind).alias(at))


class _Keyed(ExpireAndPromote):
    """The changes with the key they belong to."""

    def _changes(self, out: list) -> pd.DataFrame:
        frame = super()._changes(out)
        frame.insert(0, "key_json", self.key)
        return frame

    def begin(self, key) -> None:
        self.key = key[0]
        super().begin(key)


def apply_changes(requests: DataFrame, changes: DataFrame, at: str = "created_at") -> DataFrame:
    """The snapshot after the changes: expired rows are cancelled with their note, promoted ones off the waitlist.

    A row's changes combine before the join, so it meets one row at most.
    """
    when = lambda action: F.max(F.when(F.col("action") == action, F.col(at)))
    per_row = changes.groupBy("id").agg(when("expired").alias("_expired"), when("promoted").alias("_promoted"))
    expired, promoted = F.col("_expired").isNotNull(), F.col("_promoted").isNotNull()
    return (
        requests.join(per_row, "id", "left")
        .withColumns(
            {
                "payment_status": F.when(expired, F.lit("cancelled")).otherwise(F.col("payment_status")),
                "cancelled_at": F.coalesce("_expired", "cancelled_at"),
                "admin_notes": F.when(expired, append_note(F.col("admin_notes"), F.lit(EXPIRED_NOTE))).otherwise(F.col("admin_notes")),
                "is_waitlist": F.when(promoted, F.lit(False)).otherwise(F.col("is_waitlist")),
                "promoted_at": F.coalesce("_promoted", "promoted_at"),
            }
        )
        .select(*requests.columns)
    )
