"""Admission on a stream: the batch replay's decisions, with the request rows in the state store.

Per pool the store holds the live rows as a stack per e-mail (commands take the newest live row), cut in pieces and kept in pages of many e-mails, the
waitlist as numbered entries, and the active holds. A step over entries reads and writes the pages it touches, once each.

Without a ``delay`` entries are served in the micro-batch they come in; with one they wait in the pool's buffer until the watermark has passed them. Either
way a pool's entries are sorted in runs and served in steps, so a task holds no micro-batch whole.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessorHandle

from seatward.functions.dims import HOLD
from seatward.operators.replay import STEP_SCHEMA, PoolDesk, prepare_log, replay_entries
from seatward.streaming.reorder import INSTANT, LAST, NEVER, BatchOrdered, Paged, TimeOrdered, with_instant

COLUMNS = [c.split()[0] for c in STEP_SCHEMA.split(", ")]
# A row in state; its e-mail is in its key.
FIELDS = ("n", "id", "created_at", "payment_status", "is_waitlist", "promoted_at", "paid_at", "cancelled_at", "is_payer")
# Rows of a piece of a stack, entries of a piece of the waitlist, pages of e-mails.
STACK, ENTRIES, MAIL_PAGES = 256, 4096, 2048


def _page(key: tuple) -> int:
    email, piece = key
    return zlib.crc32(f"{piece}:{email}".encode("utf-8", "surrogatepass")) % MAIL_PAGES


class PoolState:
    """The rows of a pool in the state store, and one step over entries in order."""

    hold: int

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.meta = handle.getValueState("meta", "n long, waiting long, head long, tail long, seen long")
        # (email, piece) -> rows, as bytes until a step needs them; (email, -1) -> height of the stack.
        self.stacks = Paged(handle, "stacks", _page)
        self.queue = handle.getMapState("queue", "piece long", "entries binary")
        self.active = handle.getValueState("active", "holds binary")

    def _piece(self, email: str, piece: int) -> list:
        at = (email, piece)
        if at not in self.opened:
            stored = self.stacks.get(at)
            self.opened[at] = [] if stored is None else pickle.loads(stored)
        return self.opened[at]

    def _depth(self, email: str) -> int:
        if email not in self.depths:
            self.depths[email] = self.stacks.get((email, -1)) or 0
        return self.depths[email]

    def _row(self, email: str, level: int) -> dict | None:
        """The row at a height of its e-mail's stack, from 1; with its height, by which it is written back."""
        rows, at = self._piece(email, (level - 1) // STACK), (level - 1) % STACK
        if at >= len(rows) or rows[at] is None:
            return None
        return dict(zip(FIELDS, rows[at], strict=True)) | {"email": email, "level": level}

    def _set(self, email: str, level: int, row: dict | None) -> None:
        at = (email, (level - 1) // STACK)
        rows = self._piece(*at)
        values = None if row is None else tuple(row[f] for f in FIELDS)
        if (level - 1) % STACK == len(rows):
            rows.append(values)
        else:
            rows[(level - 1) % STACK] = values
        self.dirty.add(at)

    def _trim(self, email: str) -> int:
        """Height of a stack after dropping rows cancelled meanwhile, which are always on top."""
        d = self._depth(email)
        while d > 0 and self._row(email, d) is None:
            self._piece(email, (d - 1) // STACK).pop()
            self.dirty.add((email, (d - 1) // STACK))
            d -= 1
        self.depths[email] = d
        return d

    def _known(self) -> tuple:
        return self.meta.get() if self.meta.exists() else (0, 0, 0, 0, None)

    def serve(self, log: pd.DataFrame) -> pd.DataFrame:
        """Decisions and changed rows for entries sorted by time and ``seq``, none older than those served before."""
        instants = log["ts"].astype("datetime64[us]").astype("int64")
        n, waiting, head, tail, _ = self._known()
        log = log.assign(n=range(n + 1, n + 1 + len(log)))
        start = int(instants.iloc[0])
        self.stacks.load()
        self.opened, self.dirty, self.depths = {}, set(), {}
        self.line, self.line_dirty = {}, set()
        holds = pickle.loads(bytes(self.active.get()[0])) if self.active.exists() else {}
        holds = {k: h for k, h in holds.items() if h[0] > start - self.hold}
        reach = {k: self._row(email, level) for k, (_, email, level) in holds.items()}
        commands = log[log["kind"] != "create"]
        cancels = (commands["kind"] == "cancel").groupby(commands["email"]).sum()
        for email, count in zip(cancels.index.tolist(), cancels.tolist(), strict=True):
            d = self._depth(email)
            for level in range(d, max(d - int(count) - 1, 0), -1):
                row = self._row(email, level)
                reach[row["n"]] = row
        head = self._heads(reach, head, tail, int((log["kind"] == "cancel").sum()))
        first = log.iloc[0]
        desk = PoolDesk(int(first["capacity"]), int(first["paid"]), waiting, self.hold, reach.values())
        out = replay_entries(desk, log)
        tail = self._store(desk, n, tail, int(instants.iloc[-1]), holds)
        self.meta.update((n + len(log), desk.waiting, head, tail, int(instants.iloc[-1])))
        return out[COLUMNS]

    def late(self, pool: str, seqs: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(index=range(len(seqs)), columns=COLUMNS)
        out["pool"], out["seq"], out["action"] = pool, seqs.tolist(), "late"
        return out

    def _entries(self, piece: int) -> list:
        if piece not in self.line:
            stored = self.queue.getValue((piece,))
            self.line[piece] = [] if stored is None else pickle.loads(bytes(stored[0]))
        return self.line[piece]

    def _heads(self, reach: dict[int, dict], head: int, tail: int, needed: int) -> int:
        """Add the first ``needed`` live queue entries; dead entries are blanked, and dropped in front of them."""
        pos, dead_front, before = head, True, head // ENTRIES
        while pos < tail and needed > 0:
            entries = self._entries(pos // ENTRIES)
            entry = entries[pos % ENTRIES]
            if entry is not None:
                n, email, level = entry
                row = self._row(email, level)
                if row is not None and row["n"] == n and row["is_waitlist"]:
                    reach[n] = row
                    needed -= 1
                    dead_front = False
                else:
                    entries[pos % ENTRIES] = None
                    self.line_dirty.add(pos // ENTRIES)
            pos += 1
            if dead_front:
                head = pos
        for piece in range(before, head // ENTRIES):
            self.queue.removeKey((piece,))
            self.line_dirty.discard(piece)
        return head

    def _store(self, desk: PoolDesk, before: int, tail: int, now: int, holds: dict[int, tuple]) -> int:
        """Write changed rows; rows up to number ``before`` are in the store already, and come before the new ones."""
        thinned = set()
        for n in sorted(desk.changed):
            row, new = desk.rows[n], n > before
            email, live = row["email"], row["payment_status"] != "cancelled"
            if new and not live:
                continue
            if new:
                row["level"] = self.depths[email] = self._trim(email) + 1
            self._set(email, row["level"], row if live else None)
            if not live:
                thinned.add(email)
            if new and row["is_waitlist"]:
                self._entries(tail // ENTRIES).append((n, email, row["level"]))
                self.line_dirty.add(tail // ENTRIES)
                tail += 1
            if row["payment_status"] == "pending" and not row["is_waitlist"] and row["created_at"] > now - self.hold:
                holds[n] = (row["created_at"], email, row["level"])
            else:
                holds.pop(n, None)
        for email in thinned:
            self._trim(email)
        for at in self.dirty:
            if self.opened[at]:
                self.stacks.put(at, pickle.dumps(self.opened[at], 5))
            else:
                self.stacks.remove(at)
            email = at[0]
            if self.depths.get(email):
                self.stacks.put((email, -1), self.depths[email])
            elif email in self.depths:
                self.stacks.remove((email, -1))
        self.stacks.save()
        for piece in self.line_dirty:
            self.queue.updateValue((piece,), (pickle.dumps(self.line[piece], 5),))
        self.active.update((pickle.dumps(holds, 5),))
        return tail


class PoolAdmission(PoolState, BatchOrdered):
    """Entries are served in the micro-batch they come in."""

    def __init__(self, hold: timedelta):
        BatchOrdered.__init__(self, [INSTANT, "seq"])
        self.hold = int(hold.total_seconds() * 1_000_000)

    def begin(self, key) -> None:
        self.seen = self._known()[4]

    def screen(self, key, frame: pd.DataFrame) -> tuple[pd.DataFrame | None, pd.DataFrame]:
        instants = frame["ts"].astype("datetime64[us]").astype("int64")
        # Entries without a time come last.
        frame = frame.assign(**{INSTANT: instants.where(frame["ts"].notna(), LAST - 1)})
        late = instants < (NEVER if self.seen is None else self.seen)
        return self.late(key[0], frame["seq"][late]) if late.any() else None, frame[~late]

    def place(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        yield self.serve(rows.drop(columns=INSTANT))


class OrderedPoolAdmission(PoolState, TimeOrdered):
    """Entries are served once the watermark has passed them."""

    def __init__(self, hold: timedelta):
        TimeOrdered.__init__(self, [INSTANT, "seq"])
        self.hold = int(hold.total_seconds() * 1_000_000)

    def place(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        yield self.serve(rows.drop(columns=INSTANT))

    def refuse(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        return self.late(key[0], rows["seq"])


def stream_admission(
    log: DataFrame, cap: DataFrame, payers: DataFrame, hold: timedelta = HOLD, delay: timedelta | None = None
) -> DataFrame:
    """Decisions and changed request rows for a stream of log entries (same columns as the batch step).

    Each pool is served in order. Without ``delay``, entries older than the pool's last decision leave with action ``late``. With it, an entry is served
    once the watermark, that far behind the latest entry of earlier micro-batches, has passed it: entries within the delay are decided as in the batch
    replay whatever the order of files, and later ones, like entries without a time, leave as ``late``. A pool's waiting entries are read in pieces.
    """
    known = prepare_log(log, cap, payers)
    if delay is None:
        processor, mode = PoolAdmission(hold), "None"
    else:
        known, processor, mode = with_instant(known, "ts", delay), OrderedPoolAdmission(hold), "EventTime"
    return known.groupBy("pool").transformWithStateInPandas(
        processor, outputStructType=STEP_SCHEMA, outputMode="Append", timeMode=mode
    )
