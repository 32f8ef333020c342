"""Rows of a stream in event-time order: a buffer in state that the watermark lets go of.

Files arrive in any order. A row waits in its key's buffer until the watermark has passed it, that is until no row before it
can come any more within the given delay; then the key's rows are handed on in order. A row that the watermark has passed already when it
comes is too late to be placed and leaves at once. The buffer is sorted runs in small pieces (Arrow bytes, one state call each), with their first and
last instants in an index, so that runs that overlap in time are merged piece by piece. One timer a key stands at the earliest of what waits.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Rows that are sorted at a time, and handed on at least where as many are due.
RUN_ROWS = 200_000
# Rows of a piece of the buffer, a stretch of such a run. In memory at a time are a run's rows and a piece of each run they overlap with.
PIECE_ROWS = 10_000
# Names with a leading underscore do not reach a processor as they are.
INSTANT = "t_us"
# Instant of a row without one: before any watermark.
NEVER = -(1 << 63)
# After all instants.
LAST = (1 << 63) - 1


def to_bytes(frame: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_bytes(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_pandas()


# Pages of a dictionary in memory at a time.
PAGES = 4096


class Paged:
    """A dictionary in state, cut in pages: a call reads and writes the pages it touches, one state call each way, whatever the entries in them."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, page_of: Callable[..., int]):
        self.state = handle.getMapState(name, "page long", "entries binary")
        self.page_of = page_of

    def load(self) -> None:
        self.pages: dict[int, dict] = {}
        self.changed: set[int] = set()

    def _page(self, key) -> tuple[int, dict]:
        at = self.page_of(key)
        if at not in self.pages:
            if len(self.pages) >= PAGES:
                self.save()
            stored = self.state.getValue((at,))
            self.pages[at] = {} if stored is None else pickle.loads(bytes(stored[0]))
        return at, self.pages[at]

    def get(self, key):
        return self._page(key)[1].get(key)

    def put(self, key, value) -> None:
        at, page = self._page(key)
        page[key] = value
        self.changed.add(at)

    def remove(self, key) -> None:
        at, page = self._page(key)
        if page.pop(key, None) is not None:
            self.changed.add(at)

    def save(self) -> None:
        for at in self.changed:
            if self.pages[at]:
                self.state.updateValue((at,), (pickle.dumps(self.pages[at], 5),))
            else:
                self.state.removeKey((at,))
        self.load()


class TimeOrdered(StatefulProcessor):
    """Hands the rows of a key to ``place`` in the order of ``order``, whose first column is the instant in microseconds."""

    def __init__(self, order: list[str]):
        self.order = order

    def open(self, handle: StatefulProcessorHandle) -> None:
        """State of the rule itself."""

    def begin(self, key) -> None:
        """Before the due rows of a key."""

    def place(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Due rows, sorted; all rows of an instant are in one call."""
        raise NotImplementedError

    def refuse(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        """Rows that came after the watermark, or without an instant."""
        raise NotImplementedError

    def settle(self, key, now: int) -> Iterator[pd.DataFrame]:
        """After the due rows: what else falls due before ``now`` (microseconds), and writing state."""
        return iter(())

    def wake(self) -> int | None:
        """The instant after which ``settle`` has something to do again without new rows."""
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.index = handle.getValueState("index", "next long, timer long, piece array<long>, low array<long>, high array<long>")
        self.pieces = handle.getMapState("pieces", "piece long", "rows binary")
        self.open(handle)

    def _load(self) -> None:
        number, timer, *lists = self.index.get() if self.index.exists() else (0, None, [], [], [])
        self.number, self.timer = number, timer
        self.waiting = sorted(zip(*lists[1:], lists[0], strict=True))  # low, high, piece

    def _save(self) -> None:
        firsts = [low for low, _, _ in self.waiting] + [w for w in (self.wake(),) if w is not None]
        timer = min(firsts) // 1000 + 1 if firsts else None
        if timer != self.timer:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            if timer is not None:
                self.handle.registerTimer(timer)
        if timer is None:
            self.index.clear()
            return
        low, high, piece = ([x[i] for x in self.waiting] for i in range(3))
        self.index.update((self.number, timer, piece, low, high))

    def _keep(self, frames: list[pd.DataFrame]) -> None:
        rows = pd.concat(frames, ignore_index=True).sort_values(self.order, ignore_index=True)
        for at in range(0, len(rows), PIECE_ROWS):
            piece = rows.iloc[at : at + PIECE_ROWS]
            self.pieces.updateValue((self.number,), (to_bytes(piece),))
            self.waiting.append((int(piece[INSTANT].iloc[0]), int(piece[INSTANT].iloc[-1]), self.number))
            self.number += 1
        self.waiting.sort()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        self._load()
        self.begin(key)
        held, n = [], 0
        for frame in rows:
            late = (frame[INSTANT] == NEVER) | ((frame[INSTANT] < mark) & (mark > 0))
            if late.any():
                yield self.refuse(key, frame[late])
                frame = frame[~late]
            if len(frame):
                held.append(frame)
                n += len(frame)
            if n >= RUN_ROWS:
                self._keep(held)
                held, n = [], 0
        if n:
            self._keep(held)
        self._save()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        self._load()
        self.timer = None
        self.begin(key)
        for rows in self._due(mark):
            yield from self.place(key, rows)
        yield from self.settle(key, mark)
        self._save()

    def _due(self, mark: int) -> Iterator[pd.DataFrame]:
        """Waiting rows before ``mark`` in order. Pieces are taken by their first instants; what may meet later pieces is carried on."""
        todo = [x for x in self.waiting if x[0] < mark]
        self.waiting = [x for x in self.waiting if x[0] >= mark]
        carried: list[pd.DataFrame] = []
        while todo:
            n = 0
            while todo and n < RUN_ROWS:
                piece = (todo.pop(0)[2],)
                carried.append(from_bytes(self.pieces.getValue(piece)[0]))
                self.pieces.removeKey(piece)
                n += len(carried[-1])
            edge = min(mark, todo[0][0]) if todo else mark
            rows = pd.concat(carried, ignore_index=True).sort_values(self.order, ignore_index=True)
            due = int(rows[INSTANT].searchsorted(edge))
            if due:
                yield rows.iloc[:due]
            carried = [rows.iloc[due:]]
        if carried and len(carried[0]):
            self._keep(carried)

    def close(self) -> None:
        pass


class BatchOrdered(TimeOrdered):
    """Hands over the rows of a key in order within each micro-batch. More than a run of them pass through the buffer, which is empty again at the end."""

    def screen(self, key, frame: pd.DataFrame) -> tuple[pd.DataFrame | None, pd.DataFrame]:
        """(answers to rows that cannot be placed any more, the other rows)."""
        return None, frame

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.number, self.waiting = 0, []
        self.begin(key)
        held, n = [], 0
        for frame in rows:
            refused, frame = self.screen(key, frame)
            if refused is not None:
                yield refused
            if len(frame):
                held.append(frame)
                n += len(frame)
            if n >= RUN_ROWS:
                self._keep(held)
                held, n = [], 0
        if n and not self.waiting:
            yield from self.place(key, pd.concat(held).sort_values(self.order, ignore_index=True))
        else:
            if n:
                self._keep(held)
            held = []
            for due in self._due(LAST):
                yield from self.place(key, due)
        yield from self.settle(key, LAST)


def micros(at: Column, kind: str) -> Column:
    """Microseconds since 1970 of a timestamp, with or without zone; ``NEVER`` for null."""
    value = F.unix_micros(at) if kind == "timestamp" else F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    if kind != "timestamp":
        value = F.timestamp_diff("MICROSECOND", value, at)
    return F.coalesce(value, F.lit(NEVER))


def from_micros(t: Column, kind: str) -> Column:
    known = F.when(t != NEVER, t)
    if kind == "timestamp":
        return F.timestamp_micros(known)
    return F.timestamp_add("MICROSECOND", known, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def with_instant(stream: DataFrame, at: str, delay: timedelta) -> DataFrame:
    """The stream with ``t_us``, the instant of ``at`` in microseconds, and a watermark ``delay`` behind the latest one.

    The watermark stands on a column of its own that leaves again: rows behind it reach the operator, which reports them.
    """
    kind = dict(stream.dtypes)[at]
    t = micros(F.col(at), kind)
    marked = stream.withColumn(INSTANT, t).withColumn("_mark", F.timestamp_micros(F.greatest(F.col(INSTANT), F.lit(0))))
    return marked.withWatermark("_mark", f"{int(delay.total_seconds() * 1_000_000)} microseconds").drop("_mark")
