"""Duplicate clicks on a stream: the same rule as the batch operator, one anchor of state per key.

Without a ``delay`` every row is decided in its own micro-batch, so a row older than the last decision of its key cannot be placed any more. With
one, rows wait until the watermark has passed them, and files may come in any order within the delay.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from seatward.functions.dims import HOLD
from seatward.streaming.reorder import INSTANT, LAST, NEVER, BatchOrdered, Paged, TimeOrdered, from_bytes, from_micros, micros, to_bytes, with_instant

# Pages of a bucket's keys.
KEY_PAGES = 16


def _page(key_json: str) -> int:
    return zlib.crc32(key_json.encode("utf-8", "surrogatepass")) % KEY_PAGES


class KeepFirstOfHold(BatchOrdered):
    """The rule over many keys at once, micro-batch by micro-batch; per key the state has its anchor and the last instant decided."""

    def __init__(self, hold: timedelta):
        super().__init__([INSTANT, "row_id"])
        self.hold = int(hold.total_seconds() * 1_000_000)

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.keys = Paged(handle, "keys", _page)

    def begin(self, key) -> None:
        self.keys.load()

    def screen(self, key, frame: pd.DataFrame) -> tuple[pd.DataFrame | None, pd.DataFrame]:
        # Rows without a time come last.
        return None, frame.assign(**{INSTANT: frame[INSTANT].where(frame[INSTANT] != NEVER, LAST - 1)})

    def place(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        keys, hold = self.keys, self.hold
        outcome, holders = [], []
        instants = rows[INSTANT].where(rows[INSTANT] != LAST - 1, NEVER)
        for k, now, row_id in zip(rows["key_json"].tolist(), instants.tolist(), rows["row_id"].tolist(), strict=True):
            anchor, anchor_id, seen = keys.get(k) or (None, None, None)
            if seen is not None and now < seen:
                outcome.append("late")
                holders.append(None)
                continue
            if anchor is None or now >= anchor + hold:
                anchor, anchor_id = now, row_id
                outcome.append("kept")
            else:
                outcome.append("reused")
            keys.put(k, (anchor, anchor_id, now))
            holders.append(anchor_id)
        out = rows[["key_json", INSTANT, "row_id"]].copy()
        out[INSTANT], out["outcome"], out["kept_id"] = instants, outcome, pd.Series(holders, index=out.index, dtype="object")
        yield out

    def settle(self, key, now: int) -> Iterator[pd.DataFrame]:
        self.keys.save()
        return iter(())


class KeepFirstInOrder(TimeOrdered):
    """The rule over many keys at once: the keys of a bucket share one buffer and one table of anchors.

    An anchor whose hold the watermark has passed leaves the state, so that holds what came within delay and hold.
    """

    def __init__(self, hold: timedelta):
        super().__init__([INSTANT, "row_id"])
        self.hold = int(hold.total_seconds() * 1_000_000)

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("anchors", "rows binary")

    def begin(self, key) -> None:
        self.anchors: dict[str, tuple] = {}
        if self.state.exists():
            known = from_bytes(self.state.get()[0])
            self.anchors = dict(zip(known["key_json"].tolist(), zip(known["anchor"].tolist(), known["id"].tolist(), strict=True), strict=True))

    def place(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        anchors, hold = self.anchors, self.hold
        outcome, holders = [], []
        for k, now, row_id in zip(rows["key_json"].tolist(), rows[INSTANT].tolist(), rows["row_id"].tolist(), strict=True):
            anchor = anchors.get(k)
            if anchor is None or now >= anchor[0] + hold:
                anchors[k] = anchor = (now, row_id)
                outcome.append("kept")
            else:
                outcome.append("reused")
            holders.append(anchor[1])
        out = rows[["key_json", INSTANT, "row_id"]].copy()
        out["outcome"], out["kept_id"] = outcome, holders
        yield out

    def refuse(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        out = rows[["key_json", INSTANT, "row_id"]].copy()
        out["outcome"], out["kept_id"] = "late", None
        return out

    def settle(self, key, now: int) -> Iterator[pd.DataFrame]:
        self.anchors = {k: a for k, a in self.anchors.items() if a[0] + self.hold > now}
        if self.anchors:
            known = pd.DataFrame({"key_json": list(self.anchors), "anchor": [a for a, _ in self.anchors.values()], "id": [i for _, i in self.anchors.values()]})
            self.state.update((to_bytes(known),))
        else:
            self.state.clear()
        return iter(())

    def wake(self) -> int | None:
        return max(a for a, _ in self.anchors.values()) + self.hold if self.anchors else None


def stream_dedupe(
    requests: DataFrame,
    keys: Sequence[str] = ("email", "pool"),
    at: str = "created_at",
    id: str = "id",
    hold: timedelta = HOLD,
    delay: timedelta | None = None,
    buckets: int = 64,
) -> DataFrame:
    """Every row with ``outcome`` kept, reused or late, and the id of the row whose hold it falls under.

    Without ``delay``, rows are ordered inside a micro-batch. A row older than one already decided for its key cannot be placed any
    more and leaves as ``late``. State has one anchor a key, in ``buckets`` groups of keys; a group's rows of a micro-batch are sorted in runs, so that no
    task holds them whole.

    With ``delay``, a row is decided once the watermark, that far behind the latest row of earlier micro-batches, has passed it. Rows within the delay
    come out as in the batch operator whatever the order of files; later ones, and rows without a time, leave as ``late``. State
    holds the rows within the delay and the anchors within the hold, in ``buckets`` groups of keys read in pieces. Null keys are keys. Ids
    must not be null.
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    if delay is not None:
        return _dedupe_in_order(requests, keys, at, id, hold, delay, buckets, types)
    marked = _by_bucket(requests.select(*keys, at, id).withColumn(INSTANT, micros(F.col(at), types[at])), keys, id, buckets).transformWithStateInPandas(
        KeepFirstOfHold(hold), outputStructType=_MARKED.format(types[id]), outputMode="Append", timeMode="None"
    )
    return _with_keys(marked, keys, at, id, types).withColumn("kept_id", F.col("kept_id").cast("long"))


# Rows with their keys as JSON: keys of any types and nulls pass through Python unchanged.
_MARKED = f"key_json string, {INSTANT} long, row_id {{0}}, outcome string, kept_id {{0}}"


def _by_bucket(rows: DataFrame, keys: list[str], id: str, buckets: int):
    return rows.select(
        F.to_json(F.struct(*keys)).alias("key_json"), F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket"), INSTANT, F.col(id).alias("row_id")
    ).groupBy("bucket")


def _with_keys(marked: DataFrame, keys: list[str], at: str, id: str, types: dict) -> DataFrame:
    back = F.from_json("key_json", ", ".join(f"{k} {types[k]}" for k in keys))
    return marked.withColumn("key_json", back).select(
        *(F.col("key_json")[k].alias(k) for k in keys), from_micros(F.col(INSTANT), types[at]).alias(at), F.col("row_id").alias(id), "outcome", "kept_id"
    )


def _dedupe_in_order(requests: DataFrame, keys: list[str], at: str, id: str, hold: timedelta, delay: timedelta, buckets: int, types: dict) -> DataFrame:
    marked = _by_bucket(with_instant(requests.select(*keys, at, id), at, delay), keys, id, buckets).transformWithStateInPandas(
        KeepFirstInOrder(hold), outputStructType=_MARKED.format(types[id]), outputMode="Append", timeMode="EventTime"
    )
    return _with_keys(marked, keys, at, id, types)
