"""The battle log on a stream: cells change hands in time order, and the last battle of a cell can be undone.

Per cell the state store has the alliance and owner of now, and a stack of the images before its last transfers. Battles come in any order within the
delay, see ``reorder``; cells share buffers by bucket, and a micro-batch reads and writes the pages of cells it touches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from seatward.operators.territory import SAME_ALLIANCE_NOTE, judge_battles
from seatward.streaming.reorder import INSTANT, Paged, TimeOrdered, from_micros, with_instant

# Transfers of a cell that can be undone one after the other.
DEPTH = 16
PLAIN = ["id", "ts", "winner_email", "loser_email", "round", "winner_alliance"]
DECIDED = "outcome string, reason string, cell_transferred_id string, prev_alliance string, prev_owner_email string, now_alliance string, now_owner_email string"


# Pages of a bucket's cells.
CELL_PAGES = 64


def _page(cell: str) -> int:
    return zlib.crc32(cell.encode("utf-8", "surrogatepass")) % CELL_PAGES


class CellsInOrder(TimeOrdered):
    def __init__(self, depth: int):
        super().__init__([INSTANT, "id"])
        self.depth = depth

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.cells = Paged(handle, "cells", _page)

    def begin(self, key) -> None:
        self.cells.load()
        self.held: dict[str, list] = {}

    def _cell(self, cell: str, alliance: str, owner: str) -> list:
        """(alliance, owner, stack of (battle, alliance before, owner before)) of a cell; the given ones where nothing happened to it yet."""
        if cell not in self.held:
            self.held[cell] = self.cells.get(cell) or [alliance, owner, []]
        return self.held[cell]

    def place(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        out = []
        names = ("id", "cell_id", "winner_email", "winner_alliance", "loser_alliance", "cell_alliance", "cell_owner", "undo_of")
        for id, cell, winner, alliance, loser, first_alliance, first_owner, undo_of in zip(*(rows[c].tolist() for c in names), strict=True):
            state = self._cell(cell, first_alliance, first_owner)
            before, owner, stack = state
            if undo_of is not None:
                if stack and stack[-1][0] == int(undo_of):
                    _, state[0], state[1] = stack.pop()
                    out.append(("undone", None, cell, before, owner, state[0], state[1]))
                else:
                    out.append(("unmatched", "not_the_last_of_its_cell", None, None, None, None, None))
            elif before == loser:
                state[0], state[1] = alliance, winner
                stack.append((id, before, owner))
                del stack[: -self.depth]
                out.append(("transfer", None, cell, before, owner, alliance, winner))
            else:
                out.append(("rejected", "cell_not_of_loser_alliance", None, None, None, None, None))
        yield self._told(rows, out)

    def refuse(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        return self._told(rows, [("late", None, None, None, None, None, None)] * len(rows))

    def _told(self, rows: pd.DataFrame, out: list[tuple]) -> pd.DataFrame:
        plain = rows[["id", INSTANT, "winner_email", "loser_email", "round", "winner_alliance"]].reset_index(drop=True)
        names = [c.split()[0] for c in DECIDED.split(", ")]
        return pd.concat([plain, pd.DataFrame(out, columns=names, dtype="object")], axis=1)

    def settle(self, key, now: int) -> Iterator[pd.DataFrame]:
        for cell, state in self.held.items():
            self.cells.put(cell, state)
        self.cells.save()
        return iter(())


def stream_battles(
    battles: DataFrame, champions: DataFrame, cells: DataFrame, dim: DataFrame, delay: timedelta, buckets: int = 64, depth: int = DEPTH
) -> DataFrame:
    """The decided log of ``replay_battles`` for a stream of battles, with the alliance and owner of the cell after it.

    A battle whose cell decides comes out once the watermark, ``delay`` behind the latest, has passed it; the others at once. A battle after the watermark is
    ``late``. A log with a column ``undo_of`` may hold undo entries: they name the cell and the last transfer of it, the cell goes
    back to its image before, and the entry comes out as ``undone`` with what the cell has now; ``unmatched`` where that battle is not the cell's last
    transfer. ``depth`` transfers a cell can be undone.
    """
    kind = dict(battles.dtypes)["ts"]
    if "undo_of" not in battles.columns:
        battles = battles.withColumn("undo_of", F.lit(None).cast("long"))
    judged = judge_battles(with_instant(battles, "ts", delay), champions, cells, dim)
    undo = F.col("undo_of").isNotNull() & F.col("_cell_alliance").isNotNull()
    # Rows without an id are no battles: an end of the input goes on, for its time.
    ordered = judged.filter(F.col("_contest") | undo | F.col("id").isNull())
    waiting = ordered.select(
        F.pmod(F.xxhash64("cell_id"), F.lit(buckets)).alias("bucket"), INSTANT, "id", "cell_id", "winner_email", "loser_email",
        F.coalesce("round", F.lit(0)).alias("round"), "winner_alliance", "loser_alliance", F.col("_cell_alliance").alias("cell_alliance"),
        F.col("_cell_owner").alias("cell_owner"), F.col("undo_of").cast("string").alias("undo_of"),
    ).withColumn("id", F.coalesce("id", F.lit(-1)))
    decided = waiting.groupBy("bucket").transformWithStateInPandas(
        CellsInOrder(depth),
        outputStructType=f"id long, {INSTANT} long, winner_email string, loser_email string, round int, winner_alliance string, {DECIDED}",
        outputMode="Append",
        timeMode="EventTime",
    )
    no_text = F.lit(None).cast("string")
    contested = decided.withColumn("ts", from_micros(F.col(INSTANT), kind)).withColumn("notes", no_text)
    ally = F.col("reason").isNull()
    others = judged.filter(~F.col("_contest") & ~undo & F.col("id").isNotNull()).select(
        *PLAIN, F.when(ally, "same_alliance").otherwise("rejected").alias("outcome"), "reason",
        *(no_text.alias(c) for c in ("cell_transferred_id", "prev_alliance", "prev_owner_email", "now_alliance", "now_owner_email")),
        F.when(ally, F.lit(SAME_ALLIANCE_NOTE)).alias("notes"),
    )
    return contested.select(others.columns).unionByName(others)


def cells_of_stream(cells: DataFrame, log: DataFrame) -> DataFrame:
    """Cells with what their last transfer or undo left."""
    last = (
        log.filter(F.col("now_alliance").isNotNull())
        .groupBy(F.col("cell_transferred_id").alias("id"))
        .agg(F.max_by(F.struct("now_alliance", "now_owner_email"), F.struct("ts", F.col("id"))).alias("_now"))
    )
    return cells.join(last, "id", "left").withColumns({
        "current_alliance": F.coalesce("_now.now_alliance", "current_alliance"),
        "current_owner_email": F.coalesce("_now.now_owner_email", "current_owner_email"),
    }).select(*cells.columns)
