"""Waitlist order, positions, promotion and hold expiry as snapshot transforms."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatward.functions.dims import HOLD, interval
from seatward.functions.text import EXPIRED_NOTE, append_note
from seatward.operators.ordered import count_up_to, group_sizes, rank_rows
from seatward.operators.stock import POOL, active_holds, as_instant, hold_start, waiting


def waitlist_queue(
    requests: DataFrame, pool: str | None = None, keys: Sequence[str] = POOL, max_group_rows: int | None = None
) -> DataFrame:
    """First-in-first-out queue; ``queue_position`` breaks equal times by id. ``pool`` narrows it to one pool."""
    queue = waiting(requests)
    if pool is not None:
        queue = queue.filter(F.col(keys[-1]) == pool)
    ranked = rank_rows(queue, keys, ["created_at", "id"], "queue_position", max_group_rows)
    return ranked.withColumn("queue_position", F.col("queue_position").cast("int"))


def waitlist_position(
    requests: DataFrame, keys: Sequence[str] = POOL, max_group_rows: int | None = None
) -> DataFrame:
    """Position told to the applicant: live entries not later than their own, so equal times share one."""
    told = count_up_to(waiting(requests), keys, "created_at", "waitlist_position", max_group_rows)
    return told.withColumn("waitlist_position", F.col("waitlist_position").cast("int"))


def latest_hold(requests: DataFrame, as_of, hold: timedelta = HOLD, keys: Sequence[str] = POOL) -> DataFrame:
    """The hold a repeated click would reuse: the newest active one per (e-mail, pool)."""
    return (
        active_holds(requests, as_of, hold)
        .groupBy(F.lower(F.col("email")).alias("email"), *keys)
        .agg(F.max_by(F.struct("id", "created_at"), F.struct("created_at", "id")).alias("_h"))
        .select("email", *keys, F.col("_h.id").alias("id"), F.col("_h.created_at").alias("created_at"))
    )


def _promote(
    requests: DataFrame, freed: DataFrame, as_of: Column, keys: Sequence[str], max_group_rows: int | None
) -> DataFrame:
    """Give each pool's first ``_freed`` live waitlist rows a place. ``freed`` holds one row per pool.

    Pools that freed nothing leave before the ranking; the whole waitlist bounds its groups.
    """
    line = waiting(requests).select(*keys, "id", "created_at")
    concerned = line.join(freed.select(*keys), list(keys), "left_semi")
    sizes = group_sizes(line, keys)
    ranked = rank_rows(concerned, keys, ["created_at", "id"], "_rank", max_group_rows, sizes)
    heads = ranked.join(freed, list(keys)).filter("_rank <= _freed").select("id", F.lit(True).alias("_head"))
    return (
        requests.join(heads, "id", "left")
        .withColumns(
            {
                "is_waitlist": F.when(F.col("_head"), F.lit(False)).otherwise(F.col("is_waitlist")),
                "promoted_at": F.when(F.col("_head"), as_of).otherwise(F.col("promoted_at")),
            }
        )
        .select(*requests.columns)
    )


def _freed_places(cancelled_now: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cancelled_now.groupBy(*keys).agg(F.count(F.lit(1)).alias("_freed"))


def promote_batch(
    requests: DataFrame,
    cancelled_ids: DataFrame,
    as_of: datetime | Column,
    keys: Sequence[str] = POOL,
    max_group_rows: int | None = None,
) -> DataFrame:
    """Cancel a batch of rows and promote one waitlist head per place they held.

    Only rows that were live and not waitlisted free a place. All cancellations apply first, as in one statement,
    so a waitlist row cancelled in the same batch is not promoted. Capacity is not consulted.
    """
    at = as_instant(as_of)
    hit = requests.join(cancelled_ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    newly = F.col("_hit") & (F.col("payment_status") != "cancelled")
    freed = _freed_places(hit.filter(newly & ~F.col("is_waitlist")), keys)
    after = hit.withColumns(
        {
            "payment_status": F.when(F.col("_hit"), F.lit("cancelled")).otherwise(F.col("payment_status")),
            "cancelled_at": F.when(F.col("_hit"), at).otherwise(F.col("cancelled_at")),
        }
    ).select(*requests.columns)
    return _promote(after, freed, at, keys, max_group_rows)


def promote_entries(requests: DataFrame, ids: DataFrame, as_of: datetime | Column) -> tuple[DataFrame, DataFrame]:
    """Promote chosen entries. Returns (snapshot, ids that name no live waitlist row)."""
    at = as_instant(as_of)
    wanted = ids.select("id").distinct()
    ok = F.coalesce(F.col("_hit") & F.col("is_waitlist") & (F.col("payment_status") != "cancelled"), F.lit(False))
    snapshot = (
        requests.join(wanted.withColumn("_hit", F.lit(True)), "id", "left")
        .withColumn("_ok", ok)
        .withColumns(
            {
                "is_waitlist": F.when(F.col("_ok"), F.lit(False)).otherwise(F.col("is_waitlist")),
                "promoted_at": F.when(F.col("_ok"), at).otherwise(F.col("promoted_at")),
            }
        )
        .select(*requests.columns)
    )
    return snapshot, wanted.join(waiting(requests).select("id"), "id", "left_anti")


def expire_holds(
    requests: DataFrame,
    as_of: datetime | Column,
    hold: timedelta = HOLD,
    keys: Sequence[str] = POOL,
    hold_from: str = "created_at",
    max_group_rows: int | None = None,
) -> DataFrame:
    """Cancel holds strictly older than the hold, note why, and promote as many heads per pool."""
    at = as_instant(as_of)
    stale = (
        (F.col("payment_status") == "pending") & ~F.col("is_waitlist") & (hold_start(hold_from) < at - interval(hold))
    )
    freed = _freed_places(requests.filter(stale), keys)
    marked = requests.withColumn("_stale", F.coalesce(stale, F.lit(False)))
    after = marked.withColumns(
        {
            "payment_status": F.when(F.col("_stale"), F.lit("cancelled")).otherwise(F.col("payment_status")),
            "cancelled_at": F.when(F.col("_stale"), at).otherwise(F.col("cancelled_at")),
            "admin_notes": F.when(F.col("_stale"), append_note(F.col("admin_notes"), F.lit(EXPIRED_NOTE))).otherwise(
                F.col("admin_notes")
            ),
        }
    ).select(*requests.columns)
    return _promote(after, freed, at, keys, max_group_rows)
