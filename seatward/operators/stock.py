"""Remaining stock per pool, the holds behind it, revenue and summaries.

Pool keys are any column list: pass ``keys=("event", "pool")`` and a capacity table with the same columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatward.functions.dims import HOLD, interval
from seatward.operators.ordered import running_sum

POOL = ("pool",)


def live(df: DataFrame) -> DataFrame:
    return df.filter(F.col("payment_status") != "cancelled")


def in_pools(df: DataFrame, cap: DataFrame, keys: Sequence[str] = POOL) -> DataFrame:
    """Rows whose pool is in the capacity table: drops unknown pools and null."""
    return df.join(cap.select(*keys), list(keys), "left_semi")


def as_instant(as_of: datetime | Column) -> Column:
    """A given instant as written, whatever time zone the driver is in."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def hold_start(hold_from: str = "created_at") -> Column:
    """Instant a hold counts from. By default a promoted row keeps its first date."""
    if hold_from == "promoted_at":
        return F.coalesce(F.col("promoted_at"), F.col("created_at"))
    return F.col(hold_from)


def is_active_hold(as_of: datetime | Column, hold: timedelta = HOLD, hold_from: str = "created_at") -> Column:
    """Strictly younger than the hold: a row exactly at the limit no longer counts."""
    return (
        ~F.col("is_waitlist")
        & (F.col("payment_status") == "pending")
        & (hold_start(hold_from) > as_instant(as_of) - interval(hold))
    )


def active_holds(requests: DataFrame, as_of, hold: timedelta = HOLD, hold_from: str = "created_at") -> DataFrame:
    return requests.filter(is_active_hold(as_of, hold, hold_from))


def occupied(requests: DataFrame, as_of, hold: timedelta = HOLD) -> DataFrame:
    """Older policy: paid or waived for good, or pending and recent."""
    recent = (F.col("payment_status") == "pending") & (F.col("created_at") > as_instant(as_of) - interval(hold))
    return requests.filter(~F.col("is_waitlist") & (F.col("payment_status").isin("paid", "waived") | recent))


def waiting(requests: DataFrame) -> DataFrame:
    return live(requests).filter("is_waitlist")


def count_by(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias(out))


def unpaid_holds(holds: DataFrame, payers: DataFrame) -> DataFrame:
    """Holds whose e-mail is in no payer row, whatever the pool of either."""
    # Compared in lower case, blanks included: a padded payer address is another one.
    paid = payers.select(F.lower(F.col("email")).alias("_payer"))
    return holds.join(paid, F.lower(F.col("email")) == F.col("_payer"), "left_anti")


def unpaid_hold_counts(holds: DataFrame, payers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of ``unpaid_holds`` per pool.

    Counted per e-mail before the join, so a busy address is one row there. An anti join would be pushed below that
    count; a left join whose matches are dropped is not.
    """
    per_email = holds.groupBy(*keys, F.lower(F.col("email")).alias("_mail")).agg(F.count(F.lit(1)).alias("_n"))
    paid = payers.select(F.lower(F.col("email")).alias("_payer"))
    unpaid = per_email.join(paid, F.col("_mail") == F.col("_payer"), "left").filter(F.col("_payer").isNull())
    return unpaid.groupBy(*keys).agg(F.sum("_n").cast("int").alias("_held"))


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("int")


def stock(
    cap: DataFrame,
    payers: DataFrame | None,
    requests: DataFrame | None,
    as_of: datetime | Column | None = None,
    hold: timedelta = HOLD,
    policy: str = "final",
    keys: Sequence[str] = POOL,
    hold_from: str = "created_at",
) -> DataFrame:
    """Capacity, taken, remaining and waitlist count per pool.

    ``policy``: ``final`` payers + active unpaid holds (clamped at 0); ``payers`` payers only; ``live`` requests
    not cancelled; ``status`` paid, waived or recent requests (clamped at 0). The first three differ in result and
    were each in force once. Both sides are aggregated before the join, so the capacity table meets at most one
    row per pool.
    """
    keys = list(keys)
    result = cap
    taken = F.lit(0)
    if policy in ("final", "payers"):
        # Pools outside the capacity table fall away in the left join; null never matches.
        paid = count_by(payers.dropna(subset=keys), keys, "_paid")
        result = result.join(paid, keys, "left")
        taken = taken + _zero("_paid")
    if policy == "final":
        held = unpaid_hold_counts(active_holds(requests, as_of, hold, hold_from), payers, keys)
        result = result.join(held, keys, "left")
        taken = taken + _zero("_held")
    elif policy == "live":
        result = result.join(count_by(live(requests).filter(~F.col("is_waitlist")), keys, "_live"), keys, "left")
        taken = taken + _zero("_live")
    elif policy == "status":
        result = result.join(count_by(occupied(requests, as_of, hold), keys, "_occ"), keys, "left")
        taken = taken + _zero("_occ")
    elif policy != "payers":
        raise ValueError(f"unknown policy {policy}")
    left = F.col("capacity") - taken
    if policy in ("final", "status"):
        left = F.greatest(left, F.lit(0))
    out = [*keys, "capacity", taken.cast("int").alias("taken"), left.cast("int").alias("remaining")]
    if policy != "payers":
        result = result.join(count_by(waiting(requests), keys, "_wait"), keys, "left")
        out.append(_zero("_wait").alias("waitlist_count"))
    if "ord" in cap.columns:
        out.append("ord")
    return result.select(*out)


def simple_stock(cap: DataFrame, reservations: DataFrame, key: str = "room_type") -> DataFrame:
    """Room stock. ``remaining`` is not clamped: overbooking shows as a negative number."""
    taken = count_by(live(reservations), [key], "_taken")
    extra = ["ord"] if "ord" in cap.columns else []
    return cap.join(taken, key, "left").select(
        key,
        "capacity",
        _zero("_taken").alias("taken"),
        (F.col("capacity") - _zero("_taken")).cast("int").alias("remaining"),
        *extra,
    )


def stock_state(stock_df: DataFrame, tight: int = 3) -> DataFrame:
    """full / tight / open label and the place a new waitlist entry would get."""
    left = F.col("remaining")
    label = F.when(left <= 0, "full").when(left <= tight, "tight").otherwise("open")
    df = stock_df.withColumn("state", label)
    if "waitlist_count" in stock_df.columns:
        df = df.withColumn("next_position", F.when(left <= 0, F.col("waitlist_count") + 1).cast("int"))
    return df


def revenue(payers: DataFrame, pool: str = "pool") -> DataFrame:
    """Count and amount per pool; null is its own group, apart from a pool named ``autre``."""
    return payers.groupBy(F.coalesce(F.col(pool), F.lit("(autre)")).alias(pool)).agg(
        F.count(F.lit(1)).cast("int").alias("nb"),
        F.coalesce(F.sum("montant_eur"), F.lit(0)).cast("decimal(18,2)").alias("total_eur"),
    )


def with_grand_total(revenue_df: DataFrame) -> DataFrame:
    """The total as a scalar subquery, run once."""
    total = revenue_df.agg(F.sum("total_eur").cast("decimal(18,2)").alias("grand_total")).scalar()
    return revenue_df.withColumn("grand_total", total)


def status_summary(requests: DataFrame, keys: Sequence[str] = POOL) -> DataFrame:
    return requests.groupBy(*keys, "payment_status").agg(
        F.count(F.lit(1)).cast("int").alias("nb"), F.sum("amount_eur").cast("decimal(18,2)").alias("total_eur")
    )


def captains(requests: DataFrame) -> DataFrame:
    """Team registrations by a captain, who then invites the team mates."""
    return requests.filter((F.col("pool") == "equipe") & (F.col("role") == "capitaine"))


def holds_timeline(
    requests: DataFrame,
    instants: DataFrame,
    hold: timedelta = HOLD,
    payers: DataFrame | None = None,
    keys: Sequence[str] = POOL,
    max_group_rows: int | None = None,
) -> DataFrame:
    """Holds active at each (pool, ``instant``) of ``instants``, from one running sum.

    A hold adds one at its start and takes it back when it expires. Steps are summed per (pool, instant) before
    the sort. At one instant the steps come before the reading, so a hold that ends just then is out.
    """
    keys = list(keys)
    holds = requests.filter(~F.col("is_waitlist") & (F.col("payment_status") == "pending"))
    if payers is not None:
        holds = unpaid_holds(holds, payers)
    starts = holds.select(*keys, F.col("created_at").alias("instant"), F.lit(1).alias("_d"))
    ends = holds.select(*keys, (F.col("created_at") + interval(hold)).alias("instant"), F.lit(-1).alias("_d"))
    steps = starts.unionByName(ends).groupBy(*keys, "instant").agg(F.sum("_d").alias("_d")).withColumn("_read", F.lit(0))
    reads = instants.select(*keys, "instant").distinct().select("*", F.lit(0).alias("_d"), F.lit(1).alias("_read"))
    line = running_sum(steps.unionByName(reads), keys, ["instant", "_read"], "_d", "active_holds", max_group_rows)
    return line.filter("_read = 1").select(*keys, "instant", F.col("active_holds").cast("int"))


def stock_timeline(
    cap: DataFrame, payers: DataFrame, requests: DataFrame, instants: DataFrame, hold: timedelta = HOLD, **kw
) -> DataFrame:
    """Final stock at many instants with the payer list held fixed."""
    keys = list(kw.get("keys", POOL))
    held = holds_timeline(requests, instants, hold, payers, **kw)
    fixed = cap.join(count_by(payers.dropna(subset=keys), keys, "_paid"), keys, "left")
    taken = _zero("_paid") + F.col("active_holds")
    return held.join(fixed, keys).select(
        *keys,
        "instant",
        taken.cast("int").alias("taken"),
        F.greatest(F.col("capacity") - taken, F.lit(0)).cast("int").alias("remaining"),
    )


def stock_history(
    cap: DataFrame,
    payers: DataFrame,
    requests: DataFrame,
    instants: DataFrame,
    hold: timedelta = HOLD,
    keys: Sequence[str] = POOL,
    imported_at: str = "imported_at",
    max_group_rows: int | None = None,
) -> DataFrame:
    """Final stock at many instants, with the payers that were there at each: a payer counts from ``imported_at`` on.

    From the first import of its e-mail (in whatever pool) a hold counts no more, so its interval ends there or at its expiry. Three kinds of steps, payers
    coming, holds starting and holds ending, are summed per (pool, instant) and swept once. At one instant the steps come before the reading. A payer
    without a time was there all along.
    """
    keys = list(keys)
    mails = payers.groupBy(F.lower(F.col("email")).alias("_mail")).agg(
        F.when(F.count_if(F.col(imported_at).isNull()) > 0, F.lit(None)).otherwise(F.min(imported_at)).alias("_paid_at"), F.lit(True).alias("_known")
    )
    holds = requests.filter(~F.col("is_waitlist") & (F.col("payment_status") == "pending"))
    holds = holds.select(*keys, F.lower(F.col("email")).alias("_mail"), "created_at")
    # Requests of one e-mail and instant are one row in the join.
    holds = holds.groupBy(*keys, "_mail", "created_at").agg(F.count(F.lit(1)).alias("_n")).join(mails, "_mail", "left")
    always_paid = F.col("_known").isNotNull() & F.col("_paid_at").isNull()
    ends = F.least(F.col("created_at") + interval(hold), F.col("_paid_at"))
    counted = holds.filter(~always_paid & (F.col("_paid_at").isNull() | (F.col("_paid_at") > F.col("created_at"))))
    starts = counted.select(*keys, F.col("created_at").alias("instant"), F.col("_n").alias("_d"))
    stops = counted.select(*keys, ends.alias("instant"), (-F.col("_n")).alias("_d"))
    there = payers.dropna(subset=keys)
    came = there.filter(F.col(imported_at).isNotNull()).select(*keys, F.col(imported_at).alias("instant"), F.lit(1).cast("long").alias("_d"))
    steps = starts.unionByName(stops).unionByName(came).groupBy(*keys, "instant").agg(F.sum("_d").alias("_d")).withColumn("_read", F.lit(0))
    reads = instants.select(*keys, "instant").distinct().select("*", F.lit(0).cast("long").alias("_d"), F.lit(1).alias("_read"))
    line = running_sum(steps.unionByName(reads), keys, ["instant", "_read"], "_d", "_taken", max_group_rows).filter("_read = 1")
    first = count_by(there.filter(F.col(imported_at).isNull()), keys, "_first")
    taken = (F.col("_taken") + F.coalesce("_first", F.lit(0))).cast("int")
    return line.join(cap, keys).join(first, keys, "left").select(
        *keys, "instant", taken.alias("taken"), F.greatest(F.col("capacity") - taken, F.lit(0)).alias("remaining")
    )
