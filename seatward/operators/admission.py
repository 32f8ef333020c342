"""Admission of a whole batch against the remaining stock, and creation by an administrator."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatward.functions.dims import INSCRIPTION_POOLS, ROOM_POOLS, pool_price, room_price
from seatward.functions.rules import first_reason
from seatward.functions.text import blank_to_null, co_occupants_note, norm_email, normalise_contacts
from seatward.operators.ordered import rank_rows
from seatward.operators.stock import POOL, as_instant


def admit_batch(
    stock_df: DataFrame,
    requests: DataFrame,
    policy: str = "waitlist",
    keys: Sequence[str] = POOL,
    order: Sequence[str] = ("created_at", "id"),
    max_group_rows: int | None = None,
) -> DataFrame:
    """First come, first served, for a batch in which nothing expires or is cancelled.

    The first ``remaining`` requests of a pool are held. The others join the waitlist after those already in it
    (``waitlist``), or are refused (``reject``). A pool absent from the stock has no place.
    """
    keys = list(keys)
    wait = "waitlist_count" if "waitlist_count" in stock_df.columns else "0"
    free = stock_df.select(
        *keys, F.greatest(F.col("remaining"), F.lit(0)).alias("_free"), F.expr(wait).alias("_waiting")
    )
    ranked = rank_rows(requests, keys, order, "_rank", max_group_rows).join(free, keys, "left")
    free_places, rank = F.coalesce(F.col("_free"), F.lit(0)), F.col("_rank")
    held = rank <= free_places
    if policy == "reject":
        decision = {"decision": F.when(held, "held").otherwise("rejected")}
    elif policy == "waitlist":
        place = F.coalesce(F.col("_waiting"), F.lit(0)) + rank - free_places
        decision = {
            "decision": F.when(held, "held").otherwise("waitlisted"),
            "is_waitlist": ~held,
            "waitlist_position": F.when(~held, place).cast("int"),
        }
    else:
        raise ValueError(f"unknown policy {policy}")
    return ranked.withColumns(decision).drop("_rank", "_free", "_waiting")


def room_requests(
    stock_df: DataFrame, requests: DataFrame, rules, max_group_rows: int | None = None
) -> DataFrame:
    """Room reservations: validate, admit while rooms are left, refuse the rest; priced per room, two nights.

    Contacts are stored normalised: e-mail in lower case, names trimmed, a blank telephone null.
    """
    checked = requests.withColumn("reason", first_reason(rules))
    valid = checked.filter(F.col("reason").isNull()).drop("reason")
    decided = admit_batch(stock_df, valid, "reject", ["room_type"], max_group_rows=max_group_rows)
    decided = decided.withColumn("reason", F.when(F.col("decision") == "rejected", "sold_out"))
    refused = checked.filter(F.col("reason").isNotNull()).withColumn("decision", F.lit("rejected"))
    held = F.col("decision") == "held"
    return normalise_contacts(decided.unionByName(refused)).withColumns(
        {
            "nights": F.when(held, F.lit(2)).cast("int"),
            "amount_eur": F.when(held, room_price(F.col("room_type"))),
            "payment_status": F.when(held, F.lit("pending")),
            "admin_notes": F.when(held, co_occupants_note(F.col("co_occupants"))),
        }
    )


def admin_rules(key: str = "pool", kinds: Sequence[str] | None = None) -> list:
    """What an administrator's creation is refused for: a type that is not offered, a status it cannot start in; null is neither."""
    kinds = list(kinds or [p[0] for p in (ROOM_POOLS if key == "room_type" else INSCRIPTION_POOLS)])
    known = lambda c, values: F.coalesce(F.col(c).isin(values), F.lit(False))
    return [("type_invalid", ~known(key, kinds)), ("status_invalid", ~known("payment_status", ["pending", "paid", "waived"]))]


def admin_rejected(requests: DataFrame, key: str = "pool", kinds: Sequence[str] | None = None) -> DataFrame:
    """The rows that ``admin_create`` refuses, with ``reason``."""
    return requests.withColumn("reason", first_reason(admin_rules(key, kinds))).filter(F.col("reason").isNotNull())


def admin_create(
    requests: DataFrame,
    as_of: datetime | Column,
    stock_df: DataFrame | None = None,
    key: str = "pool",
    price: Column | None = None,
    order: Sequence[str] = ("created_at", "id"),
    max_group_rows: int | None = None,
    kinds: Sequence[str] | None = None,
) -> DataFrame:
    """Rows created by an administrator: any stock, an offered type, ``pending``, ``paid`` or ``waived``.

    Other rows are not created; ``admin_rejected`` gives them with the reason.
    ``paid_at`` is set for ``paid`` only. Given a stock, ``overbooked`` marks the rows made when none was left.
    """
    price = pool_price(F.col(key)) if price is None else price
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = requests.filter(first_reason(admin_rules(key, kinds)).isNull()).withColumns(
        {
            "nom": F.trim(text("nom")),
            "prenom": F.trim(text("prenom")),
            "email": norm_email(text("email")),
            "telephone": blank_to_null(text("telephone")),
            "amount_eur": price,
            "paid_at": F.when(F.col("payment_status") == "paid", as_instant(as_of)),
        }
    )
    if stock_df is None:
        return rows
    decided = admit_batch(stock_df, rows, "reject", [key], order, max_group_rows)
    return decided.withColumn("overbooked", F.col("decision") == "rejected").drop("decision")
