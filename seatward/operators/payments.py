"""Payment status commands, edits, repricing, backfill and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatward.functions.dims import DEFAULT_PRICE
from seatward.functions.text import BACKFILL_NOTE, blank_to_null, cancel_line, norm_email, or_placeholder
from seatward.operators.stock import in_pools
from seatward.operators.writes import missing_from, update_where

# Status written by each command.
STATUS_OF = {"paid": "paid", "waived": "waived", "unmark": "pending", "cancel": "cancelled"}


def _status_of(action: Column) -> Column:
    pairs = list(STATUS_OF.items())
    expr = F.when(action == pairs[0][0], pairs[0][1])
    for a, s in pairs[1:]:
        expr = expr.when(action == a, s)
    return expr


def unmatched(commands: DataFrame, rows: DataFrame) -> DataFrame:
    """Commands that name no row."""
    return commands.join(rows.select("id"), "id", "left_anti")


def apply_status(rows: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply paid / waived / unmark / cancel commands in ``(ts, seq)`` order; any state may follow any other.

    One aggregate per id replaces the sequence: the last command sets the status; the last command other than a
    cancel sets ``paid_at``; each cancel adds a line to the notes. Only cancel lines are gathered, and they end
    up in one notes field anyway. Returns (snapshot, commands with an unknown id).
    """
    known = commands.filter(F.col("action").isin(list(STATUS_OF)))
    when = F.struct("ts", "seq")
    is_cancel = F.col("action") == "cancel"
    last = known.groupBy("id").agg(
        F.max_by(F.struct("action", "ts"), when).alias("_last"),
        F.max_by(F.when(~is_cancel, F.struct("action", "ts")), F.when(~is_cancel, when)).alias("_pay"),
        F.collect_list(
            F.when(is_cancel, F.struct("ts", "seq", cancel_line(F.col("ts"), F.col("reason")).alias("line")))
        ).alias("_lines"),
    )
    lines = F.transform(F.array_sort(F.col("_lines")), lambda x: x["line"])
    cancelled = F.col("_last.action") == "cancel"
    paid_at = F.when(F.col("_pay.action").isin("paid", "waived"), F.col("_pay.ts"))
    hit = F.col("_last").isNotNull()
    snapshot = (
        rows.join(last, "id", "left")
        .withColumns(
            {
                "payment_status": F.coalesce(_status_of(F.col("_last.action")), F.col("payment_status")),
                "paid_at": F.when(F.col("_pay").isNotNull(), paid_at).otherwise(F.col("paid_at")),
                "cancelled_at": F.when(hit, F.when(cancelled, F.col("_last.ts"))).otherwise(F.col("cancelled_at")),
                "admin_notes": F.when(
                    F.size("_lines") > 0, F.concat_ws("\n", F.col("admin_notes"), lines)
                ).otherwise(F.col("admin_notes")),
            }
        )
        .select(*rows.columns)
    )
    return snapshot, unmatched(commands, rows)


def newly_cancelled(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids that went to cancelled while holding a place: what promotion acts on."""
    was = before.filter((F.col("payment_status") != "cancelled") & ~F.col("is_waitlist")).select("id")
    return after.filter(F.col("payment_status") == "cancelled").select("id").join(was, "id", "left_semi")


def apply_edits(rows: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overwrite notes and payment link with the last ``notes`` / ``payment_url`` command of each id.

    A note may be set to null; a blank link becomes null. Returns (snapshot, commands with an unknown id).
    """
    when = F.struct("ts", "seq")
    of = lambda a: F.col("action") == a
    boxed = F.struct(F.col("value").alias("v"))
    last = commands.groupBy("id").agg(
        F.max_by(F.when(of("notes"), boxed), F.when(of("notes"), when)).alias("_notes"),
        F.max_by(F.when(of("payment_url"), boxed), F.when(of("payment_url"), when)).alias("_url"),
    )
    snapshot = (
        rows.join(last, "id", "left")
        .withColumns(
            {
                "admin_notes": F.when(F.col("_notes").isNotNull(), F.col("_notes.v")).otherwise(F.col("admin_notes")),
                "custom_payment_url": F.when(F.col("_url").isNotNull(), blank_to_null(F.col("_url.v"))).otherwise(
                    F.col("custom_payment_url")
                ),
            }
        )
        .select(*rows.columns)
    )
    return snapshot, unmatched(commands, rows)


def needs_reprice(price: Column, amount: str = "amount_eur") -> Column:
    """Null counts as different."""
    return ~F.col(amount).eqNullSafe(price)


def reprice(
    rows: DataFrame, price: Column, only_amounts: Sequence | None = None, amount: str = "amount_eur"
) -> DataFrame:
    """Put rows on the list price; ``only_amounts`` limits it to rows with one of these old amounts."""
    pred = needs_reprice(price, amount)
    if only_amounts is not None:
        pred = pred & F.col(amount).isin(list(only_amounts))
    return update_where(rows, pred, {amount: price})


def backfill(payers: DataFrame, requests: DataFrame, cap: DataFrame) -> DataFrame:
    """Paid rows for payers of a known pool who have no row of that pool yet."""
    todo = missing_from(in_pools(payers, cap), requests, ["email", "pool"])
    return todo.select(
        or_placeholder(F.col("nom")).alias("nom"),
        or_placeholder(F.col("prenom")).alias("prenom"),
        norm_email(F.col("email")).alias("email"),
        F.lit(None).cast("string").alias("telephone"),
        "pool",
        blank_to_null(F.col("team_label")).alias("team_name"),
        F.when(F.col("pool") == "equipe", F.lit("capitaine")).alias("role"),
        F.coalesce(F.col("montant_eur"), F.lit(DEFAULT_PRICE)).cast("decimal(12,2)").alias("amount_eur"),
        F.lit("paid").alias("payment_status"),
        F.col("imported_at").alias("paid_at"),
        F.concat(
            F.lit(BACKFILL_NOTE), F.coalesce(F.concat(F.lit("tx="), F.col("transaction_id")), F.lit("tx=manuel"))
        ).alias("admin_notes"),
    )


def backfill_counts(requests: DataFrame, prefix: str = "Backfill phase 7c") -> DataFrame:
    return (
        requests.filter((F.col("payment_status") == "paid") & F.col("admin_notes").startswith(prefix))
        .groupBy("pool")
        .agg(F.count(F.lit(1)).cast("int").alias("backfilled"))
    )


def reconcile(champions: DataFrame, payers: DataFrame) -> DataFrame:
    """Per e-mail: a champion without payment, a payer without champion, or both present."""
    side = lambda df, flag: (
        df.select(norm_email(F.col("email")).alias("email")).distinct().withColumn(flag, F.lit(True))
    )
    both = side(champions, "_c").join(side(payers, "_p"), "email", "full")
    status = (
        F.when(F.col("_p").isNull(), "champion_without_payer")
        .when(F.col("_c").isNull(), "payer_without_champion")
        .otherwise("matched")
    )
    return both.select("email", status.alias("status"))


def captain_progress(champions: DataFrame, payers: DataFrame) -> DataFrame:
    """Champions made by or through each payer against the number expected of them."""
    maker = norm_email(F.coalesce(F.col("invited_by_email"), F.col("email")))
    made = champions.groupBy(maker.alias("email")).agg(F.count(F.lit(1)).alias("_made"))
    forged = F.coalesce(F.col("_made"), F.lit(0)).cast("int")
    expected = F.coalesce(F.col("expected_champions"), F.lit(1))
    return (
        payers.select(norm_email(F.col("email")).alias("email"), "expected_champions")
        .join(made, "email", "left")
        .select(
            "email",
            expected.cast("int").alias("expected"),
            forged.alias("forged"),
            (expected - forged).cast("int").alias("missing"),
        )
    )


def paid_only(champions: DataFrame, payers: DataFrame) -> DataFrame:
    """Champions whose exact e-mail is in the payer list."""
    return champions.join(payers.select("email"), "email", "left_semi")
