"""Set-oriented writes: each takes a snapshot and returns the next one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatward.functions.text import norm_email
from seatward.operators.stock import as_instant


def expand_slots(df: DataFrame, n: int, out: str = "slot") -> DataFrame:
    """``n`` rows per input row, numbered from 0."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column, newest: bool = False) -> DataFrame:
    """One whole row per key. An aggregate, so a crowded key shrinks before it is shuffled."""
    others = [c for c in df.columns if c not in keys]
    pick = F.max_by if newest else F.min_by
    best = df.groupBy(*keys).agg(pick(F.struct(*others), order).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in others]).select(*df.columns)


def insert_ignore(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """Append rows whose key is absent; among new rows with equal keys the first by ``order`` stays."""
    keys = list(keys)
    if order is not None:
        rows = first_per_key(rows, keys, order)
    return target.unionByName(rows.join(target.select(*keys), keys, "left_anti").select(*target.columns))


def append_rows(target: DataFrame, rows: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Append a projection; a column the rows lack, or hold as null, takes its default."""
    filled = []
    for f in target.schema.fields:
        value = F.col(f.name) if f.name in rows.columns else F.lit(None)
        if f.name in defaults:
            value = F.coalesce(value, F.lit(defaults[f.name]))
        filled.append(value.cast(f.dataType).alias(f.name))
    return target.unionByName(rows.select(*filled))


def update_where(df: DataFrame, pred: Column, assignments: Mapping[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(pred, v).otherwise(F.col(c)) for c, v in assignments.items()})


def delete_where(df: DataFrame, pred: Column) -> DataFrame:
    """A null predicate deletes nothing."""
    return df.filter(~F.coalesce(pred, F.lit(False)))


def missing_from(src: DataFrame, dst: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``src`` with no row in ``dst`` of the same keys; ``email`` compares in lower case."""
    plain = lambda k, c: F.lower(c) if k == "email" else c
    there = dst.select(*[plain(k, F.col(k)).alias(f"_there_{k}") for k in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & (plain(k, F.col(k)) == F.col(f"_there_{k}"))
    return src.join(there, cond, "left_anti")


def upsert_payers(current: DataFrame, batch: DataFrame, order: str = "id") -> DataFrame:
    """Idempotent import. Key: transaction if present, else e-mail; the last row of a key in the batch wins.

    A row of the current list is replaced when it carries a batch key, or an e-mail of the batch (e-mails are
    unique in the list).
    """
    key = F.coalesce(F.concat(F.lit("tx:"), F.col("transaction_id")), F.concat(F.lit("em:"), norm_email(F.col("email"))))
    fresh = first_per_key(batch.withColumn("_key", key), ["_key"], F.col(order), newest=True)
    mail = norm_email(F.col("email"))
    fresh = first_per_key(fresh.withColumn("_mail", mail), ["_mail"], F.col(order), newest=True)
    kept = (
        current.withColumn("_key", key)
        .withColumn("_mail", mail)
        .join(fresh.select("_key"), "_key", "left_anti")
        .join(fresh.select("_mail"), "_mail", "left_anti")
    )
    return kept.select(*current.columns).unionByName(fresh.select(*current.columns))


def upsert_payers_batches(current: DataFrame, batches: DataFrame, number: str, order: str = "id") -> DataFrame:
    """``upsert_payers`` for each batch of ``batches`` in the order of the column ``number`` (0 or more), in one step.

    A row stays where no later batch has a row that counts of its key or its e-mail.
    """
    key = F.coalesce(F.concat(F.lit("tx:"), F.col("transaction_id")), F.concat(F.lit("em:"), norm_email(F.col("email"))))
    mail = norm_email(F.col("email"))
    fresh = first_per_key(batches.withColumn("_key", key), [number, "_key"], F.col(order), newest=True)
    fresh = first_per_key(fresh.withColumn("_mail", mail), [number, "_mail"], F.col(order), newest=True)
    known = current.withColumns({number: F.lit(-1).cast("long"), "_key": key, "_mail": mail})
    rows = known.unionByName(fresh.select(*known.columns))
    for c in ("_key", "_mail"):
        last = fresh.groupBy(c).agg(F.max(number).alias(f"{c}_last"))
        rows = rows.join(last, c, "left").filter(F.coalesce(F.col(number) >= F.col(f"{c}_last"), F.lit(True)))
    return rows.select(*current.columns)


def stamp_updated(
    old: DataFrame, new: DataFrame, as_of: datetime | Column, key: str = "id", stamp: str = "updated_at"
) -> DataFrame:
    """Set the stamp on rows that differ from the old snapshot, and on new rows; others keep theirs."""
    body = [c for c in new.columns if c not in (key, stamp)]
    before = old.select(key, F.struct(*body).alias("_old"), F.col(stamp).alias("_stamp"))
    changed = ~F.struct(*[F.col(c) for c in body]).eqNullSafe(F.col("_old"))
    return new.join(before, key, "left").select(
        key, *body, F.when(changed, as_instant(as_of)).otherwise(F.col("_stamp")).alias(stamp)
    )


def apply_deletes(
    deleted: DataFrame, champions: DataFrame, cells: DataFrame, battles: DataFrame
) -> dict[str, DataFrame]:
    """Referential actions for deleted e-mails.

    A champion's own cells and battles go with it; cells it merely holds lose their owner but keep their alliance;
    a battle whose cell went keeps its row without the cell. Invitations hang on payers, not on champions, and stay.
    """
    gone = deleted.select(F.col("email").alias("_gone")).distinct()
    drop = lambda df, c: df.join(gone, df[c] == gone["_gone"], "left_anti")
    kept_cells = drop(cells, "cluster_owner_email")
    owners = kept_cells.join(gone, kept_cells["current_owner_email"] == gone["_gone"], "left")
    kept_cells = owners.withColumn(
        "current_owner_email", F.when(F.col("_gone").isNull(), F.col("current_owner_email"))
    ).select(*cells.columns)
    gone_cells = cells.join(gone, cells["cluster_owner_email"] == gone["_gone"], "left_semi").select(
        F.col("id").alias("_gone_cell")
    )
    kept_battles = drop(drop(battles, "winner_email"), "loser_email")
    marked = kept_battles.join(gone_cells, kept_battles["cell_transferred_id"] == gone_cells["_gone_cell"], "left")
    kept_battles = marked.withColumn(
        "cell_transferred_id", F.when(F.col("_gone_cell").isNull(), F.col("cell_transferred_id"))
    ).select(*battles.columns)
    return {"champions": drop(champions, "email"), "cells": kept_cells, "battles": kept_battles}


def delete_payers(deleted: DataFrame, payers: DataFrame, invites: DataFrame) -> dict[str, DataFrame]:
    """Payers of the deleted e-mails go, and with them the invitations they issued."""
    gone = deleted.select(F.col("email").alias("_gone")).distinct()
    drop = lambda df, c: df.join(gone, df[c] == gone["_gone"], "left_anti")
    return {"payers": drop(payers, "email"), "invites": drop(invites, "inviter_email")}


def allowed(commands: DataFrame, admins: DataFrame, actor: str = "actor") -> DataFrame:
    """Commands whose actor is on the access list."""
    return commands.join(admins.select(F.col("email").alias(actor)), actor, "left_semi")


