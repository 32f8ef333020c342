"""Duplicate clicks: a request within the hold of the last *kept* request of its key reuses it.

The rule chains: whether a row is kept depends on the kept row before it, so comparing a row with its direct
predecessor gives other results.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatward.functions.dims import HOLD, interval
from seatward.operators.ordered import rank_rows, running_sum
from seatward.session import pin

# Rows of one key folded in one array; busier keys follow pointers instead.
FOLD_ROWS = 10_000


def dedupe_holds(
    requests: DataFrame,
    keys: Sequence[str] = ("email", "pool"),
    at: str = "created_at",
    id: str = "id",
    hold: timedelta = HOLD,
    fold_rows: int = FOLD_ROWS,
    max_group_rows: int | None = None,
) -> DataFrame:
    """(keys, ``at``, ``id``) of the kept rows. Of rows at one instant the smallest id counts.

    Null keys are a key like any other. A row without a time has no place in the chain: it neither counts nor is kept.
    """
    keys = list(keys)
    rows = requests.select(*keys, at, id).filter(F.col(at).isNotNull())
    busy = rows.groupBy(*keys).count().filter(F.col("count") > fold_rows).select(*keys)
    if busy.isEmpty():
        return _kept_by_fold(rows, keys, at, id, hold)
    # Joins drop null keys, so each key goes in as two columns that are never null.
    busy, whole = pin(_plain(busy, keys)), _plain(rows, keys)
    plain = _plain_names(keys)
    few = whole.join(busy, plain, "left_anti")
    many = whole.join(busy, plain, "left_semi").groupBy(*plain, at).agg(F.min(id).alias(id))
    kept = _kept_by_fold(few, plain, at, id, hold).unionByName(_kept_by_pointers(many, plain, at, id, hold, max_group_rows))
    return kept.select(*[F.when(~F.col(f"_key_{k}_null"), F.col(f"_key_{k}")).alias(k) for k in keys], at, id)


def _plain_names(keys: list[str]) -> list[str]:
    return [f"_key_{k}{end}" for k in keys for end in ("_null", "")]


def _plain(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys as pairs that are never null: whether the key is null, and the key or a default of its type."""
    kinds = dict(rows.dtypes)
    rest = [c for c in rows.columns if c not in keys]
    pairs = []
    for k in keys:
        default = F.lit("").cast("string") if kinds[k] == "string" else F.lit(0).cast(kinds[k])
        pairs += [F.col(k).isNull().alias(f"_key_{k}_null"), F.coalesce(F.col(k), default).alias(f"_key_{k}")]
    return rows.select(*pairs, *rest)


def _kept_by_fold(rows: DataFrame, keys: list[str], at: str, id: str, hold: timedelta) -> DataFrame:
    """One ordered pass over each key's array, of at most ``fold_rows`` items; one shuffle."""
    item = F.struct(F.col(at), F.col(id))
    rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_rows"))
    first = F.struct(F.col("_rows")[0][at].alias("anchor"), F.array(F.col("_rows")[0]).alias("kept"))
    kept = F.aggregate(
        F.slice("_rows", 2, F.size("_rows")),
        first,
        lambda acc, x: F.when(
            x[at] >= acc["anchor"] + interval(hold),
            F.struct(x[at].alias("anchor"), F.concat(acc["kept"], F.array(x)).alias("kept")),
        ).otherwise(acc),
    )["kept"]
    return rows.select(*keys, F.inline(kept))


def _kept_by_pointers(
    clicks: DataFrame, keys: list[str], at: str, id: str, hold: timedelta, max_group_rows: int | None
) -> DataFrame:
    """Kept rows of busy keys without gathering a key.

    Every row points to the row that would be kept after it: the first one at least a hold later. The kept rows
    are those reached from the first. Pointers of 1, 2, 4, ... steps are built by joining the table with itself,
    then the reached set grows from the longest pointers down. The rounds are log2 of (time span / hold) at most,
    and every join key is unique.
    """
    rows = pin(rank_rows(clicks, keys, [at, id], "_i", max_group_rows))
    # The target's rank is one more than the number of rows before (instant + hold).
    marks = rows.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_row"), F.lit(1).alias("_n"), "_i")
    probes = rows.select(
        *keys, (F.col(at) + interval(hold)).alias("_t"), F.lit(0).alias("_row"), F.lit(0).alias("_n"), "_i"
    )
    counted = running_sum(marks.unionByName(probes), keys, ["_t", "_row", "_i"], "_n", "_before", max_group_rows)
    targets = rows.select(*keys, F.col("_i").alias("_j"))
    hop = pin(
        counted.filter("_row = 0")
        .select(*keys, "_i", (F.col("_before") + 1).alias("_j"))
        .join(targets, [*keys, "_j"], "left_semi")
    )
    hops = []
    while not hop.isEmpty():
        hops.append(hop)
        onward = hop.select(*keys, F.col("_i").alias("_j"), F.col("_j").alias("_k"))
        hop = pin(hop.join(onward, [*keys, "_j"]).select(*keys, "_i", F.col("_k").alias("_j")))
    reached = rows.filter("_i = 1").select(*keys, "_i")
    for hop in reversed(hops):
        further = hop.join(reached, [*keys, "_i"], "left_semi").select(*keys, F.col("_j").alias("_i"))
        reached = pin(reached.unionByName(further))
    return rows.join(reached, [*keys, "_i"], "left_semi").select(*keys, at, id)
