"""Running totals, ranks and previous rows inside keys of any size.

A window partitioned by a key sends the whole key to one task. Each function here first measures the largest
key. While it fits ``max_group_rows`` the plain window runs. Beyond that the rows are range-partitioned on
(key, order) into slices of about that size, the window runs per slice, and what precedes a slice is added from
a table holding one row per (key, slice).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatward.session import group_limit, pin

SLICE = "_slice"


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(rows of the largest key, rows in all); a map-side combined count, two numbers reach the driver."""
    row = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    return row[0] or 0, row[1] or 0


def join_same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that keeps rows with null keys; the columns are the left ones and what else is on the right."""
    cond = F.lit(True)
    for k in keys:
        right = right.withColumnRenamed(k, f"_r_{k}")
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, cond).drop(*[f"_r_{k}" for k in keys])


def slice_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, total: int) -> DataFrame:
    """Number the slices of a range partitioning on (keys, order) and pin the result.

    The bounds come from a sample, so a recomputation could move them: the slice numbers are written once.
    """
    n = max(2, math.ceil(total / rows))
    cols = [F.col(k).asc() for k in keys] + [F.col(o).asc_nulls_last() for o in order]
    return pin(df.repartitionByRange(n, *cols).withColumn(SLICE, F.spark_partition_id()))


def _window(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*[F.col(o).asc_nulls_last() for o in order])


def _with_offset(sliced: DataFrame, keys: Sequence[str], amount: Column) -> DataFrame:
    """Add ``_slice_before``: the total of ``amount`` over the earlier slices of the same key."""
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, SLICE)
        .agg(amount.alias("_slice_amount"))
        .withColumn("_slice_before", F.coalesce(F.sum("_slice_amount").over(before), F.lit(0)))
        .drop("_slice_amount")
    )
    return join_same_key(sliced, offsets, [*keys, SLICE])


def rank_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "rank",
    max_group_rows: int | None = None,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """``row_number`` of each row in its key; ``order`` must end in a unique column.

    Pass ``sizes`` when ``group_sizes`` has run already.
    """
    limit = group_limit(df.sparkSession, max_group_rows)
    largest, total = sizes or group_sizes(df, keys)
    if largest <= limit:
        return df.withColumn(out, F.row_number().over(_window(keys, order)).cast("long"))
    sliced = _with_offset(slice_by_range(df, keys, order, limit, total), keys, F.count(F.lit(1)))
    here = F.row_number().over(_window([*keys, SLICE], order))
    return sliced.withColumn(out, (F.col("_slice_before") + here).cast("long")).drop(SLICE, "_slice_before")


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
    max_group_rows: int | None = None,
) -> DataFrame:
    """Sum of ``value`` over the rows of the key up to and including this one."""
    limit = group_limit(df.sparkSession, max_group_rows)
    largest, total = group_sizes(df, keys)
    upto = (Window.unboundedPreceding, 0)
    if largest <= limit:
        return df.withColumn(out, F.sum(value).over(_window(keys, order).rowsBetween(*upto)).cast("long"))
    sliced = _with_offset(slice_by_range(df, keys, order, limit, total), keys, F.sum(value))
    here = F.sum(value).over(_window([*keys, SLICE], order).rowsBetween(*upto))
    return sliced.withColumn(out, (F.col("_slice_before") + here).cast("long")).drop(SLICE, "_slice_before")


def count_up_to(
    df: DataFrame, keys: Sequence[str], at: str, out: str = "position", max_group_rows: int | None = None
) -> DataFrame:
    """Rows of the key whose ``at`` is not later than this row's, ties included."""
    limit = group_limit(df.sparkSession, max_group_rows)
    largest, _ = group_sizes(df, keys)
    if largest <= limit:
        peers = _window(keys, [at]).rangeBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.count(F.lit(1)).over(peers).cast("long"))
    per_time = df.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_sum(per_time, keys, [at], "_n", out, limit).drop("_n")
    return join_same_key(df, upto, [*keys, at])


def previous_values(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    prefix: str = "prev_",
    where: Column | None = None,
    max_group_rows: int | None = None,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Values of the latest earlier row of the key (for which ``where`` holds); null when there is none.

    ``sizes`` may be any upper bound on the groups.
    """
    limit = group_limit(df.sparkSession, max_group_rows)
    largest, total = sizes or group_sizes(df, keys)
    where = F.lit(True) if where is None else where
    found = F.when(where, F.struct(*values))
    before = (Window.unboundedPreceding, -1)
    names = [F.col("_slice_found")[v].alias(prefix + v) for v in values]
    if largest <= limit:
        latest = F.last(found, ignorenulls=True).over(_window(keys, order).rowsBetween(*before))
        return df.withColumn("_slice_found", latest).select(*df.columns, *names)
    sliced = slice_by_range(df, keys, order, limit, total)
    at = F.when(where, F.struct(*[F.col(o) for o in order]))
    over_slices = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(*before)
    carry = (
        sliced.groupBy(*keys, SLICE)
        .agg(F.max_by(found, at).alias("_slice_last"))
        .withColumn("_slice_carry", F.last("_slice_last", ignorenulls=True).over(over_slices))
        .drop("_slice_last")
    )
    joined = join_same_key(sliced, carry, [*keys, SLICE])
    here = F.last(found, ignorenulls=True).over(_window([*keys, SLICE], order).rowsBetween(*before))
    return joined.withColumn("_slice_found", F.coalesce(here, F.col("_slice_carry"))).select(*df.columns, *names)
