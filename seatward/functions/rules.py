"""Request validation and table checks as rule lists evaluated in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatward.functions.dims import INSCRIPTION_POOLS, ROLES, ROOM_POOLS
from seatward.functions.text import EMAIL_PATTERN, is_blank

Rule = tuple[str, Column]


def inscription_rules(pools: Sequence[str] | None = None) -> list[Rule]:
    pools = list(pools or [p[0] for p in INSCRIPTION_POOLS])
    email, pool, role = F.col("email"), F.col("pool"), F.col("role")
    return [
        ("nom_blank", is_blank(F.col("nom"))),
        ("prenom_blank", is_blank(F.col("prenom"))),
        ("email_invalid", is_blank(email) | ~email.rlike(EMAIL_PATTERN)),
        ("type_null", pool.isNull()),
        ("type_invalid", ~pool.isin(pools)),
        ("role_invalid", role.isNotNull() & ~role.isin(list(ROLES))),
    ]


def room_rules() -> list[Rule]:
    email, room = F.col("email"), F.col("room_type")
    return [
        ("nom_blank", is_blank(F.col("nom"))),
        ("prenom_blank", is_blank(F.col("prenom"))),
        ("email_invalid", is_blank(email) | ~email.rlike(EMAIL_PATTERN)),
        ("type_null", room.isNull()),
        ("type_invalid", ~room.isin([p[0] for p in ROOM_POOLS])),
    ]


def first_reason(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that is true, null when none is."""
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in rules])


def validate_requests(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds ``reason``; accepted rows have a null reason, so one pass serves both outputs."""
    return df.withColumn("reason", first_reason(rules))


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reason").isNull()).drop("reason")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reason").isNotNull())


def check_not_null(*cols: str) -> list[Rule]:
    return [(f"{c}_not_null", F.col(c).isNull()) for c in cols]


def check_in(col: str, values: Sequence) -> Rule:
    return (f"{col}_in", F.coalesce(~F.col(col).isin(list(values)), F.lit(False)))


def check_between(col: str, low, high) -> Rule:
    return (f"{col}_between", F.coalesce(~F.col(col).between(low, high), F.lit(False)))


def check_table(df: DataFrame, rules: Sequence[Rule], unique: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(rule, bad_rows): violating rows per rule, and for a UNIQUE rule the rows beyond the first of each key."""
    counts = df.agg(*[F.count_if(cond).alias(name) for name, cond in rules])
    pairs = [F.struct(F.lit(n).alias("rule"), F.col(n).cast("long").alias("bad_rows")) for n, _ in rules]
    report = counts.select(F.inline(F.array(*pairs)))
    for name, keys in (unique or {}).items():
        extra = (
            df.dropna(subset=list(keys))
            .groupBy(*keys)
            .count()
            .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("bad_rows"))
            .select(F.lit(name).alias("rule"), "bad_rows")
        )
        report = report.unionByName(extra)
    return report
