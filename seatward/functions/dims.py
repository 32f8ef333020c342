"""Dimension tables: capacities, prices, regions. All are small and given, none grows with the data."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Pool, capacity, price in EUR, display order.
INSCRIPTION_POOLS = [
    ("equipe", 12, Decimal("325.00"), 1),
    ("jeu_libre", 50, Decimal("65.00"), 2),
    ("narratif", 16, Decimal("65.00"), 3),
]
DEFAULT_PRICE = Decimal("65.00")
ROOM_POOLS = [
    ("simple", 1, Decimal("60.00"), 1),
    ("double", 10, Decimal("90.00"), 2),
    ("triple", 3, Decimal("110.00"), 3),
]
POOL_LABELS = [
    ("equipe", "⚔ Compétitif · Équipes"),
    ("jeu_libre", "🎲 Jeu Libre"),
    ("narratif", "📜 Narratif"),
]
HOLD = timedelta(minutes=30)
CELLS_PER_CHAMPION = 5
ROUNDS = (1, 5)
ROLES = ("capitaine", "coequipier")
STATUSES = ("pending", "paid", "waived", "cancelled")
ALLIANCES = ("A", "B", "C", "D")

# Region and alliance, in map order.
REGION_ALLIANCE = [
    ("Alsace", "A"),
    ("Bretagne", "A"),
    ("Basse-Normandie", "A"),
    ("Rhône-Alpes", "A"),
    ("Corse", "A"),
    ("Nord-Pas-de-Calais", "B"),
    ("Bourgogne", "B"),
    ("Provence-Alpes-Côte d'Azur", "B"),
    ("Aquitaine", "B"),
    ("Midi-Pyrénées", "B"),
    ("Picardie", "C"),
    ("Haute-Normandie", "C"),
    ("Centre", "C"),
    ("Franche-Comté", "C"),
    ("Auvergne", "C"),
    ("Lorraine", "D"),
    ("Pays de la Loire", "D"),
    ("Champagne-Ardenne", "D"),
    ("Poitou-Charentes", "D"),
    ("Languedoc-Roussillon", "D"),
    ("Limousin", "D"),
    ("Île-de-France", "IDF"),
]

POOL_COLUMNS = [("pool", "string"), ("capacity", "int"), ("price", "decimal(8,2)"), ("ord", "int")]


def dim_df(spark: SparkSession, rows: Iterable[Sequence], columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Inline relation. A ``VALUES`` list is a local relation, so the optimizer knows how small it is."""
    rows = list(rows)
    if not rows:
        return spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in columns))
    names = ", ".join(n for n, _ in columns)
    line = lambda i: ", ".join(f"CAST(:r{i}_{n} AS {t})" for n, t in columns)
    body = ", ".join(f"({line(i)})" for i in range(len(rows)))
    args = {f"r{i}_{n}": v for i, r in enumerate(rows) for (n, _), v in zip(columns, r)}
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})", args=args)


def inscription_pools(spark: SparkSession) -> DataFrame:
    return dim_df(spark, INSCRIPTION_POOLS, POOL_COLUMNS)


def room_pools(spark: SparkSession) -> DataFrame:
    return dim_df(spark, ROOM_POOLS, POOL_COLUMNS)


def region_alliances(spark: SparkSession) -> DataFrame:
    return dim_df(spark, REGION_ALLIANCE, [("region", "string"), ("alliance", "string")])


def lookup(key: Column, rows: Iterable[Sequence], default=None) -> Column:
    """CASE lookup for a handful of rows; use a dimension join when the list is data."""
    rows = list(rows)
    expr = F.when(key == rows[0][0], F.lit(rows[0][1]))
    for k, v in rows[1:]:
        expr = expr.when(key == k, F.lit(v))
    return expr if default is None else expr.otherwise(F.lit(default))


def pool_price(pool: Column, dim: Iterable[Sequence] = INSCRIPTION_POOLS, default=DEFAULT_PRICE) -> Column:
    return lookup(pool, [(r[0], r[2]) for r in dim], default).cast("decimal(8,2)")


def room_price(room_type: Column) -> Column:
    """Null for an unknown room type."""
    return pool_price(room_type, ROOM_POOLS, None)


def interval(span: timedelta) -> Column:
    """The span as a foldable interval literal, so a filter on it can reach the scan."""
    return F.lit(span)
