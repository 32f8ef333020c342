"""Named queries over a folder of tables, each with its check query where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatward.functions import dims
from seatward.sources import fixtures
from seatward.sources.streams import shuffled_stream, stream_table
from seatward.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The order table has dates only, so its holds last days.
LONG_HOLD = timedelta(days=30)
# Same in check SQL.
AS_OF = "(SELECT max(created_at) FROM requests)"
CUTOFF = f"({AS_OF} - INTERVAL 30 DAY)"


class Inputs:
    """Input tables by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = fixtures.table(self._spark, self._folder, name)
        setattr(self, name, df)
        return df

    def stream(self, name: str) -> DataFrame:
        """The named input as a file stream."""
        return fixtures.table(self._spark, self._folder, name, stream_table)

    def shuffled(self, name: str, source: str, at: str) -> tuple[DataFrame, timedelta]:
        """(the named input as a stream of files out of order, by how much): the rows of the given table ``source`` come late, by its time ``at``."""
        held = []

        def scan(spark: SparkSession, folder: str, table: str) -> DataFrame:
            if table != source:
                return load(spark, folder, table)
            stream, delay = shuffled_stream(spark, folder, table, at)
            held.append(delay)
            return stream

        return fixtures.table(self._spark, self._folder, name, scan), held[0]

    @property
    def cap(self) -> DataFrame:
        return dims.inscription_pools(self._spark)

    @property
    def room_cap(self) -> DataFrame:
        return dims.room_pools(self._spark).withColumnRenamed("pool", "room_type")

    @property
    def dim(self) -> DataFrame:
        return dims.region_alliances(self._spark)

    @property
    def as_of(self) -> Column:
        """Latest request date, as a scalar subquery."""
        return self.requests.agg(F.max("created_at")).scalar()


def _plain(df: DataFrame) -> DataFrame:
    """Money as double, which both engines hand over alike; the operators keep decimals."""
    money = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({c: F.col(c).cast("double") for c in money}) if money else df


def query(name: str, check: str | None = None, *tables: str):
    """Register ``fn(inputs)``; ``check`` is a query over the named inputs."""

    def add(fn):
        QUERIES[name] = lambda spark, folder: _plain(fn(Inputs(spark, folder)))
        if check is not None:
            ORACLES[name] = fixtures.check_sql(check, *tables)
        return fn

    return add
