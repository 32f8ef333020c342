"""Stock kept current while request rows arrive and change, as maintained counts.

A row that counts adds one to its pool, and a hold takes it back at the instant it expires, which is known when it comes. So each micro-batch
turns its rows into steps (+1, -1, at an instant), adds those that are due to the totals, and keeps the others for later. Only rows that
count now are kept, to undo their steps when they come again with another status. What a micro-batch reads is its own rows, the totals, and
what is active, however long the stream has run; and a stock at a later instant needs the due steps only, no new rows.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from seatward.functions.dims import HOLD, interval
from seatward.operators.stock import as_instant, count_by

STEPS = ["held", "waiting"]


def _expires(hold: timedelta) -> Column:
    return F.col("created_at") + interval(hold)


def _steps(rows: DataFrame, sign: int, as_of: Column, hold: timedelta) -> DataFrame:
    """(pool, instant, held, waiting) of rows that count: their steps, or with ``sign`` -1 the undoing of what is not undone yet.

    A null instant is at once. A row whose hold is over by ``as_of`` has nothing left to undo.
    """
    is_hold = F.col("_held") & (_expires(hold) > as_of)
    now = F.struct(F.lit(None).cast("timestamp_ntz").alias("instant"), F.when(is_hold, sign).otherwise(0).alias("held"),
                   F.when(F.col("_waits"), sign).otherwise(0).alias("waiting"))
    later = F.struct(_expires(hold).alias("instant"), F.when(is_hold, -sign).otherwise(0).alias("held"), F.lit(0).alias("waiting"))
    return rows.select("pool", F.explode(F.array(now, later)).alias("s")).select("pool", "s.*").filter("held <> 0 OR waiting <> 0")


def _summed(steps: DataFrame, *by: str) -> DataFrame:
    return steps.groupBy("pool", *by).agg(*(F.sum(c).cast("long").alias(c) for c in STEPS))


class LiveStock:
    """The tables of a live stock below one folder, a version per micro-batch: ``rows`` that count, ``steps`` to come, ``totals``."""

    def __init__(self, spark: SparkSession, folder: str, row_schema: T.StructType | None = None):
        self.spark, self.folder, self.row_schema = spark, folder, row_schema
        counts = [T.StructField(c, T.LongType()) for c in STEPS]
        self.schemas = {
            "steps": T.StructType([T.StructField("pool", T.StringType()), T.StructField("instant", T.TimestampNTZType()), *counts]),
            "totals": T.StructType([T.StructField("pool", T.StringType()), *counts, T.StructField("as_of", T.TimestampNTZType())]),
        }

    def path(self, name: str, n: int) -> str:
        return f"{self.folder}/{name}/version={n}"

    def read(self, name: str, n: int) -> DataFrame:
        schema = self.row_schema if name == "rows" else self.schemas[name]
        if n < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(name, n))

    def write(self, name: str, n: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.path(name, n))

    def drop(self, n: int) -> None:
        """Remove a version that no repeated micro-batch can need."""
        for name in ("rows", "steps", "totals") if n >= 0 else ():
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name, n))
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def newest(self) -> int:
        """The version written last: its totals come last, so it is whole."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/totals/version=*/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at)
        return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found or []), default=-1)


def _stock(cap: DataFrame, payers: DataFrame, totals: DataFrame) -> DataFrame:
    """Stock per pool of the capacity table from the totals; the payer list is counted as it is now."""
    paid = count_by(payers.dropna(subset=["pool"]), ["pool"], "_paid")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    taken = number("_paid") + number("held")
    extra = ["ord"] if "ord" in cap.columns else []
    return cap.join(paid, "pool", "left").join(totals.select("pool", *STEPS), "pool", "left").select(
        "pool", "capacity", taken.alias("taken"), F.greatest(F.col("capacity") - taken, F.lit(0)).alias("remaining"),
        number("waiting").alias("waitlist_count"), *extra,
    )


def stream_stock(
    requests: DataFrame,
    cap: DataFrame,
    payers: DataFrame,
    table: str,
    out: str,
    hold: timedelta = HOLD,
    id: str = "id",
    version: str = "created_at",
) -> DataStreamWriter:
    """After each micro-batch, write the stock of all pools to ``out/batch=<n>``.

    A row that comes again with the same ``id`` replaces the one before; within a micro-batch the largest ``version``
    counts. The instant of a stock is the latest date seen so far, so it never goes back, and holds that merely
    expired are let go of. ``table`` has the rows that count (active holds and the waitlist), the steps to come and the totals, after this
    micro-batch and the one before; their size follows what is active. Whether an e-mail is a payer's is looked up when its row comes. A
    repeated batch overwrites its own folders.
    """
    spark = requests.sparkSession
    columns = requests.columns
    flags = [T.StructField(c, T.BooleanType()) for c in ("_held", "_waits")]
    store = LiveStock(spark, table, T.StructType([*requests.schema.fields, *flags]))

    def recount(batch: DataFrame, n: int) -> None:
        mails = payers.select(F.lower(F.col("email")).alias("_mail")).distinct()
        before, known = store.read("rows", n - 1), store.read("totals", n - 1)
        newest = batch.groupBy(id).agg(F.max_by(F.struct(*batch.columns), F.col(version)).alias("row")).select("row.*")
        # Instants come from small tables: the totals, and the dates of this batch.
        last = known.agg(F.max("as_of")).first()[0]
        seen = batch.agg(F.max("created_at")).first()[0]
        as_of = max(x for x in (last, seen) if x is not None) if last or seen else None
        at = as_instant(as_of) if as_of is not None else F.lit(None).cast("timestamp_ntz")
        was = as_instant(last) if last is not None else F.lit(datetime.min.isoformat(sep=" ")).cast("timestamp_ntz")
        held = (F.col("payment_status") == "pending") & ~F.col("is_waitlist") & F.col("_mail").isNull() & (_expires(hold) > at)
        waits = F.col("is_waitlist") & (F.col("payment_status") != "cancelled")
        counted = newest.join(mails, F.lower(F.col("email")) == F.col("_mail"), "left")
        counted = counted.select(*columns, F.coalesce(held, F.lit(False)).alias("_held"), F.coalesce(waits, F.lit(False)).alias("_waits"))
        landed = f"{table}/landed/version={n}"
        counted.write.mode("overwrite").parquet(landed)
        counted = spark.read.schema(store.row_schema).parquet(landed)

        replaced = before.join(counted.select(id), id, "left_semi")
        steps = _summed(
            _steps(counted, 1, at, hold).unionByName(_steps(replaced, -1, was, hold)).unionByName(store.read("steps", n - 1).select("pool", "instant", *STEPS)),
            "instant",
        )
        due = F.col("instant").isNull() | (F.col("instant") <= at)
        store.write("steps", n, steps.filter(~due & (F.abs("held") + F.abs("waiting") > 0)))
        stays = F.col("_waits") | (F.col("_held") & (_expires(hold) > at))
        kept = before.join(counted.select(id), id, "left_anti").unionByName(counted).filter(stays)
        store.write("rows", n, kept.select(*columns, "_held", "_waits"))
        totals = _summed(known.select("pool", *STEPS).unionByName(steps.filter(due).select("pool", *STEPS)))
        store.write("totals", n, totals.withColumn("as_of", at))
        stock = _stock(cap, payers, store.read("totals", n))
        stock.withColumn("as_of", at).write.mode("overwrite").parquet(f"{out}/batch={n}")
        store.drop(n - 2)
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/landed/version={n - 1}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return requests.writeStream.foreachBatch(recount)


def latest_stock(spark: SparkSession, out: str) -> DataFrame:
    """The stock after the last micro-batch."""
    every = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    return every.filter(F.col("batch") == every.agg(F.max("batch")).scalar()).drop("batch")


def stock_at(spark: SparkSession, table: str, cap: DataFrame, payers: DataFrame, instant: datetime | Column) -> DataFrame:
    """The stock at an instant after the last micro-batch, when more holds have expired, with no row having come."""
    store = LiveStock(spark, table)
    n = store.newest()
    due = store.read("steps", n).filter(F.col("instant") <= as_instant(instant)).select("pool", *STEPS)
    return _stock(cap, payers, _summed(store.read("totals", n).select("pool", *STEPS).unionByName(due)))
