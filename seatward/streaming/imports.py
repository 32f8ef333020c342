"""Import of payer files as they arrive, each exactly once.

A micro-batch parses its files once, into a folder of its own that is divided into good and bad rows. Good rows become one version per key; the versions
since a base and the base are the table: one flat plan, however many batches there are. Everything is written under the number of the micro-batch, and a ledger entry comes last, so a batch that runs again
after a failure writes what it wrote, and readers see whole batches only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from seatward.functions.text import norm_email
from seatward.operators.writes import upsert_payers_batches
from seatward.sources.schemas import SCHEMAS
from seatward.sources.tables import BAD_RECORD

# Versions on a base before they are folded into a new one.
FOLD_EVERY = 16


def stream_payers_csv(spark: SparkSession, path: str, schema: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """CSV files below ``path`` as they arrive; rows that do not fit the schema carry their text in ``_bad_record``."""
    schema = schema or SCHEMAS["paid_users"]
    reader = spark.readStream.schema(f"{schema}, {BAD_RECORD} STRING").option("header", True).option("mode", "PERMISSIVE")
    reader = reader.option("columnNameOfCorruptRecord", BAD_RECORD)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.csv(path)


class ImportTable:
    """A payer list below one folder: ``landed`` rows by batch, ``base`` lists, and the ``ledger`` of finished batches."""

    def __init__(self, spark: SparkSession, folder: str, schema):
        self.spark, self.folder, self.schema = spark, folder, schema

    def _done(self, name: str) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/batch=*/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at)
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])

    def landed(self, batches: list[int], bad: bool) -> DataFrame:
        """Rows of the batches with the number of theirs in ``batch``."""
        schema = f"{BAD_RECORD} STRING" if bad else self.schema
        # A batch without rows of the kind has no such folder.
        reader = self.spark.read.schema(schema).option("ignoreMissingFiles", True).option("basePath", f"{self.folder}/landed")
        rows = reader.parquet(*(f"{self.folder}/landed/batch={n}" for n in batches))
        return rows.filter(F.col("is_bad") == bad).withColumn("batch", F.col("batch").cast("long")).drop("is_bad")

    def as_of(self, n: int, order: str) -> DataFrame:
        """The list after batch ``n``: the newest base up to it, and the batches since."""
        base = max((b for b in self._done("base") if b <= n), default=None)
        table = self.spark.createDataFrame([], self.schema) if base is None else self.spark.read.schema(self.schema).parquet(f"{self.folder}/base/batch={base}")
        since = list(range(0 if base is None else base + 1, n + 1))
        return upsert_payers_batches(table, self.landed(since, False), "batch", order) if since else table

    def batches(self) -> list[int]:
        return self._done("ledger")


def import_payers(files: DataFrame, folder: str, order: str = "id", fold_every: int = FOLD_EVERY) -> DataStreamWriter:
    """Upsert each micro-batch of a file stream (rows with ``_bad_record``) into the list below ``folder``.

    Keys and rules are those of ``upsert_payers``. ``imported_payers`` reads the list, ``rejected_rows`` the bad rows, ``import_ledger`` what came in which batch.
    """
    spark = files.sparkSession
    fields = [f for f in files.schema.fields if f.name != BAD_RECORD]
    table = ImportTable(spark, folder, type(files.schema)(fields))

    def take(batch: DataFrame, n: int) -> None:
        marked = batch.withColumn("is_bad", F.col(BAD_RECORD).isNotNull())
        marked.write.mode("overwrite").partitionBy("is_bad").parquet(f"{folder}/landed/batch={n}")
        counts = spark.read.parquet(f"{folder}/landed/batch={n}").agg(F.count_if(~F.col("is_bad")).alias("good"), F.count_if("is_bad").alias("bad"))
        if n % fold_every == fold_every - 1:
            table.as_of(n, order).write.mode("overwrite").parquet(f"{folder}/base/batch={n}")
        counts.write.mode("overwrite").parquet(f"{folder}/ledger/batch={n}")

    return files.writeStream.foreachBatch(take)


def imported_payers(spark: SparkSession, folder: str, schema: str | None = None, order: str = "id") -> DataFrame:
    """The list after the last finished batch."""
    empty = spark.createDataFrame([], schema or SCHEMAS["paid_users"])
    table = ImportTable(spark, folder, empty.schema)
    done = table.batches()
    return table.as_of(done[-1], order) if done else empty


def rejected_rows(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """(batch, text of the row) for the rows of finished batches that did not fit the schema."""
    empty = spark.createDataFrame([], f"batch long, {BAD_RECORD} string")
    table = ImportTable(spark, folder, spark.createDataFrame([], schema or SCHEMAS["paid_users"]).schema)
    done = table.batches()
    return empty.unionByName(table.landed(done, True)) if done else empty


def import_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, good, bad): rows of each finished batch."""
    return spark.read.option("basePath", f"{folder}/ledger").parquet(f"{folder}/ledger/batch=*")
