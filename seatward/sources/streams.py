"""File streams over the given tables, and running a bounded stream to its end."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from seatward.session import shared_dir
from seatward.sources.tables import load


def stream_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table as a stream: the files below the folder ``name.parquet``, or the one file of that name.

    Reading the schema fails where the table is missing. A glob over the exact name serves both forms, and takes no other table's files.
    """
    table = load(spark, folder, name)
    reader = spark.readStream.schema(table.schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    path = f"{folder.rstrip('/')}/{name}.parquet"
    if _is_file(spark, path):
        # A file source lists folders: the one file is picked by its whole name.
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    """Whether all rows of the table come from a file of just that name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(spark: SparkSession, writer: DataStreamWriter, checkpoint: str) -> list[dict]:
    """Process all input there is, then stop; returns the progress of the micro-batches.

    Arbitrary state needs the RocksDB store. Where the session has another one, it is set for good: taken back, it would be taken from streams that
    run beside this one.
    """
    if spark.conf.get(STATE_STORE) != ROCKSDB:
        spark.conf.set(STATE_STORE, ROCKSDB)
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return [dict(json.loads(p.json)) for p in query.recentProgress]


def drain_to_table(stream: DataFrame, name: str, finish: Callable[[], None] | None = None) -> DataFrame:
    """Run a stream over its present input into a Parquet table and read it back.

    ``finish`` (see ``closable``) ends the input; the stream then goes on from its checkpoint, so that what waited comes out.
    """
    spark = stream.sparkSession
    base = run_folder(spark, name)
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
    drain(spark, writer, f"{base}/progress")
    if finish is not None:
        finish()
        drain(spark, writer, f"{base}/progress")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


# Later than any instant of a log, and one that pandas can hold.
END_OF_TIME = "2250-01-01 00:00:00"


def closable(stream: DataFrame, at: str) -> tuple[DataFrame, Callable[[], None]]:
    """(the stream with an end, a function that sends the end): the end is a row of nulls with a far ``at``, which takes the watermark past all rows.

    An operator meets it as a row that stays in its buffer for ever, in the group of null keys. Call the function once no input is to follow.
    """
    spark = stream.sparkSession
    folder = run_folder(spark, "end")
    end = spark.range(1).select(
        *((F.lit(END_OF_TIME) if f.name == at else F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema.fields)
    )
    end.limit(0).write.parquet(folder)

    def finish() -> None:
        end.write.mode("append").parquet(folder)

    return stream.unionByName(spark.readStream.schema(end.schema).parquet(folder)), finish


def shuffled_files(df: DataFrame, at: str, files: int, mixed: int) -> tuple[str, timedelta]:
    """Write ``df`` as ``files`` single files that come one after the other, rows up to ``mixed`` files behind their time; rows without a time come in the first.

    Returns (folder, the delay by which rows are behind at most). Read one file a trigger to see a stream whose rows are out of order.
    """
    spark = df.sparkSession
    folder = run_folder(spark, "shuffled")
    t = F.unix_micros(F.col(at).cast("timestamp"))
    span = df.agg(F.min(t).alias("low"), F.max(t).alias("high")).first()
    low, high = span["low"] or 0, span["high"] or 0
    slot = F.floor((t - low) * (files - mixed) / (high - low + 1)) + F.pmod(F.xxhash64(*df.columns), F.lit(mixed + 1))
    placed = df.withColumn("_file", F.coalesce(slot, F.lit(0)))
    for k in range(files):
        placed.filter(F.col("_file") == k).drop("_file").coalesce(1).write.mode("append").parquet(folder)
    return folder, timedelta(microseconds=mixed * ((high - low) // (files - mixed) + 2))


def shuffled_stream(spark: SparkSession, folder: str, name: str, at: str, files: int = 4, mixed: int = 1) -> tuple[DataFrame, timedelta]:
    """(a table as a stream whose rows are out of order by up to a delay, that delay)."""
    table = load(spark, folder, name)
    written, delay = shuffled_files(table, at, files, mixed)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(written), delay
