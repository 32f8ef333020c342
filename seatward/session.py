"""Session helpers: a local session for tests, and lineage cuts for long jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Rows of one key that a single task may sort or fold. Larger groups are split.
MAX_GROUP_ROWS = 2_000_000


def local_session(app: str = "seatward", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts: the one the cluster names, or a private one in local mode."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="seatward-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def pin(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: fixes the rows once and cuts the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def group_limit(spark: SparkSession, given: int | None) -> int:
    if given is not None:
        return given
    return int(spark.conf.get("spark.seatward.maxGroupRows", str(MAX_GROUP_ROWS)))
