"""What the operators of this subpackage share: tables in the shared folder, column names, the query registry."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seatward.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# A word is a run of characters other than blank and the five ASCII line and tab controls (fixed pattern).
WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, check: str | None = None):
    """Register ``fn(spark, folder)``; ``check`` is the same result in DuckDB SQL over the tables."""

    def add(fn):
        QUERIES[name] = fn
        if check is not None:
            ORACLES[name] = check
        return fn

    return add


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one, so that a repeated run never meets old files."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: fixes the rows, cuts the lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def packed(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The input row as one struct, so that working columns cannot clash with its names."""
    return F.struct(*(F.col(f"`{c}`") for c in (df.columns if columns is None else columns))).alias("row")


def unpacked(df: DataFrame, *more: str) -> DataFrame:
    """The packed row's columns, then ``more``; where names clash, the operator's own column stays."""
    fields = [f for f in df.schema["row"].dataType.names if f not in more]
    return df.select(*(F.col(f"row.`{f}`").alias(f) for f in fields), *more)


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, so that later tasks find what earlier ones computed.

    Functions of this package travel by value, so their module globals are new in every task.
    """
    home = sys.modules.setdefault("_seatward_worker", types.ModuleType("_seatward_worker"))
    return home.__dict__.setdefault(name, {})
