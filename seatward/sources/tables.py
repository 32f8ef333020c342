"""Scans, CSV import and export, JSON fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatward.sources.schemas import SCHEMAS

BAD_RECORD = "_bad_record"


def load(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """Parquet table; a declared schema spares the footer read and fixes the types."""
    reader = spark.read
    schema = schema or SCHEMAS.get(name)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_payers_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Payer export. A row that does not fit the schema is kept, with its text in ``_bad_record``."""
    schema = schema or SCHEMAS["paid_users"]
    return (
        spark.read.schema(f"{schema}, {BAD_RECORD} STRING")
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD_RECORD)
        .csv(path)
    )


def split_bad_records(df: DataFrame, bad_path: str | None = None) -> DataFrame:
    """Good rows; bad ones are written to ``bad_path`` when given."""
    if bad_path is not None:
        df.filter(F.col(BAD_RECORD).isNotNull()).write.mode("overwrite").json(bad_path)
    return df.filter(F.col(BAD_RECORD).isNull()).drop(BAD_RECORD)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One part file per task. Arrays become ``;``-joined text, which CSV can hold."""
    # Fields are written as they are; the writer would trim them by default.
    flat = [
        F.array_join(F.col(f.name), ";").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
        for f in df.schema.fields
    ]
    writer = df.select(*flat).write.mode(mode).option("header", True)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def json_field(col: Column, path: str, kind: str = "string") -> Column:
    """A field of a JSON text column; null for broken JSON."""
    return F.try_variant_get(F.try_parse_json(col), path, kind)


def parse_crest(df: DataFrame, col: str = "blason", fields: tuple[str, ...] = ()) -> DataFrame:
    """Parse the crest payload to VARIANT, and pull named fields out as strings."""
    parsed = F.try_parse_json(F.col(col))
    return df.withColumns({col: parsed} | {f"{col}_{f}": F.try_variant_get(parsed, f"$.{f}", "string") for f in fields})
