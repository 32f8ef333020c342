"""Running a function over the texts of a table in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Texts handed to the function at once; bounds the Python objects alive at a time.
PIECE = 512


def map_texts(
    df: DataFrame, text: Column, make: Callable[[], Callable[[list], list[tuple]]], schema: str, keep: list[str] | None = None
) -> DataFrame:
    """``df`` (its columns ``keep``, all by default) with the columns ``schema`` that ``make()`` computes from a list of texts (None for null), one tuple a text.

    ``make`` runs once a task. The other columns pass through Python untouched, as Arrow buffers.
    """
    added = T.StructType.fromDDL(schema)
    kept = df.columns if keep is None else keep
    out = T.StructType([*(df.schema[c] for c in kept), *added.fields])
    arrow = to_arrow_schema(out)
    types = [arrow.field(f.name).type for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                piece = batch.slice(at, PIECE)
                rows = compute(piece.column(piece.num_columns - 1).to_pylist())
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(i) for i in range(len(kept))] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    names=[*kept, *(f.name for f in added.fields)],
                )

    return df.select(*(F.col(f"`{c}`") for c in kept), text.alias("__text")).mapInArrow(run, out)


def each(function: Callable, *given) -> Callable[[], Callable[[list], list[tuple]]]:
    """``make`` for a function of one text."""
    return lambda: lambda texts: [function(t, *given) for t in texts]

