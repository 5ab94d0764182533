"""Helpers the training-data operators share: Arrow batch maps and tables written to cut lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillspark.state import discard, materialise, new_path, written  # noqa: F401

#: Arrow batches handed to Python stay near this size, so a worker's memory doesn't follow the rows' length.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 4096


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """fn over each Arrow batch of df."""
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def with_columns(df: DataFrame, text: str, fn: Callable[[pa.Array], list[pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """df and, after its own columns, those that fn derives from column text."""
    at = df.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = fn(batch.column(at))
        names = [*batch.schema.names, *(f.name for f in fields)]
        return pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    return map_batches(df, run, T.StructType([*df.schema.fields, *fields]))
