"""The log of a store's table as a stream: each commit's rows once, in order, from any commit or cursor on.

The offset is the number of a commit. A new query first gets what stands in the log (from option after on, 0 unless given), then what is
appended: nothing is missing between the two, and nothing comes twice, also over restarts, since Spark keeps the offsets. With
the options key, at and cursors, rows of a key under its cursor are left out, as for a reader who comes back.

Registered by spark.dataSource.register(CommitLog); options path (the store), table, and if need be after, key, at and cursors
(JSON: key to first number wanted). The schema is the table's; pass it with .schema(). A replaced table has no log: an error.
Partitions are files. They are read with pyarrow on the executors, so path has to be a store that pyarrow knows (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quillspark.sources.commits import Store, Transaction, batches_into

BATCH_ROWS = 4096


def _open(path: str) -> tuple[Any, str]:
    """pyarrow's file system of a path, and the path within it."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _as_spark(column: pa.Array, kind: T.DataType) -> pa.Array:
    """Times as Spark takes them: microseconds, of UTC if they are instants."""
    import pyarrow.compute as pc

    if not isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return column
    if column.type.tz is None and isinstance(kind, T.TimestampType):
        column = pc.assume_timezone(column.cast(pa.timestamp("us")), "UTC")
    return column.cast(pa.timestamp("us", "UTC" if isinstance(kind, T.TimestampType) else None))


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: T.StructType) -> None:
        self.root, self.table, self.after = options["path"].rstrip("/"), options["table"], int(options.get("after", 0))
        self.key, self.at, self.cursors = options.get("key"), options.get("at"), json.loads(options.get("cursors", "{}"))
        self.fields = schema.fields

    def _numbers(self) -> list[int]:
        from pyarrow import fs

        store, root = _open(self.root)
        return sorted(int(f.base_name) for f in store.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True)))

    def initialOffset(self) -> dict:
        return {"commit": self.after}

    def latestOffset(self) -> dict:
        return {"commit": max([self.after, *self._numbers()])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _open(self.root)
        found: list[InputPartition] = []
        there = set(self._numbers())
        for number in range(start["commit"] + 1, end["commit"] + 1):
            if number not in there:
                raise ValueError(f"commit {number} has been removed")
            with store.open_input_stream(f"{root}/commits/{number:012d}") as f:
                manifest = json.loads(f.read())
            if self.table in manifest["replaced"] and (found or start["commit"] > self.after):
                raise ValueError(f"{self.table} was replaced in commit {number}")
            for folder in manifest["added"].get(self.table, []):
                files = store.get_file_info(fs.FileSelector(f"{root}/data/{folder}"))
                found += [_File(f.path) for f in files if f.is_file and f.size and not f.base_name.startswith(("_", "."))]
        return found

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        store, _ = _open(self.root)
        for batch in pq.ParquetFile(store.open_input_file(partition.path)).iter_batches(BATCH_ROWS, columns=[f.name for f in self.fields]):
            if self.key and self.cursors:
                first = [self.cursors.get(str(k), 0) for k in batch.column(self.key).to_pylist()]
                batch = batch.filter(pc.greater_equal(batch.column(self.at), pa.array(first, batch.column(self.at).type)))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([_as_spark(batch.column(f.name), f.dataType) for f in self.fields], names=[f.name for f in self.fields])

    def commit(self, end: dict) -> None:
        pass


class CommitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "commit_log"

    def schema(self) -> str:
        store, root = _open(self.options["path"].rstrip("/"))
        from pyarrow import fs

        last = max(f.base_name for f in store.get_file_info(fs.FileSelector(f"{root}/commits")))
        with store.open_input_stream(f"{root}/commits/{last}") as f:
            return T.StructType.fromJson(json.loads(json.loads(f.read())["tables"][self.options["table"]]["schema"]))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Reader(dict(self.options), schema)


def follow(spark: SparkSession, store: Store, table: str, **options: str) -> DataFrame:
    """A store's table as a stream."""
    spark.dataSource.register(CommitLog)
    return spark.readStream.format("commit_log").option("path", store.path).option("table", table).options(**options).load()


def drain_into(stream: DataFrame, store: Store, table: str, writer: str, mode: str = "append", also: Callable[[Transaction, DataFrame], None] | None = None) -> None:
    """Append to a store's table what the stream has not given this writer yet, each batch once, and return.

    What the writer has seen is kept beside the store.
    """
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{store.path}/writers/{writer}").trigger(availableNow=True)
    query.foreachBatch(batches_into(store, table, writer, also)).start().awaitTermination()
