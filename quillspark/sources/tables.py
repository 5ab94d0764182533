"""Table sources and sinks on plain Parquet: reads, and writes that replace a whole table or partition at once.

No ACID table format is assumed: a write goes into a new folder, and only then does the name point to it, so a reader sees
the old or the new table, never a mixture, and a failed job leaves the old one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.sources.commits import Store

Keys = Sequence[str]


def scan(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def harvest(steps: DataFrame, test: Column, order: Keys, limit: int = 200) -> DataFrame:
    """Trace steps that pass a test, the newest runs first, capped."""
    return steps.filter(test).orderBy(F.desc("run_id"), *order).limit(limit)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a fixed schema; a malformed line fails the read, blank lines don't count."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, lines numbered from 1 in each file, whose parts are read apart.

    A part's lines have rising ids; the parts' sizes are a small table, whose running sums in each file number the lines.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("id"), "value")
    sizes = rows.groupBy("file", "part").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    ahead = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "part", "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    return rows.join(starts, ["file", "part"]).select("file", (F.col("ahead") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def line_errors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line, value) of the lines of corpus files that aren't JSON of the schema."""
    parsed = F.from_json("value", f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    return numbered_lines(spark, path).withColumn("p", parsed).filter((F.trim("value") != "") & F.col("p.__bad").isNotNull()).select("file", "line", "value")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def insert_ignore(old: DataFrame, new: DataFrame, keys: Keys) -> DataFrame:
    """old and the new rows whose keys it hasn't; of new rows with one key, one."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: Keys) -> DataFrame:
    """Rows of both by key; a new value wins unless it is null."""
    side = new.withColumnsRenamed({c: f"__{c}" for c in new.columns if c not in keys})
    rows = old.join(side, list(keys), "full_outer")
    return rows.select(*keys, *[F.coalesce(f"__{c}", c).alias(c) if f"__{c}" in rows.columns else F.col(c) for c in old.columns if c not in keys])


def replace_partitions(old: DataFrame, new: DataFrame, keys: Keys) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def redacted(rows: DataFrame, columns: Keys, home: str | None = None) -> DataFrame:
    """rows with secrets hidden in JSON columns; the serialised text is searched, so nesting doesn't matter."""
    return rows.select(*[C.redact(F.col(c), home).alias(c) if c in columns else F.col(c) for c in rows.columns])


def remaining(cases: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Cases that a resumed run has still to do."""
    return cases.join(done.select(key), key, "left_anti")


def latest(versions: DataFrame, keys: Keys, version: str) -> DataFrame:
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*versions.columns), version).alias("v")).select("v.*")


def replace_table(rows: DataFrame, path: str) -> None:
    """Write rows as the next version of the table at path.

    Readers see the old or the new table at any moment, and a failed job leaves the old one. Of two writers at once one comes
    after the other.
    """
    return Store(rows.sparkSession, path).transact(lambda tx: tx.replace("table", rows))


def current_table(spark: SparkSession, path: str) -> DataFrame:
    """The table that replace_table() last committed at path."""
    return Store(spark, path).read("table")


def register_functions(spark: SparkSession) -> None:
    """SQL functions of the library, as expressions: library_norm(text)."""
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION library_norm(s STRING) RETURNS STRING RETURN regexp_replace(lower(s), '[^\\p{L}\\p{N}]', '')")


class Versions:
    """Snapshots of a table: each save is a folder of its own, listed and read by a manifest the writes append to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, rows: DataFrame, note: str = "") -> str:
        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{version}")
        entry = self.spark.range(1).select(F.lit(version).alias("version"), F.lit(note).alias("note"), F.current_timestamp().alias("saved_at"), F.lit(False).alias("deleted"))
        entry.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return version

    def list(self) -> DataFrame:
        """Versions that aren't deleted, the newest first."""
        rows = self.spark.read.parquet(f"{self.path}/manifest")
        state = rows.groupBy("version").agg(F.max("deleted").alias("deleted"), F.min("saved_at").alias("saved_at"), F.max("note").alias("note"))
        return state.filter("not deleted").orderBy(F.desc("saved_at"), F.desc("version")).select("version", "note", "saved_at")

    def read(self, version: str | None = None) -> DataFrame:
        """A version, the newest unless one is named."""
        return self.spark.read.parquet(f"{self.path}/data/{version or self.list().first()['version']}")

    def restore(self, version: str) -> str:
        """The version as a new newest one."""
        return self.save(self.read(version), f"restored {version}")

    def delete(self, version: str) -> None:
        entry = self.spark.range(1).select(F.lit(version).alias("version"), F.lit("").alias("note"), F.current_timestamp().alias("saved_at"), F.lit(True).alias("deleted"))
        entry.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")


def report(results: DataFrame, path: str) -> None:
    """A benchmark's results as JSON lines and as one markdown table."""
    write_jsonl(results, f"{path}/json")
    head = "| " + " | ".join(results.columns) + " |\n| " + " | ".join(["---"] * len(results.columns)) + " |"
    lines = results.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in results.columns]), F.lit(" |")).alias("l"))
    lines.agg(F.concat_ws("\n", F.lit(head), F.array_sort(F.collect_list("l"))).alias("value")).write.mode("overwrite").text(f"{path}/markdown")
