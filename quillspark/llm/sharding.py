"""Shards by jump consistent hashing: a stable key and the shard count decide, without a ring table.

shard_documents() puts each row into a shard by its doc_id alone. With one shard more, the rows that move all move
into the new shard, about 1 in shards + 1 of them. Slots number each shard's rows without gaps.

Defined cases: a null doc_id counts as -1; a null text has no bytes (size 1, checksum 0); repeated rows go to the same
shard and get slots of their own; an empty table gives no rows. Only doc_id and text are read, so further columns,
whatever their names, do no harm.

Scale: texts are read once, then narrow rows are written and shuffled once. Slots come from a row number within (shard, bucket of a hash) plus that group's offset, and
the offsets are a table of at most (shards * BUCKETS) rows, so no task sorts a whole shard and the broadcast is bounded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.frames import materialise
from quillspark.llm.words import mix
from quillspark.state import scoped

#: Parts of a shard that are numbered apart.
BUCKETS = 2048


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash (Lamping and Veach 2014) of 64-bit keys, for all keys at once."""
    key = mix(np.asarray(keys, np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    bucket = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        bucket[live] = ahead[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[live] = ((bucket[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[ahead[live] < shards]
    return bucket


@scoped
def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""

    @F.pandas_udf("shard int, grown_shard int")
    def place(ids: pd.Series) -> pd.DataFrame:
        keys = ids.to_numpy(np.int64)
        return pd.DataFrame({"shard": jump_hash(keys, shards).astype(np.int32), "grown_shard": jump_hash(keys, shards + 1).astype(np.int32)})

    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    salt = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id() % BUCKETS)  # rows without an id may be many
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", salt), F.lit(BUCKETS)).cast("int"))
    rows = rows.withColumn("at", place(F.coalesce("doc_id", F.lit(-1)))).select("*", "at.shard", "at.grown_shard").drop("at")
    rows = materialise(rows, "placed")  # narrow, so the texts are read and hashed once for the offsets and the slots
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("n", F.row_number().over(within) - 1)
    placed = numbered.join(F.broadcast(offsets), ["shard", "bucket"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("n")).cast("long").alias("slot"), "grown_shard"
    )
