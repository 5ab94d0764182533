"""Bounded, reproducible samples of labelled rows, for fitting classifiers on the driver.

The bounds, all of them parameters: rows a stratum, MAX_STRATA strata (those of the most rows), MAX_TEXT_BYTES a text (longer
texts aren't fitted; they are scored like any others) and MAX_BYTES in all (the rows that a hash of doc_id puts first).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 1_000_000
MAX_STRATA = 500
MAX_TEXT_BYTES = 1 << 20
MAX_BYTES = 24 << 20


def held_out(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % 3) == 1


def _spot() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(PARTS))


def sampled(rows: DataFrame, stratum: str, cap: int) -> DataFrame:
    """About cap rows (never over 1.2 times) of each value of stratum, chosen by a hash of doc_id."""
    counts = {r[0]: r[1] for r in rows.groupBy(stratum).count().orderBy(F.desc("count"), stratum).limit(MAX_STRATA).collect()}
    keep = F.lit(False)
    for value, n in counts.items():
        keep = keep | ((F.col(stratum) == F.lit(value)) & (_spot() < int(PARTS * min(1.0, cap / n))))
    return rows.filter(keep).withColumn("__spot", _spot()).orderBy("__spot", "doc_id").limit(int(1.2 * cap * max(1, len(counts)))).drop("__spot")


def fetch(docs: DataFrame, some: DataFrame, max_text_bytes: int = MAX_TEXT_BYTES, max_bytes: int = MAX_BYTES) -> pd.DataFrame:
    """docs' texts of the sampled rows some (doc_id and labels), within the bounds, on the driver, in an order that doesn't depend on the run.

    One row a doc_id, its shortest text, comes to the driver, however many rows have it: the sizes first, so that the driver takes no
    text over the bounds. some is bounded by sampled().
    """
    size = F.octet_length("text").cast("long")
    fits = docs.filter(F.col("text").isNotNull() & (size <= max_text_bytes))
    some = some.groupBy("doc_id").agg(*(F.min(c).alias(c) for c in some.columns if c != "doc_id"))
    least = F.min(F.struct(size.alias("size"), F.xxhash64("text").alias("hash")))
    sizes = fits.join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(least.alias("of"), F.first(_spot()).alias("spot")).select("doc_id", "of.*", "spot").toPandas()
    sizes = sizes.sort_values(["spot", "doc_id"], kind="stable")
    chosen = sizes[sizes["size"].cumsum() <= max_bytes][["doc_id", "size", "hash"]]
    if not len(chosen):
        return docs.join(some, "doc_id").limit(0).toPandas()
    ids = docs.sparkSession.createDataFrame([tuple(map(int, r)) for r in chosen.itertuples(index=False)], "doc_id long, size long, hash long")
    rows = fits.join(F.broadcast(ids), "doc_id").filter((size == F.col("size")) & (F.xxhash64("text") == F.col("hash")))
    rows = rows.groupBy("doc_id").agg(*(F.min(c).alias(c) for c in docs.columns if c != "doc_id"))
    return rows.join(F.broadcast(some), "doc_id").toPandas().sort_values(["doc_id"], kind="stable").reset_index(drop=True)
