"""Mixing sources to target weights: a hash-random order in each source, distributed prefix sums of words, an exact cut.

1. Sources in the order of code points (null last) weigh by turns as WEIGHTS says and share SHARE of all words by weight. A target over
   REPEAT times its source's words stops there, and the excess is shared by weight among the others, until none is above:
   target = min(level * weight, REPEAT * words), where the level makes the targets add up.
2. Rows get a key, the MD5 of doc_id and text, and are range-sorted by (source, key). A task adds up the words of its rows source by
   source; the sums of the tasks before it, source by source, come from a narrow table.
3. A source's budget is its target without the fraction. All rows are taken once for each whole time that the source's words go into
   the budget; what is left of the budget is cut from the front of the order, within a row if need be.

So each source gives its budget to the word, no row is taken over REPEAT times, and the same rows give the same mix.

Defined cases: a null text has no words (size 0); a source without words has the target 0; rows of one doc_id are rows of
their own; rows that are alike in doc_id, source and text are interchangeable; null doc_ids are keyed by their text; a null source is a source;
an empty table gives no rows. Only doc_id, text and source are read, so further columns do no harm.

Scale: texts are read once, for the size and the key, and only narrow rows are sorted and written. A source of any share of the rows
lies in as many ranges as it needs, since keys are random. The level is found with a few sums over the table of sources, which
isn't collected: the driver sees two numbers a round. Sums by (range, source) are at most ranges + sources rows; they are joined in a plain shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.frames import materialise, tune
from quillspark.state import scoped

WEIGHTS, SHARE, REPEAT = (3, 1, 2), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
SORTED = "doc_id long, source string, size long, part int, ahead long"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))


def numbered(sources: DataFrame) -> DataFrame:
    """sources with rank, their number from 0 in the order of source, nulls last: counted within ranges, then offset by range."""
    ranged = sources.repartitionByRange(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "ranged")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("offset"))  # a row a range
    within = Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))
    return ranged.join(F.broadcast(offsets), "part").withColumn("rank", F.col("offset") + F.row_number().over(within) - 1).drop("part", "offset")


@scoped
def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """source, words, target, from source and words, a row a source."""
    if share > repeat:
        raise ValueError("the share can't be met if every source stops below it")
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    known = materialise(numbered(sources).select("source", "words", turn.alias("weight"), (F.col("words") * repeat).cast("double").alias("most")), "sources")
    total = float(known.agg(F.sum("words")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        above = F.col("most") < F.col("weight") * F.lit(level)
        n, fixed, weight = known.agg(F.count(F.when(above, 1)), F.sum(F.when(above, F.col("most")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if n == capped or not weight:
            break
        level, capped = (total - fixed) / weight, n
    return known.select("source", "words", F.least(F.col("weight") * F.lit(level), "most").alias("target"))


def _running(rows: DataFrame) -> DataFrame:
    """Of rows sorted within their ranges: part, the range, and ahead, the words of the same source before a row in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            source, size = batch.column(1), batch.column(2).to_numpy()
            codes = source.dictionary_encode("encode").indices.to_numpy()
            head = np.flatnonzero(np.diff(codes, prepend=codes[0] - 1))
            total = np.concatenate([[0], np.cumsum(size)])
            start = total[head] - np.where(np.arange(len(head)) == 0, before if source[0].as_py() == last else 0, 0)
            ahead = total[:-1] - np.repeat(start, np.diff(np.append(head, len(codes))))
            last, before = source[-1].as_py(), int(ahead[-1] + size[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ahead)], names=[x.split()[0] for x in SORTED.split(", ")])

    return rows.withColumn("part", F.spark_partition_id()).mapInArrow(run, SORTED)


@scoped
def mix_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    tune(docs.sparkSession)
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), key_of(F.col("doc_id"), F.col("text")).alias("key"), F.monotonically_increasing_id().alias("row"))
    rows = materialise(rows, "keyed")  # narrow, so the texts are read once for the ranges and the sort
    order = [F.asc_nulls_last("source"), "key", "row"]  # row deals out rows that are alike
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "source", "size")
    ranged = materialise(_running(ranged), "ranged")
    sums = materialise(ranged.groupBy("part", "source").agg(F.sum("size").alias("words")), "sums")
    shares = materialise(targets(sums.groupBy("source").agg(F.sum("words").alias("words")), weights, share, repeat), "targets")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", "source", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    shares = shares.select(F.col("source").alias("of"), F.col("words").alias("source_size"), "target")
    offsets = offsets.join(shares, F.col("source").eqNullSafe(F.col("of"))).select(F.col("part").alias("range"), "of", "offset", "source_size", "target")
    offsets = materialise(offsets, "offsets")
    joined = ranged.join(offsets.hint("merge"), (F.col("part") == F.col("range")) & F.col("source").eqNullSafe(F.col("of")))
    budget = F.floor("target").cast("long")
    whole = F.coalesce(F.try_divide(budget - F.pmod(budget, F.col("source_size")), F.col("source_size")), F.lit(0)).cast("long")
    left = budget - whole * F.col("source_size") - F.col("offset") - F.col("ahead")
    taken = whole * F.col("size") + F.least(F.greatest(left, F.lit(0)), F.col("size"))
    return joined.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS k
  FROM documents
), s AS (
  SELECT source, words, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight
  FROM (SELECT source, sum(size)::BIGINT AS words FROM d GROUP BY source)
), r AS (
  SELECT *, row_number() OVER w AS n, coalesce(sum(2 * words) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM s WINDOW w AS (ORDER BY 2 * words / weight, source NULLS LAST)
), l AS (
  SELECT (1.5 * (SELECT sum(words) FROM s) - fixed)::DOUBLE / open AS level FROM r
  WHERE 2 * words / weight >= (1.5 * (SELECT sum(words) FROM s) - fixed)::DOUBLE / open ORDER BY n LIMIT 1
), t AS (
  SELECT source, words, least(weight * level, (2 * words)::DOUBLE) AS target FROM s, l
), p AS (
  SELECT doc_id, size, words, target, floor(target)::BIGINT AS budget,
    (sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, words AS source_size, target,
  CASE WHEN words = 0 THEN 0 ELSE (budget // words) * size + least(greatest(budget - (budget // words) * words - before, 0), size) END::BIGINT AS taken
FROM p
"""
