"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillspark.llm.frames import materialise


def _smallest(edges: DataFrame) -> DataFrame:
    """Each edge (a, b) with m, the smallest of a and its neighbours b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    least = materialise(least, "least")  # behind its grouping the join would keep that partitioning, and a hot node couldn't be split
    return edges.join(least.hint("merge"), F.col("a") == F.col("k")).select("a", "b", "m")


def _counted(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges, written, with their number and the sum of their hashes, both seen while they were written."""
    seen = Observation()
    out = materialise(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
    return out, seen.get


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, component): of every node of an edge, the smallest node it reaches. Each round is written and read again.

    Joins and minima only: minima are pre-aggregated and written, and both sides of a join are plain shuffles, which AQE can split.
    """
    now = edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).filter("a <> b").distinct()
    now, before = _counted(now)
    while before["n"]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = materialise(_smallest(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large")
        small = _smallest(large).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        last, (now, before) = before, _counted(small.filter("a <> b").distinct())
        if last == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
