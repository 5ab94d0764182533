"""Centroid clustering with Drake's adaptive bounds (Drake and Hamerly 2012), exact.

Each vector keeps an upper bound on the distance to its centroid, the numbers of the next nearest centroids in order with a
lower bound for each, and one more lower bound for all the others. When centroids move, the bounds move by as much.

1. If the upper bound is under all lower bounds, the vector stays. Else its own distance is computed, and compared again.
2. Else the listed centroids' distances are computed one after the other, nearest first. Once the best of them is under all bounds
   that are left, their order is certain, and only they are ranked anew.
3. A vector that no listed rank can certify is compared with all centroids.

Distances are whole numbers. Bounds are rounded outwards and have to be strictly less, so a tie is never certified: it is
computed, and the smaller number wins. The list is adapted: it shrinks to the deepest rank that was of use in a round.

Defined cases: vectors that are null, of another length, or with null or non-finite components are left out; components
beyond 2**27 after scaling count as that; rows of one vec_id are members each, and start as centroids in the order of their
components; a null vec_id starts as a centroid only if there aren't enough others; fewer vectors than k are as many centroids; an
empty table gives no rows; sums over the largest long are given as that. Only vec_id and the vector are read, so further columns do no harm.

Scale: no shuffle of vectors. Each round is a map over the written rows, and the table of the round before is deleted; tasks
hand on k sums at most. The driver holds k centroids, which go to tasks in the function itself.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillspark.llm.frames import materialise, tune
from quillspark.llm.vectors import entry_means, packed, squared, squared_all, unpacked, whole_vectors
from quillspark.state import scoped

DIMS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
EPS = 1e-12
LONGEST = (1 << 63) - 1
STATE = "vec_id long, v binary, cluster int, upper double, near binary, lower binary, depth int, distance long"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def above(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64)) * (1 + EPS)


def below(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64)) * (1 - EPS)


@dataclass
class Bounds:
    """Of vectors: their cluster, the upper bound, the next nearest centroids, their lower bounds and that of the rest.

    depth tells how many listed centroids were looked at in the last round; one more than are listed if all centroids were.
    """

    cluster: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    depth: np.ndarray

    def shortened(self, size: int) -> Bounds:
        """With a list of size centroids; what falls off joins the rest."""
        if self.near.shape[1] <= size:
            return self
        rest = self.lower[:, size:].min(1, keepdims=True)
        return Bounds(self.cluster, self.upper, self.near[:, :size].copy(), np.concatenate([self.lower[:, :size], rest], 1), self.depth)


def compared_with_all(v: np.ndarray, centroids: np.ndarray, size: int) -> Bounds:
    square = squared_all(v, centroids)
    order = np.argsort(square, axis=1, kind="stable")[:, : size + 2]
    ranked = np.take_along_axis(square, order, 1)
    lower = np.full((len(v), size + 1), np.inf)
    lower[:, : ranked.shape[1] - 1] = below(ranked[:, 1:])
    return Bounds(order[:, 0].astype(np.int32), above(ranked[:, 0]), order[:, 1 : size + 1].astype(np.int32), lower, np.full(len(v), size + 1, np.int32))


def moved(v: np.ndarray, old: Bounds, centroids: np.ndarray, drift: np.ndarray) -> Bounds:
    """The bounds after the centroids have moved by drift at most to where they are now."""
    size = old.near.shape[1]
    cluster, near = old.cluster.copy(), old.near.copy()
    upper = (old.upper + drift[cluster]) * (1 + EPS)
    shift = np.concatenate([drift[near], np.full((len(v), 1), drift.max(initial=0))], 1)
    lower = old.lower - shift
    fine = np.isfinite(lower)
    lower[fine] -= EPS * (np.abs(old.lower[fine]) + shift[fine])
    depth = np.zeros(len(v), np.int32)
    left = np.minimum.accumulate(lower[:, ::-1], axis=1)[:, ::-1]  # the least bound of each rank and those behind it
    todo = np.flatnonzero(~(upper < left[:, 0]))
    exact = np.zeros((len(todo), size + 1), np.int64)
    if len(todo):
        exact[:, 0] = squared(v[todo], centroids[cluster[todo]])
        upper[todo] = above(exact[:, 0])
        open_ = ~(upper[todo] < left[todo, 0])
        todo, exact = todo[open_], exact[open_]
    for j in range(1, size + 1):
        if not len(todo):
            break
        exact[:, j] = squared(v[todo], centroids[near[todo, j - 1]])
        sure = above(exact[:, : j + 1].min(1)) < left[todo, j]
        rows = todo[sure]
        if len(rows):
            ids = np.concatenate([cluster[rows, None], near[rows, :j]], 1)
            order = np.lexsort((ids, exact[sure, : j + 1]), axis=-1)
            ids, ranked = np.take_along_axis(ids, order, 1), np.take_along_axis(exact[sure, : j + 1], order, 1)
            cluster[rows], near[rows, :j] = ids[:, 0], ids[:, 1:]
            upper[rows], lower[rows, :j] = above(ranked[:, 0]), below(ranked[:, 1:])
            depth[rows] = j
            todo, exact = todo[~sure], exact[~sure]
    if len(todo):
        new = compared_with_all(v[todo], centroids, size)
        cluster[todo], upper[todo], near[todo], lower[todo], depth[todo] = new.cluster, new.upper, new.near, new.lower, new.depth
    return Bounds(cluster, upper, near, lower, depth)


def _round(df: DataFrame, centroids: np.ndarray, drift: np.ndarray | None, size: int, last: bool) -> DataFrame:
    """The state after assigning all vectors; drift is None in the first round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = unpacked(batch.column(1), "<i4")
            if drift is None:
                new = compared_with_all(v, centroids, size)
            else:
                old = Bounds(batch.column(2).to_numpy(), batch.column(3).to_numpy(), unpacked(batch.column(4), "<i4"), unpacked(batch.column(5), "<f8"), np.zeros(0))
                new = moved(v, old.shortened(size), centroids, drift)
            distance = squared(v, centroids[new.cluster]) if last else np.zeros(len(v), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(new.cluster), pa.array(new.upper), packed(new.near), packed(new.lower), pa.array(new.depth), pa.array(distance)], names=[x.split()[0] for x in STATE.split(", ")]
            )

    return df.mapInArrow(run, STATE)


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors of the smallest SHA-256 of salt and vec_id."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select("v", digest.alias("digest")).orderBy(F.asc_nulls_last("digest"), "v").limit(k).collect()
    return np.stack([np.frombuffer(r.v, "<i4") for r in rows]).astype(np.int64) if rows else np.zeros((0, 1), np.int64)


@scoped
def cluster_vectors(df: DataFrame, column: str = "embedding", dims: int = DIMS, scale: int = SCALE, k: int = CLUSTERS, rounds: int = ROUNDS, salt: str = "1:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = df.sparkSession
    tune(spark)
    now = materialise(whole_vectors(df, column, dims, scale, ["vec_id"]), "vectors")
    centroids = first_centroids(now, k, salt)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], RESULT)
    size, drift = min(max(2, k // 4), k - 1), None
    for turn in range(rounds + 1):
        seen = Observation()
        state = _round(now, centroids, drift, size, turn == rounds)
        now = materialise(state.observe(seen, F.max(F.when(F.col("depth") <= size, F.col("depth"))).alias("depth")), "state", instead_of=now)
        if turn == rounds:
            break
        if drift is not None:
            size = min(size, max(seen.get["depth"] or 0, k // 8, 1))
        means = entry_means(now.select("cluster", "v"), lambda b: (b.column(0).to_numpy(), unpacked(b.column(1), "<i4")), k, dims)
        new = np.array([means.get(i, centroids[i].tolist()) for i in range(k)], np.int64)
        drift = np.array([math.sqrt(int(x)) * (1 + EPS) for x in squared(new, centroids)])
        centroids = new
    inertia = {r.cluster: int(r.total) for r in now.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    fits = lambda n: min(n, LONGEST)
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    told = spark.createDataFrame([(i, fits(n), fits(sum(inertia.values())), digest(centroids[i])) for i, n in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return now.select("vec_id", "cluster", "distance").join(F.broadcast(told), "cluster").select(*(x.split()[0] for x in RESULT.split(", ")))  # told has k rows


def _sql() -> str:
    ctes = [
        """e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v AS w FROM e ORDER BY c LIMIT 16)",
    ]
    for i in range(4):
        ctes.append(f"""a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v,
  min((list_dot_product(v, v) - 2 * list_dot_product(v, w) + list_dot_product(w, w))::BIGINT * 16 + c) AS best FROM e, c{i} GROUP BY r)""")
        if i < 3:
            ctes.append(f"""m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) / n)::DOUBLE ORDER BY j) AS w FROM (
  SELECT best % 16 AS c, j, sum(x::BIGINT) AS s, count(*) AS n FROM (SELECT best, unnest(v) AS x, unnest(range(64)) AS j FROM a{i}) GROUP BY ALL) GROUP BY c)""")
            ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.w, c{i}.w) AS w FROM c{i} LEFT JOIN m{i} ON m{i}.c = c{i}.c)")
    return "WITH " + ",\n".join(ctes) + """
SELECT vec_id, c::INTEGER AS cluster, best // 16 AS distance, sum(best // 16) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(best // 16) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(list_transform(w, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a3 JOIN c3 ON c = best % 16
"""


ORACLE_SQL = _sql()
