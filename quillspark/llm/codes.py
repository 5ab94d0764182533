"""Vector code compression: a codebook for each part of a vector, fitted by k-means with Exponion search, exact.

A vector of whole numbers is cut into equal parts; its code is the number of the nearest entry of each part's codebook. To
find it (Newling and Fleuret 2016), the search starts at the entry of the round before. With d the distance to that entry,
another entry can be as near only if the two entries are within 2 d of each other: the entry's neighbours, sorted by
distance, are scanned up to there. All distances are squared whole numbers (within 2 d is: 4 d * d or less), so nothing is rounded;
of equal distances the smaller index wins.

Defined cases: vectors that are null, of another length than dims, or with null or non-finite components are left out;
components beyond 2**27 after scaling count as that; rows of one vec_id are members each, and start as entries in the order of their components;
a null vec_id comes last; fewer vectors than entries make smaller codebooks; an unused entry stays; null labels are
one group; an empty table gives no rows; sums over the largest long are given as that. Only vec_id, label and the vector are read.

Scale: no shuffle of vectors. Each round is a map over the written rows, and the table of the round before is deleted; tasks
hand on a sum for each entry. Codebooks are parts * entries rows, which go to tasks in the function itself. Errors are
added up by label before they are joined, and both sides of that join are plain shuffles that AQE can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.frames import materialise, tune
from quillspark.llm.vectors import entry_means, packed, squared, unpacked, whole_vectors
from quillspark.state import scoped

DIMS, SCALE, PARTS, ENTRIES, ROUNDS = 64, 4096, 8, 16, 6
LONGEST = (1 << 63) - 1
RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def neighbours(books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part and entry: the other entries by (squared distance, index), and those distances."""
    parts, k, _ = books.shape
    gap = ((books[:, :, None, :] - books[:, None, :, :]) ** 2).sum(-1)
    gap[:, np.arange(k), np.arange(k)] = -1  # itself, left out as the first
    order = np.argsort(gap, axis=2, kind="stable")[:, :, 1:]
    return order, np.take_along_axis(gap, order, 2)


def nearest(x: np.ndarray, before: np.ndarray, books: np.ndarray, order: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry and its squared distance of each vector's parts (vectors, parts, width), from the entries before."""
    n, parts, width = x.shape
    x = x.reshape(n * parts, width)
    part, start = np.tile(np.arange(parts), n), before.reshape(-1).astype(np.int64)
    distance = squared(x, books[part, start])
    best, least = start.copy(), distance.copy()
    reach = (gap[part, start] <= 4 * distance[:, None]).sum(1)
    for step in range(int(reach.max(initial=0))):
        live = np.flatnonzero(reach > step)
        other = order[part[live], start[live], step]
        d = squared(x[live], books[part[live], other])
        better = (d < least[live]) | ((d == least[live]) & (other < best[live]))
        rows = live[better]
        best[rows], least[rows] = other[better], d[better]
    return best.reshape(n, parts), least.reshape(n, parts)


def _round(df: DataFrame, books: np.ndarray) -> DataFrame:
    """df (vec_id, label, v and, but for the first round, codes) with codes and error by these codebooks."""
    parts, _, width = books.shape
    order, gap = neighbours(books)
    first = "codes" not in df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unpacked(batch.column(2), "<i4").reshape(-1, parts, width)
            before = np.zeros((len(x), parts), np.uint8) if first else unpacked(batch.column(3), "u1")
            codes, error = nearest(x, before, books, order, gap)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed(codes.astype(np.uint8)), pa.array(error.sum(1))], names=["vec_id", "label", "v", "codes", "error"])

    rows = df.select("vec_id", "label", "v", *([] if first else ["codes"]))
    return rows.mapInArrow(run, df.select("vec_id", "label", "v").schema.add("codes", "binary").add("error", "long"))


@scoped
def compress_vectors(df: DataFrame, column: str = "embedding", dims: int = DIMS, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error of each vector, and the codebooks (parts, entries, width)."""
    if dims % parts or entries > 256:
        raise ValueError("parts must divide dims, and a code has two hexadecimal digits")
    spark = df.sparkSession
    tune(spark)
    now = materialise(whole_vectors(df, column, dims, scale, ["vec_id", "label"]), "vectors")
    first = now.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    width = dims // parts
    books = np.array([np.frombuffer(r.v, "<i4") for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    k = len(first)
    if not k:
        return now.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books

    def members(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return (unpacked(batch.column(0), "u1").astype(np.int64) + k * np.arange(parts)).reshape(-1), unpacked(batch.column(1), "<i4").reshape(-1, width)

    for turn in range(rounds + 1):
        now = materialise(_round(now, books), "codes", instead_of=now)
        if turn < rounds:
            means = entry_means(now.select("codes", "v"), members, parts * k, width)
            books = np.array([[means.get(p * k + e, books[p, e].tolist()) for e in range(k)] for p in range(parts)], np.int64)
    return now.select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error"), books


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


@scoped
def digest(df: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    rows, books = compress_vectors(df)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    by_label = materialise(rows.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "labels")
    joined = rows.join(by_label.hint("merge"), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _sql() -> str:
    ctes = [
        """e AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "q AS MATERIALIZED (SELECT r, p, v[8 * p + 1:8 * p + 8] AS x FROM (SELECT r, v, unnest(range(8)) AS p FROM e))",
        "c0 AS (SELECT p, c, x AS w FROM q JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS c FROM e ORDER BY vec_id LIMIT 16) USING (r))",
    ]
    for i in range(7):
        ctes.append(f"""a{i} AS MATERIALIZED (SELECT r, q.p, any_value(x) AS x,
  min((list_dot_product(x, x) - 2 * list_dot_product(x, w) + list_dot_product(w, w))::BIGINT * 16 + c) AS best FROM q JOIN c{i} ON q.p = c{i}.p GROUP BY r, q.p)""")
        if i < 6:
            ctes.append(f"""m{i} AS (SELECT p, c, list(((s - ((s % n) + n) % n) / n)::DOUBLE ORDER BY j) AS w FROM (
  SELECT p, best % 16 AS c, j, sum(y::BIGINT) AS s, count(*) AS n FROM (SELECT p, best, unnest(x) AS y, unnest(range(8)) AS j FROM a{i}) GROUP BY ALL) GROUP BY p, c)""")
            ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT a.p, a.c, coalesce(b.w, a.w) AS w FROM c{i} a LEFT JOIN m{i} b ON b.p = a.p AND b.c = a.c)")
    ctes.append("k AS (SELECT sha256(string_agg(array_to_string(list_transform(w, lambda x: x::BIGINT), ','), ',' ORDER BY p, c)) AS h FROM c6)")
    ctes.append("t AS (SELECT r, string_agg(printf('%02x', best % 16), '' ORDER BY p) AS code, sum(best // 16)::BIGINT AS error FROM a6 GROUP BY r)")
    return "WITH " + ",\n".join(ctes) + """
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM e JOIN t USING (r), k
"""


ORACLE_SQL = _sql()
