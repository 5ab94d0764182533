"""Vectors as whole numbers: rows of packed 32-bit components, exact distances, and sums by entry.

Components are clipped to LIMIT either way, so that a squared distance of 64 components fits 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.frames import tune

LIMIT = 1 << 27
#: Up to here all terms of an inner product of 64 components, and their sum, are exact in doubles.
EXACT = 1 << 22


def integers(vectors: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows whose vectors have dims components, none null or non-finite, and floor(scale * component) of them."""
    offsets = vectors.offsets.to_numpy()
    rows = np.flatnonzero((np.diff(offsets) == dims) & np.asarray(vectors.is_valid()))
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    x = values[offsets[rows][:, None] + np.arange(dims)]
    fine = np.isfinite(x).all(1)
    with np.errstate(over="ignore"):
        whole = np.floor(x[fine] * scale)
    return rows[fine], np.clip(whole, -LIMIT, LIMIT).astype(np.int32)


def packed(matrix: np.ndarray) -> pa.Array:
    """A binary row for each row of the matrix."""
    matrix = np.ascontiguousarray(matrix)
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * (matrix.shape[1] * matrix.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(ends), pa.py_buffer(matrix.tobytes())])


def unpacked(rows: pa.Array, kind: str) -> np.ndarray:
    """The matrix of binary rows of one length."""
    ends = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1]
    data = rows.buffers()[2] or b""
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(rows), -1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of a's rows to b, or to b's rows."""
    apart = a.astype(np.int64) - b
    return (apart * apart).sum(-1)


def squared_all(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each centroid."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) > EXACT:
        return np.stack([squared(v, c) for c in centroids], 1)
    x, c = v.astype(np.float64), centroids.astype(np.float64)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)


def whole_vectors(df: DataFrame, column: str, dims: int, scale: int, keep: list[str]) -> DataFrame:
    """keep and v, the packed whole components, of the rows whose vectors can be used."""
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, matrix = integers(batch.column(len(keep)), dims, scale)
            if len(rows):
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(keep))), packed(matrix)], names=[*keep, "v"])

    chosen = df.select(*keep, column)
    return chosen.mapInArrow(run, chosen.drop(column).schema.add("v", "binary"))


def entry_means(df: DataFrame, entries: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], n_entries: int, width: int) -> dict[int, list[int]]:
    """floor(sum / count) of each component, for each entry that has members. entries: of a batch, the entries and their members' components.

    A task adds up its rows and hands on n_entries rows at most; the driver gets n_entries * width numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((n_entries, width), np.int64), np.zeros(n_entries, np.int64)
        for batch in batches:
            entry, parts = entries(batch)
            order = np.argsort(entry, kind="stable")
            ranked = entry[order]
            head = np.flatnonzero(np.diff(ranked, prepend=-1))
            sums[ranked[head]] += np.add.reduceat(parts[order].astype(np.int64), head, axis=0)
            counts += np.bincount(entry, minlength=n_entries)
        some = np.flatnonzero(counts)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["entry", "n", "sums"])

    parts = df.mapInArrow(run, "entry long, n long, sums array<long>").select("entry", "n", F.posexplode("sums").alias("at", "part"))
    out: dict[int, list[int]] = {}
    for r in parts.groupBy("entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect():
        out.setdefault(r.entry, [0] * width)[r.at] = int(r.total) // r.n
    return out
