"""Substring dedup: words inside a run of LENGTH words that a document of smaller doc_id has too are removed.

Seed and extend. Every LENGTH-word window is seeded by the smallest hash of its SEED-word grams (winnowing), a function of
its words alone, so equal windows have equal anchors. Consecutive windows with one anchor form a run, the stretch of words
in which a match on that anchor can lie; a run is one narrow row with a hash of its words. Runs of periodic text, which would be as
long as the text, are cut after every STRETCH windows; a piece is a run like any other.

1. Runs whose anchor stands in one document only are dropped.
2. Runs of one anchor and equal words match from end to end: all but the smallest document lose them.
3. Of runs of one anchor with different words, the smallest document of each kind is joined with the anchor's smallest
   document, and the match is extended from the anchor to the left and to the right, word by word, as far as both go on
   alike. What is LENGTH words or longer is a maximal repeat within the runs, and is lost by the greater document.
4. Windows of a run that the extension left over are in no run of the smallest document. Those of one anchor that are
   equal match each other: all but their smallest document lose them. So do all windows of an anchor that stands in its
   first run over REPEATS times (periodic text), instead of step 3.

Maximal repeats of neighbouring anchors overlap and are cut as one.

A removed word takes the white space behind it along; texts without a match stay as they are.

Defined cases: a null or empty text has no words and stays so; fewer than LENGTH words are never removed; matches within
one document don't count; rows of one doc_id may differ, each loses what a smaller doc_id has; a row without doc_id has
no order, so it loses nothing and takes nothing from others; an empty table gives no rows. Further columns pass
through dedup_documents() unchanged (n_chars is renewed).

Scale: the rows of step 1 are about one in 18 words and narrow; groupings are pre-aggregated and written before they are
joined, so both sides of a join are plain shuffles that AQE can split, and copies in any number cost in proportion. Texts are shuffled twice, by doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.frames import map_batches, materialise, tune
from quillspark.llm.words import Sums, Words, batches, find_words, mix, rolled, text_bytes
from quillspark.state import scoped

LENGTH = 50
SEED = 16
REPEATS = 8
#: Windows of a run at most.
STRETCH = 256
RUNS = "doc_id long, text_hash int, anchor long, extent long, start int, n int"
CONTEXTS = "anchor long, doc_id long, text_hash int, start int, n int, words binary"
MATCHES = "doc_id long, text_hash int, start int, n int, anchor long, window long"
U = np.uint64


def anchors(words: Words, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window that lies within one text: its first word, and its anchor."""
    n = len(words.hash) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    low = rolled(words.hash, seed)
    width, reach = length - seed + 1, 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if width > reach:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    at = np.flatnonzero(words.row[:n] == words.row[length - 1 :])
    return at, low[at]


def spans(words: Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words from start to end."""
    return mix(Sums.of_words(words.hash).hash(start, end) + (end - start).astype(U))


def _runs(docs: DataFrame, length: int, seed: int) -> DataFrame:
    def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out: list[pa.RecordBatch] = []
        for a, _, words in batches(batch.column(1)):
            at, anchor = anchors(words, length, seed)
            if not len(at):
                continue
            row = words.row[at]
            new = np.ones(len(at), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
            head = np.flatnonzero(new)
            within = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
            head = np.flatnonzero(within % STRETCH == 0)
            n = np.diff(np.append(head, len(at)))
            start = at[head]
            extent = spans(words, start, start + n + length - 1)
            out.append(pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(row[head] + a)) for c in (0, 2)), pa.array(anchor[head].view(np.int64)), pa.array(extent.view(np.int64)), pa.array((start - words.first[row[head]]).astype(np.int32)), pa.array(n.astype(np.int32))],
                names=[x.split()[0] for x in RUNS.split(", ")],
            ))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    return map_batches(docs.filter("doc_id is not null").select("doc_id", "text", F.hash("text")), each, RUNS)


def _contexts(docs: DataFrame, length: int) -> DataFrame:
    """The words' hashes of the runs in docs' column runs, a row each."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        runs = batch.column(3).flatten()
        of = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(3).offsets.to_numpy()))
        anchor, start, n = (runs.field(i).to_numpy() for i in range(3))
        out = []
        for a, b, words in batches(batch.column(2)):
            some = np.flatnonzero((of >= a) & (of < b))
            if not len(some):
                continue
            first = words.first[of[some] - a] + start[some]
            raw = [words.hash[i : i + k + length - 1].tobytes() for i, k in zip(first.tolist(), n[some].tolist(), strict=True)]
            row = pa.array(of[some])
            out.append(pa.RecordBatch.from_arrays(
                [pa.array(anchor[some]), batch.column(0).take(row), batch.column(1).take(row), pa.array(start[some]), pa.array(n[some]), pa.array(raw, pa.binary())], names=[x.split()[0] for x in CONTEXTS.split(", ")],
            ))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    return map_batches(docs.select("doc_id", "text_hash", "text", "runs"), each, CONTEXTS)


def extended(own: np.ndarray, other: np.ndarray, at: int, of: int) -> tuple[int, int]:
    """How many words before at and of are alike going left, and how many from there on going right."""
    k = min(at, of)
    left = own[at - k : at] != other[of - k : of]
    m = min(len(own) - at, len(other) - of)
    right = own[at : at + m] != other[of : of + m]
    return (int(left[::-1].argmax()) if left.any() else k), (int(right.argmax()) if right.any() else m)


def _extend(pairs: DataFrame, length: int, seed: int) -> DataFrame:
    """Of each run and the anchor's first run: maximal repeats (window null), and the windows that are in none (n null)."""

    def places(words: np.ndarray, anchor: np.uint64) -> np.ndarray:
        return np.flatnonzero(rolled(words, seed) == anchor)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        anchors_, docs_, hashes, starts, sizes = (batch.column(i).to_numpy() for i in range(5))
        first = batch.column(6).to_numpy()
        seeds = anchors_.view(U)
        rows: list[np.ndarray] = []
        windows: list[np.ndarray] = []
        known: tuple[bytes, np.ndarray, np.ndarray] | None = None
        for i in range(batch.num_rows):
            own, raw = np.frombuffer(batch.column(5)[i].as_buffer(), U), batch.column(7)[i].as_buffer().to_pybytes()
            if known is None or known[0] != raw:
                other = np.frombuffer(raw, U)
                known = (raw, other, places(other, seeds[i]))
            _, other, there = known
            n = int(sizes[i])
            covered = np.zeros(n, bool)
            if len(there) <= REPEATS:
                for at in places(own, seeds[i]).tolist():
                    for of in there.tolist():
                        left, right = extended(own, other, at, of)
                        if left + right >= length:
                            covered[at - left : at + right - length + 1] = True
            if docs_[i] > first[i] and covered.any():  # matches that overlap are one
                edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                begin, end = edges[::2], edges[1::2]
                rows.append(np.stack([np.full(len(begin), i), starts[i] + begin, end - begin], 1))
                windows.append(np.zeros(len(begin), U))
            rest = np.flatnonzero(~covered)
            if len(rest):
                rows.append(np.stack([np.full(len(rest), i), starts[i] + rest, np.zeros(len(rest), np.int64)], 1))
                windows.append(Sums.of_words(own).hash(rest, rest + length))
        if not rows:
            return None
        row, start, n = np.concatenate(rows).T
        window, rest = np.concatenate(windows).view(np.int64), n == 0
        return pa.RecordBatch.from_arrays(
            [pa.array(docs_[row]), pa.array(hashes[row]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32), mask=rest), pa.array(anchors_[row]), pa.array(window, mask=~rest)], names=[x.split()[0] for x in MATCHES.split(", ")],
        )

    return map_batches(pairs.select("anchor", "doc_id", "text_hash", "start", "n", "words", "first_doc", "first_words"), each, MATCHES)


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, start, n): n windows from word start on also stand in a document of smaller doc_id."""
    runs = materialise(_runs(docs, length, seed), "runs")
    groups = runs.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("extent").alias("low"), F.max("extent").alias("high"))
    groups = groups.filter("first < last").select("anchor", "first", (F.col("low") != F.col("high")).alias("mixed"))
    shared = materialise(runs.join(materialise(groups, "groups").hint("merge"), "anchor"), "shared")
    plain = shared.filter("not mixed and doc_id > first")
    mixed = shared.filter("mixed")
    classes = materialise(mixed.groupBy("anchor", "extent").agg(F.min("doc_id").alias("least")), "classes")
    mixed = materialise(mixed.join(classes.hint("merge"), ["anchor", "extent"]).select("doc_id", "text_hash", "anchor", "start", "n", "least"), "mixed")
    heads = mixed.filter("doc_id = least").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("anchor", "start", "n")).alias("runs"))
    texts = docs.select("doc_id", "text", F.hash("text").alias("text_hash"))
    contexts = materialise(_contexts(texts.join(heads.hint("merge"), ["doc_id", "text_hash"]), length), "contexts")
    firsts = materialise(contexts.groupBy("anchor").agg(F.min(F.struct("doc_id", "text_hash", "start")).alias("of")).select("anchor", "of.*"), "firsts")
    firsts = contexts.join(firsts.hint("merge"), ["anchor", "doc_id", "text_hash", "start"]).groupBy("anchor").agg(F.first("doc_id").alias("first_doc"), F.first("words").alias("first_words"))
    matches = materialise(_extend(contexts.join(materialise(firsts, "firsts").hint("merge"), "anchor"), length, seed), "matches")
    rest = matches.filter("n is null")
    least = materialise(rest.groupBy("anchor", "window").agg(F.min("doc_id").alias("least")), "least")
    single = rest.join(least.hint("merge"), ["anchor", "window"]).filter("doc_id > least").withColumn("n", F.lit(1))
    out = [d.select("doc_id", "text_hash", "start", "n") for d in (plain, mixed.filter("doc_id > least"), matches.filter("n is not null"), single)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def cut(texts: pa.Array, marks: pa.Array, length: int) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
    """Texts without the words that their marks (start, n) cover, and the counts of words and removed words."""
    kept: list[bytes | None] = []
    n_words, n_removed = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    offsets = np.asarray(marks.offsets)
    pairs = marks.flatten()
    start, n = (pairs.field(i).to_numpy(zero_copy_only=False) for i in range(2))
    offsets, holds = offsets - offsets[0], np.asarray(marks.is_valid())
    for i, text in enumerate(texts):
        raw = text.as_buffer().to_pybytes() if text.is_valid else None
        if raw is None or not holds[i] or offsets[i] == offsets[i + 1]:
            n_words[i] = len(raw.split()) if raw else 0
            kept.append(raw)
            continue
        words = find_words(*text_bytes(pa.array([raw], pa.binary())), hashed=False)
        m = len(words.start)
        cover = np.zeros(m + 1, np.int64)
        a = start[offsets[i] : offsets[i + 1]].astype(np.int64)
        np.add.at(cover, np.minimum(a, m), 1)
        np.add.at(cover, np.minimum(a + n[offsets[i] : offsets[i + 1]] + length - 1, m), -1)
        gone = np.cumsum(cover[:-1]) > 0
        n_words[i], n_removed[i] = m, gone.sum()
        edges = np.append(words.start, len(raw))
        flips = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        parts, at = [], 0
        for f, t in zip(flips[::2].tolist(), flips[1::2].tolist(), strict=True):
            parts.append(raw[at : edges[f]])
            at = int(edges[t])
        parts.append(raw[at:])
        kept.append(b"".join(parts))
    return kept, n_words, n_removed


@scoped
def dedup_documents(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """docs with text cut, and the columns __n_words and __n_removed."""
    tune(docs.sparkSession)
    marks = repeats(docs, length, seed).groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_set(F.struct("start", "n")).alias("__marks"))
    joined = docs.join(marks.hint("merge"), (F.col("doc_id") == F.col("__id")) & (F.hash("text") == F.col("__hash")), "left").drop("__id", "__hash")
    names = docs.columns
    at = names.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("__n_words", T.LongType()), T.StructField("__n_removed", T.LongType())])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, n_words, n_removed = cut(batch.column(at), batch.column(len(names)), length)
        columns = [*batch.columns[: len(names)], pa.array(n_words), pa.array(n_removed)]
        columns[at] = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    out = map_batches(joined, each, schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("__n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, and the SHA-256 of the kept words with single spaces."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        import hashlib

        digests = [hashlib.sha256(b" ".join(t.as_buffer().to_pybytes().split()) if t.is_valid else b"").hexdigest() for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = dedup_documents(docs.select("doc_id", "text"), length).select("doc_id", "text", "__n_words", "__n_removed")
    return map_batches(rows, each, "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)
), m AS (
  SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY h) AS hit FROM g
), r AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM m WHERE hit
), k AS (
  SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id
), o AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
    list_filter(ws, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)) AS kept
  FROM w LEFT JOIN k ON k.doc_id = w.doc_id
)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM o
"""
