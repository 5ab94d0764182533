"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND, then verified.

Every text is cut into passages of PASSAGE words that overlap by half, and every passage is a query. A passage's score
for an item is the BM25 sum over their common words, divided by the item's score for its own text, so one threshold
suits all items; an item longer than a passage is indexed in pieces of a passage's length.

Entries are numbered by their own scores and cut into tiers in which these differ by TIER at most, so a word's weights in
a tier are alike and its maximum there is tight. A tier is searched for a passage if its words' maxima in the tier reach
the threshold. The search is block-max WAND: a cursor stands in each word's postings; the pivot is the entry at which the
maxima of the words that come first reach the threshold; if the maxima of the pivot's block of BLOCK entries do so too,
the cursors move to the pivot and it is scored, else they skip the block. The passages of a slice step together as rows
of a matrix. Bounds never fall short of a score, so no passage over the threshold is lost.

A retrieved pair is verified on words, its passages over the threshold in falling order of their scores until one passes: the item's question and answer must both be there, each with at least
min_overlap of its word 3-grams around the passage; of a part of fewer than SHORT words the share of its words counts
if it is greater, as one changed word spoils most of its 3-grams, but then two fifths of all the item's 3-grams must be there. An item with columns question and answer has them as they are; a
text alone is split at its last sentence end past the middle, or else at two thirds of its words.

Defined cases: a null or empty text or item matches nothing; items without words are left out; repeated rows get equal
results; empty tables give no rows. Only doc_id and text, and item_id, text (or question and answer), are read.

Scale: no shuffle of texts. The index goes out as a broadcast; items of over SET_BYTES are dealt by a hash to sets of about
that size, and each set is one more pass over the texts. Word statistics are always of all items; for several sets they are
a grouped table, and one set at a time is held by the driver and sent out. An item is one row and must fit in a set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.frames import map_batches, materialise, tune, with_columns
from quillspark.llm.toxicity import NOT_WORD
from quillspark.llm.words import find_words, rolled, slices, text_bytes
from quillspark.state import scoped

PASSAGE = 64
BLOCK = 16
TIER = 1.1
SET_BYTES = 24 << 20
END = np.int64(1) << np.int64(40)
K1, B = 1.2, 0.75
GRAM = 3
SHORT = 10
FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
U = np.uint64


def split_item(text: str) -> tuple[str, str]:
    """(question, answer) of an item that is one text."""
    ends = [m.end() for m in regex.finditer(r"[.?!]\s|\n", text) if len(text) / 2 <= m.end() < len(text)]
    if ends:
        return text[: ends[-1]], text[ends[-1] :]
    words = text.split()
    at = max(1, 2 * len(words) // 3)
    return " ".join(words[:at]), " ".join(words[at:])


def _hashes(text: str) -> np.ndarray:
    return find_words(*text_bytes(pa.array([text])), lower=True, space=NOT_WORD).hash


@dataclass
class Index:
    """Terms are sorted by hash. postings of term t: items[at[t]:at[t+1]] with weights, in shares of an entry's own score.

    A list is a term's postings in one tier: those of term t are lists[t] to lists[t+1], each from begin to stop of the
    postings, with the greatest weight peak. block_most has the greatest weight of each list in each block that it is in,
    sorted by block_keys (list * blocks + block). ids, parts and sizes are of the item that an entry belongs to.
    """

    ids: np.ndarray
    terms: np.ndarray
    at: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    most: np.ndarray
    keys: np.ndarray
    lists: np.ndarray
    term_of: np.ndarray
    tier: np.ndarray
    begin: np.ndarray
    stop: np.ndarray
    peak: np.ndarray
    blocks: int
    block_keys: np.ndarray
    block_most: np.ndarray
    parts: list[tuple[np.ndarray, np.ndarray]]
    sizes: np.ndarray


@dataclass
class Statistics:
    """Of all items: the words' hashes, sorted, the number of entries that each is in, the number of entries and of their words."""

    terms: np.ndarray
    df: np.ndarray
    entries: int
    words: int


def _entries(items: pd.DataFrame) -> list[tuple]:
    entries = []  # (item_id, question, answer, words): an item of more than PASSAGE words has an entry for each PASSAGE of them
    for r in items.to_dict("records"):
        question, answer = (r.get("question") or "", r.get("answer") or "") if "question" in r else split_item(r["text"] or "")
        q, a = _hashes(question), _hashes(answer)
        both = np.concatenate([q, a])
        starts = range(0, len(both) - PASSAGE, PASSAGE) if len(both) > PASSAGE else ()
        entries += [(r["item_id"], q, a, both[at : at + PASSAGE]) for at in (*starts, *([max(0, len(both) - PASSAGE)] if len(both) else []))]
    return entries


def statistics(items: pd.DataFrame) -> Statistics:
    entries = [e[3] for e in _entries(items)]
    terms, df = np.unique(np.concatenate([np.zeros(0, U), *map(np.unique, entries)]), return_counts=True)
    return Statistics(terms, df, len(entries), sum(map(len, entries)))


def build_index(items: pd.DataFrame, of: Statistics | None = None) -> Index | None:
    """The index of items (item_id; text, or question and answer), weighted by the statistics of all items if these are some of them."""
    entries = _entries(items)
    if not entries:
        return None
    of = of or statistics(items)
    sizes = np.array([len(e[3]) for e in entries])
    words = np.concatenate([e[3] for e in entries])
    owner = np.repeat(np.arange(len(entries)), sizes)
    terms, term_of = np.unique(words, return_inverse=True)
    pairs, tf = np.unique(term_of * len(entries) + owner, return_counts=True)
    term, item = pairs // len(entries), pairs % len(entries)
    df = of.df[np.searchsorted(of.terms, terms)]
    idf = np.maximum(np.log((of.entries - df + 0.5) / (df + 0.5)), 0.01)
    weights = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[item] * of.entries / of.words))
    own = np.bincount(item, weights=weights)
    weights = (weights / own[item]).astype(np.float32)
    order = np.argsort(own, kind="stable")
    entries, place = [entries[i] for i in order], np.argsort(order)
    item = place[item]
    order = np.lexsort((item, term))
    term, item, weights = term[order], item[order], weights[order]
    tier = np.floor(np.log(np.sort(own) / own.min()) / np.log(TIER) + 1e-9).astype(np.int64)[item]
    heads = lambda *columns: np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))
    begin = heads(term, tier)
    stop = np.append(begin[1:], len(term))
    of_list = np.repeat(np.arange(len(begin)), stop - begin)
    blocks = len(entries) // BLOCK + 1
    block_keys = of_list * blocks + item // BLOCK
    first = heads(block_keys)
    at = np.searchsorted(term, np.arange(len(terms) + 1))
    return Index(
        np.array([e[0] for e in entries]), terms, at, item, weights, np.maximum.reduceat(weights, at[:-1]), term * len(entries) + item, np.searchsorted(term[begin], np.arange(len(terms) + 1)), term[begin], tier[begin], begin, stop,
        np.maximum.reduceat(weights, begin), blocks, block_keys[first], np.maximum.reduceat(weights, first), [(e[1], e[2]) for e in entries], np.array([len(e[1]) + len(e[2]) for e in entries]),
    )


def _grams(hashes: np.ndarray) -> np.ndarray:
    return np.unique(rolled(hashes, GRAM))


def overlaps(parts: tuple[np.ndarray, ...], text: np.ndarray) -> tuple[list[float], float]:
    """For each part (its words' hashes) the share of it in the text, and the share of all the parts' 3-grams."""
    near = _grams(text)
    grams = [_grams(p) for p in parts]
    found = [np.isin(g, near) for g in grams]
    shares = []
    for part, hits in zip(parts, found, strict=True):
        share = float(hits.mean()) if len(hits) else 0.0
        if not len(part):
            share = 1.0
        elif len(part) < SHORT:
            share = max(share, float(np.isin(np.unique(part), text).mean()))
        shares.append(share)
    total = sum(map(len, grams))
    return shares, sum(int(h.sum()) for h in found) / total if total else 1.0


def wand(index: Index, lists: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, entry, score) of all entries of at least the threshold; a row of lists holds the lists of one query, -1 where it has fewer."""
    n, out = len(index.ids), []
    real, limit = lists >= 0, threshold - 1e-5
    lists = np.maximum(lists, 0)
    term, stop, peak = index.term_of[lists] * n, np.where(real, index.stop[lists], 0), np.where(real, index.peak[lists], 0)
    cursor, rows = index.begin[lists], np.arange(len(lists))

    def entry(cursor: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return np.where(cursor < stop, index.items[np.minimum(cursor, len(index.items) - 1)], END)

    now = entry(cursor, stop)
    while len(rows):
        order = np.argsort(now, axis=1)
        reach = np.cumsum(np.take_along_axis(np.where(now < END, peak, 0), order, 1), 1)
        live = np.flatnonzero(reach[:, -1] >= limit)
        if len(live) < len(rows):
            rows, lists, term, stop, peak, cursor, now, order, reach = (x[live] for x in (rows, lists, term, stop, peak, cursor, now, order, reach))
            if not len(rows):
                break
        each = np.arange(len(rows))
        pivot = now[each, order[each, (reach >= limit).argmax(1)]]
        block = pivot // BLOCK
        r, c = np.nonzero(now <= pivot[:, None])
        wanted = lists[r, c] * index.blocks + block[r]
        near = np.minimum(np.searchsorted(index.block_keys, wanted), len(index.block_keys) - 1)
        bound = np.bincount(r, weights=np.where(index.block_keys[near] == wanted, index.block_most[near], 0), minlength=len(rows))
        open_ = bound >= limit
        beyond = np.where(now > pivot[:, None], now, END).min(1)
        to = np.where(open_, pivot, np.minimum((block + 1) * BLOCK, beyond))
        behind = now[r, c] < to[r]
        r2, c2 = r[behind], c[behind]
        cursor[r2, c2] = np.searchsorted(index.keys, term[r2, c2] + to[r2])
        now[r2, c2] = entry(cursor[r2, c2], stop[r2, c2])
        met = open_[r] & (now[r, c] == pivot[r])
        r, c = r[met], c[met]
        score = np.bincount(r, weights=index.weights[cursor[r, c]], minlength=len(rows))
        hit = np.flatnonzero(open_ & (score >= threshold))
        out.append((rows[hit], pivot[hit], score[hit]))
        cursor[r, c] += 1
        now[r, c] = entry(cursor[r, c], stop[r, c])
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of size numbers each, end to end."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def find(index: Index, data: np.ndarray, offsets: np.ndarray, threshold: float, min_overlap: float) -> list[tuple[int, int, float, float, float, int]]:
    """(row, item's place, score, question overlap, answer overlap, first word of the passage), the best passage of each pair that is verified."""
    words = find_words(data, offsets, lower=True, space=NOT_WORD)
    if not len(words.hash):
        return []
    near = np.minimum(np.searchsorted(index.terms, words.hash), len(index.terms) - 1)
    term = np.where(index.terms[near] == words.hash, near, -1)
    bound = np.where(term >= 0, index.most[term], 0).astype(np.float64)
    first = words.first
    counts = np.diff(first)
    half = PASSAGE // 2
    n_passages = np.where(counts > 0, np.maximum(1, -(-(counts - half) // half)), 0)
    row = np.repeat(np.arange(len(counts)), n_passages)
    begin = first[row] + half * (np.arange(len(row)) - np.repeat(np.cumsum(n_passages) - n_passages, n_passages))
    end = np.minimum(begin + PASSAGE, first[row + 1])
    sums = np.concatenate([[0.0], np.cumsum(bound)])
    hot = np.flatnonzero(sums[end] - sums[begin] >= threshold - 1e-5)
    tiers = int(index.tier.max()) + 1
    over = []  # (passages, their items, their scores) over the threshold
    for part in np.array_split(hot, max(1, len(hot) // 2048)):
        if not len(part):
            continue
        sizes = end[part] - begin[part]
        owner, t = np.repeat(np.arange(len(part)), sizes), term[_spread(begin[part], sizes)]
        pair = np.unique(owner[t >= 0].astype(np.int64) * len(index.terms) + t[t >= 0])
        owner, t = pair // len(index.terms), pair % len(index.terms)
        n_lists = index.lists[t + 1] - index.lists[t]
        lists = _spread(index.lists[t], n_lists)
        query = np.repeat(owner, n_lists) * tiers + index.tier[lists]
        reach = np.bincount(query, weights=index.peak[lists], minlength=len(part) * tiers)
        live = reach[query] >= threshold - 1e-5
        query, lists = query[live], lists[live]
        if not len(lists):
            continue
        order = np.argsort(query, kind="stable")
        queries, at, size = np.unique(query[order], return_index=True, return_counts=True)
        for some in np.array_split(np.argsort(size, kind="stable"), max(1, len(size) // 1024)):
            matrix = np.full((len(some), int(size[some].max())), -1, np.int64)
            column = np.arange(matrix.shape[1])
            matrix[column < size[some][:, None]] = lists[order[_spread(at[some], size[some])]]
            r, item, score = wand(index, matrix, threshold)
            over.append((part[queries[some][r] // tiers], item, score))
    if not over:
        return []
    passage, item, score = map(np.concatenate, zip(*over, strict=True))
    out, seen, failed = [], set(), set()
    for k in np.lexsort((begin[passage], item, -score, row[passage])).tolist():
        p, i = passage[k], int(item[k])
        r = int(row[p])
        if (r, index.ids[i]) in seen:
            continue
        a, b = max(int(first[r]), int(begin[p] - index.sizes[i])), min(int(first[r + 1]), int(end[p] + index.sizes[i]))
        if (a, b, i) in failed:
            continue
        shares, whole = overlaps(index.parts[i], words.hash[a:b])
        if min(shares) >= min_overlap and whole >= 2 * min_overlap / 3:
            seen.add((r, index.ids[i]))
            out.append((r, i, float(score[k]), *shares, int(begin[p] - first[r])))
        else:
            failed.add((a, b, i))
    return out


def _term_counts(rows: DataFrame, names: list[str]) -> DataFrame:
    """(part, term, df, entries, words): the terms of each set of items, with the statistics of all items."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts, terms, sizes = [], [], []
        for r in batch.to_pylist():
            for e in _entries(pd.DataFrame([r])):
                own = np.unique(e[3])
                parts.append(np.full(len(own), r["part"]))
                terms.append(own)
                sizes.append(np.concatenate([[len(e[3])], np.zeros(len(own) - 1, np.int64)]))
        if not parts:
            return None
        part, term, size = map(np.concatenate, (parts, terms, sizes))
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(term.view(np.int64)), pa.array(size, pa.int64())], names=["part", "term", "size"])

    found = materialise(map_batches(rows.select("part", *names), each, "part int, term long, size long"), "terms")
    totals = found.agg(F.count_if(F.col("size") > 0), F.sum("size")).first()
    df = materialise(found.groupBy("term").agg(F.count("*").alias("df")), "df")
    return materialise(found.select("part", "term").distinct().join(df.hint("merge"), "term").select("part", "term", "df", F.lit(totals[0]).alias("entries"), F.lit(totals[1]).alias("words")), "counts")


def _indexes(items: DataFrame) -> Iterator[tuple[Index | None, bool]]:
    """The index of each set of items, all by the statistics of all items, and whether there are several."""
    names = [c for c in ("item_id", "text", "question", "answer") if c in items.columns]
    if "question" in names and "answer" not in names:
        names.remove("question")
    rows = items.select(*names).filter(F.col("item_id").isNotNull())
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in names[1:]), F.lit(0))
    sets = -(-int(rows.agg(F.sum(size)).first()[0] or 0) // SET_BYTES) or 1
    rows = rows.withColumn("part", F.pmod(F.xxhash64(*names), F.lit(sets)).cast("int"))
    some = lambda i: rows.filter(F.col("part") == i).drop("part").toPandas().sort_values(names, kind="stable")
    if sets == 1:
        yield build_index(some(0)), False
        return
    counts = _term_counts(rows, names)
    for i in range(sets):
        own = counts.filter(F.col("part") == i).toPandas()
        terms = own["term"].to_numpy(np.int64).view(U)
        order = np.argsort(terms)
        of = Statistics(terms[order], own["df"].to_numpy()[order], int(own["entries"].iloc[0]), int(own["words"].iloc[0])) if len(own) else None
        yield build_index(some(i), of), True


@scoped
def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.5, min_overlap: float = 0.6) -> DataFrame:
    """A row for each text and test item in it: doc_id, item_id, score, the overlaps, and the passage's first word."""
    spark = docs.sparkSession
    tune(spark)
    out = None
    for built, several in _indexes(items):
        sent = spark.sparkContext.broadcast(built)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            index = sent.value
            for batch in batches if index else ():
                ids = batch.column(0)
                data, offsets = text_bytes(batch.column(1))
                for a, b in slices(offsets):
                    part = offsets[a : b + 1]
                    rows = find(index, data[part[0] : part[-1]], part - part[0], threshold, min_overlap)
                    if rows:
                        r, i, *rest = zip(*rows, strict=True)
                        doc = ids.take(pa.array(np.array(r) + a))
                        yield pa.RecordBatch.from_arrays([doc, pa.array(index.ids[list(i)], pa.int64()), *(pa.array(x, pa.float64()) for x in rest[:3]), pa.array(rest[3], pa.int64())], names=[x.split()[0] for x in FOUND.split(", ")])

        found = docs.select("doc_id", "text").mapInArrow(run, FOUND)
        if several:  # one set's index is sent at a time
            found = materialise(found, "found")
            sent.unpersist()
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], FOUND) if out is None else out


@scoped
def with_leaks(docs: DataFrame, items: DataFrame, name: str, threshold: float = 0.5, min_overlap: float = 0.6) -> DataFrame:
    """docs and a column with the number of test items in each text."""
    out = docs.withColumn(name, F.lit(0))
    for i, (built, several) in enumerate(_indexes(items)):
        sent = docs.sparkSession.sparkContext.broadcast(built)

        def count(texts: pa.Array, sent=sent) -> list[pa.Array]:  # noqa: ANN001
            data, offsets = text_bytes(texts)
            n = np.zeros(len(offsets) - 1, np.int32)
            for a, b in slices(offsets) if sent.value else ():
                part = offsets[a : b + 1]
                for r, *_ in find(sent.value, data[part[0] : part[-1]], part - part[0], threshold, min_overlap):
                    n[a + r] += 1
            return [pa.array(n)]

        out = with_columns(out, "text", count, [T.StructField(f"{name}_{i}", T.IntegerType())]).withColumn(name, F.col(name) + F.col(f"{name}_{i}")).drop(f"{name}_{i}")
        if several:
            out = materialise(out, "leaks", instead_of=out)
            sent.unpersist()
    return out
