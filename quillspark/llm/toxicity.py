"""Toxicity of texts: a convolutional classifier over hashed word embeddings, fitted in numpy.

A word (letters and digits, ASCII lowered) is the sum of embeddings hashed from the whole word and from its first 4, 5, 6
and 7 bytes, so unseen endings of a known stem count. Filters of widths 1, 2 and 3 run over the words; the maximum of
each filter over the whole text enters a logistic output. Thresholds are calibrated by language: a word count model tells
a text's language from the text alone, and rows kept aside give each language the cut with the best F1. The score is
moved so that this cut falls on 0.7 in every language.

Fitting takes every labelled row, whole, whose crc32(doc_id) mod 3 isn't 1: a fifth is kept aside for the thresholds (none of
fewer than 100), the others are in shards of about SHARD_BYTES. In each of ROUNDS rounds every shard goes down its gradient, from
where the model stands, through all its texts; the model then moves by the mean of what the shards that touched a number moved
it. Counts of words are of all these rows, and the F1 of a cut is counted over all rows kept aside, in bins of 1 / BINS of a
logit. Shards go by hashes and sums are of whole numbers, so the model doesn't depend on how the tables are partitioned. Scoring
takes every whole text and only the text.

Defined cases: a null or empty text, or one without words, scores like a text without evidence; if labels has no rows
of both kinds, every score is 0; null labels aren't used; a doc_id labelled twice counts as toxic if any label says
so; rows equal in doc_id, text and lang are fitted once; rows of a language not among the MAX_LANGS of the most rows, or of none,
are told as one language; repeated rows get equal scores; an empty table gives no rows. Columns other than doc_id, text and, for fitting, lang
do no harm.

Scale: scoring shuffles nothing. For fitting, the texts that aren't held out are shuffled to their labels, and the labelled ones
into shards, once. The driver holds the model, which is of fixed size (5 * BUCKETS rows), and counts as large; no texts.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.frames import materialise, tune, with_columns
from quillspark.llm.sample import held_out
from quillspark.llm.words import byte_sums, find_words, mix, powers, slices, text_bytes
from quillspark.state import scoped

BUCKETS = 1 << 16
PREFIXES = (4, 5, 6, 7)
KINDS = 1 + len(PREFIXES)
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
CUT = 0.7
SEED = 11
ROUNDS = 6
#: Bytes of text a shard, in the mean.
SHARD_BYTES = 16 << 20
#: Texts and words in one step at most (a text is never cut).
STEP_TEXTS = 32
STEP_WORDS = 1 << 19
#: All toxic texts weigh as much as this times all clean ones, if they are fewer.
BALANCE = 5 / 7
#: A language has a cut of its own from so many rows kept aside of either label on.
LEAST = 5
#: Languages told apart, those of the most rows; the others are told as one.
MAX_LANGS = 32
BINS = 256
UNIT = 1 << 32
MOVES = [f"m{i}" for i in range(DIM + 1)]
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
U = np.uint64


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each word (words by KINDS), and the n + 1 offsets of the texts in them."""
    words = find_words(data, offsets, lower=True, hashed=False, space=NOT_WORD)
    total, unit = byte_sums(words.data), powers(len(data) + 1, True)[words.start]
    out = np.empty((len(words.start), KINDS), np.int32)
    for i, size in enumerate((1 << 30, *PREFIXES)):
        end = np.minimum(words.end, words.start + size)
        out[:, i] = (mix((total[end] - total[words.start]) * unit + U(i)) >> U(48)).astype(np.int32) + i * BUCKETS
    return out, words.first


@dataclass
class Model:
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    langs: list[str] = field(default_factory=list)
    words: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 1), np.float32))
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(1))
    scales: np.ndarray = field(default_factory=lambda: np.ones(1))

    def pooled(self, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pooled filters of each text, the words' embeddings, and where each maximum stands (-1: nowhere)."""
        n, sizes = len(first) - 1, np.diff(first)
        vectors = self.embed[rows[:, 0]].copy()
        for i in range(1, KINDS):
            vectors += self.embed[rows[:, i]]
        pooled = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        where = np.full(pooled.shape, -1, np.int64)
        for w, width in enumerate(WIDTHS):
            long = np.flatnonzero(sizes >= width)
            if not len(long):
                continue
            count = len(vectors) - width + 1
            z = np.zeros((count + 1, FILTERS), np.float32)
            for o in range(width):
                z[:count] += vectors[o : o + count] @ self.filters[w][o]
            edges = np.stack([first[long], first[long + 1] - width + 1], 1).ravel()
            top = np.maximum.reduceat(z, edges, axis=0)[::2]
            cols = slice(w * FILTERS, (w + 1) * FILTERS)
            pooled[long, cols] = np.maximum(top + self.bias[cols], 0)
            if self.want_places:
                for j, d in enumerate(long):
                    part = z[first[d] : first[d + 1] - width + 1]
                    where[d, cols] = first[d] + part.argmax(0)
        return pooled, vectors, where

    want_places = False

    def logits(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(rows, first)[0] @ self.out + self.out_bias

    def languages(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Number of each text's likeliest language."""
        if len(self.langs) < 2:
            return np.zeros(len(first) - 1, np.int64)
        score = np.zeros((len(first) - 1, len(self.langs)), np.float32)
        full = np.flatnonzero(np.diff(first) > 0)
        if len(full):
            score[full] = np.add.reduceat(self.words[rows[:, 0]], first[full], axis=0)
        return score.argmax(1)

    def scores(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        lang = self.languages(rows, first)
        z = (self.logits(rows, first) - self.cuts[lang]) * self.scales[lang] + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Fit:
    """A model while it is fitted, with AdaGrad's sums of squares: one a row of embeddings, one a number elsewhere."""

    def __init__(self, share: float, seed: int) -> None:
        rng, f = np.random.default_rng(seed), len(WIDTHS) * FILTERS
        self.model = Model(
            (rng.standard_normal((KINDS * BUCKETS, DIM)) * 0.05).astype(np.float32), [(rng.standard_normal((w, DIM, FILTERS)) * 0.5 / np.sqrt(w)).astype(np.float32) for w in WIDTHS],
            np.zeros(f, np.float32), (rng.standard_normal(f) * 0.3).astype(np.float32), float(np.log(share / (1 - share))),
        )
        self.seen = np.full(len(self.model.embed), 1e-3, np.float32)
        self.squares = [np.full(p.shape, 1e-4, np.float32) for p in (*self.model.filters, self.model.bias, self.model.out)]
        self.touched = np.zeros(len(self.seen), bool)

    def dense(self) -> np.ndarray:
        """All numbers but the embeddings and what belongs to them, as rows as wide as theirs."""
        flat = np.concatenate([np.ravel(p) for p in (*self.model.filters, self.model.bias, self.model.out, [self.model.out_bias], *self.squares)])
        return np.pad(flat, (0, -len(flat) % (DIM + 1))).reshape(-1, DIM + 1).astype(np.float64)

    def set_dense(self, rows: np.ndarray) -> None:
        flat, at = rows.ravel(), 0
        for p in (*self.model.filters, self.model.bias, self.model.out, None, *self.squares):
            size = 1 if p is None else p.size
            if p is None:
                self.model.out_bias = float(flat[at])
            else:
                p[...] = flat[at : at + size].reshape(p.shape)
            at += size

    def step(self, rng: np.random.Generator, rate: float, rows: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """One step down the gradient of some texts."""
        model = self.model
        model.want_places = True
        pooled, vectors, where = model.pooled(rows, first)
        g = ((1 / (1 + np.exp(-(pooled @ model.out + model.out_bias))) - y) * weight / weight.sum()).astype(np.float32)
        back = g[:, None] * model.out * (pooled > 0)

        def move(p: np.ndarray, squares: np.ndarray, grad: np.ndarray) -> None:
            squares += grad * grad
            p -= rate * grad / np.sqrt(squares)

        move(model.out, self.squares[-1], pooled.T @ g)
        model.out_bias -= rate * float(g.sum())
        move(model.bias, self.squares[-2], back.sum(0))
        touched, grads = [], []
        for w, width in enumerate(WIDTHS):
            cols = slice(w * FILTERS, (w + 1) * FILTERS)
            d, j = np.nonzero((where[:, cols] >= 0) & (back[:, cols] != 0))
            if not len(d):
                continue
            place, amount = where[:, cols][d, j], back[:, cols][d, j]
            grad = np.zeros_like(model.filters[w])
            for o in range(width):
                part = amount[:, None] * vectors[place + o]
                for i in range(FILTERS):
                    grad[o, :, i] = part[j == i].sum(0)
                touched.append(place + o)
                grads.append(amount[:, None] * model.filters[w][o].T[j])
            move(model.filters[w], self.squares[w], grad)
        if not touched:
            return
        place, back_words = np.concatenate(touched), np.concatenate(grads)
        drop = rng.random(len(place)) < 0.5  # the whole word's row rests now and then, so stems have to carry weight
        for i in range(KINDS):
            use = ~drop if i == 0 else np.ones(len(place), bool)
            ids, inverse = np.unique(rows[place[use], i], return_inverse=True)
            total = np.zeros((len(ids), DIM), np.float32)
            np.add.at(total, inverse, back_words[use])
            self.seen[ids] += (total * total).mean(1)
            model.embed[ids] -= rate * total / np.sqrt(self.seen[ids])[:, None]
            self.touched[ids] = True

    def moves(self, start: Fit) -> pa.RecordBatch:
        """How far each row touched has moved from start, in whole units, so that sums don't depend on their order."""
        ids = np.flatnonzero(self.touched)
        sparse = np.concatenate([self.model.embed[ids].astype(np.float64) - start.model.embed[ids], (self.seen[ids].astype(np.float64) - start.seen[ids])[:, None]], 1)
        dense = self.dense() - start.dense()
        values = np.rint(np.clip(np.concatenate([sparse, dense]), -4096, 4096) * UNIT).astype(np.int64)
        ids = np.concatenate([ids, len(self.seen) + np.arange(len(dense))]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(v) for v in values.T)], names=["id", *MOVES])

    def moved(self, ids: np.ndarray, mean: np.ndarray) -> None:
        """Add what the shards that touched a row moved it in the mean."""
        sparse, dense = ids < len(self.seen), self.dense()
        self.model.embed[ids[sparse]] += mean[sparse, :DIM].astype(np.float32)
        self.seen[ids[sparse]] += mean[sparse, DIM].astype(np.float32)
        dense[ids[~sparse] - len(self.seen)] += mean[~sparse]
        self.set_dense(dense)


def _feature_slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text past the last, their embedding rows, the offsets in them) over slices of the texts."""
    data, offsets = text_bytes(texts)
    for a, b in slices(offsets):
        yield a, b, *features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, embedding rows, offsets, labels) of some texts of one shard at a time, wherever Arrow batches end."""
    held: list[tuple[np.ndarray, int]] = []
    at = words = 0

    def taken() -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        return at, np.concatenate([r for r, _ in held]), np.concatenate([[0], np.cumsum([len(r) for r, _ in held])]), np.array([y for _, y in held], np.float32)

    for batch in batches:
        shards, labels = (batch.column(i).to_numpy() for i in (0, 2))
        for a, b, rows, first in _feature_slices(batch.column(1)):
            for i in range(b - a):
                part = rows[first[i] : first[i + 1]]
                if held and (shards[a + i] != at or len(held) == STEP_TEXTS or words + len(part) > STEP_WORDS):
                    yield taken()
                    held, words = [], 0
                at = int(shards[a + i])
                held.append((part, labels[a + i]))
                words += len(part)
    if held:
        yield taken()


def _round(table: DataFrame, fit: Fit, number: int, weight: float) -> None:
    """Every shard goes once through its texts from where fit stands; fit moves by the mean."""
    sent = table.sparkSession.sparkContext.broadcast(fit)
    rate = 0.1 * (1 - 0.8 * number / ROUNDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = None, -1
        for at, rows, first, y in _steps(batches):
            if own is None or at != shard:
                if own is not None:
                    yield own.moves(sent.value)
                own, shard, rng = copy.deepcopy(sent.value), at, np.random.default_rng([SEED, number, at])
            own.step(rng, rate, rows, first, y, np.where(y > 0, np.float32(weight), np.float32(1)))
        if own is not None:
            yield own.moves(sent.value)

    moves = table.filter("not aside").select("shard", "text", "toxic").mapInArrow(run, "id int, " + ", ".join(f"{m} long" for m in MOVES))
    found = moves.groupBy("id").agg(F.count("*").alias("n"), *(F.sum(m).alias(m) for m in MOVES)).toArrow()
    n = found.column("n").to_numpy()
    fit.moved(found.column("id").to_numpy(), np.stack([found.column(m).to_numpy() / n / UNIT for m in MOVES], 1))
    sent.destroy()


def _count_words(table: DataFrame, langs: int) -> np.ndarray:
    """How often each language has each hashed word, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(langs * BUCKETS, np.int64)
        for batch in batches:
            number = batch.column(1).to_numpy()
            for a, b, rows, first in _feature_slices(batch.column(0)):
                total += np.bincount(np.repeat(number[a:b], np.diff(first)) * BUCKETS + rows[:, 0], minlength=len(total))
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(total[ids])], names=["id", "n"])

    found = table.select("text", "lang_no").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(langs * BUCKETS)
    counts[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return counts.reshape(langs, BUCKETS).T


def _best_cut(z: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> float:
    """The cut with the best F1, nearer to the lower end of its gap: a missed toxic text costs more. z falls; toxic of n texts lie at each."""
    hits = np.cumsum(toxic)
    k = int((2 * hits / (np.cumsum(n) + hits[-1])).argmax())
    below = z[k + 1] if k + 1 < len(z) else z[k] - 2
    return float(0.3 * z[k] + 0.7 * below)


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Cuts and scales by language from the logits of all rows, counted in bins of 1 / BINS."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, parts = batch.column(1).to_numpy(), []
            for _, _, own, first in _feature_slices(batch.column(0)):
                parts.append(np.stack([sent.value.languages(own, first), np.rint(np.clip(sent.value.logits(own, first), -60, 60) * BINS).astype(np.int64)]))
            lang, z = np.concatenate(parts, 1)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(z), pa.array(y.astype(np.int64))], names=["lang", "z", "toxic"])

    found = rows.select("text", "toxic").mapInArrow(run, "lang long, z long, toxic long").groupBy("lang", "z").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
    found = found.toArrow().to_pandas().sort_values(["z", "lang"], ascending=False)
    sent.destroy()
    model.cuts, model.scales = np.zeros(len(model.langs)), np.ones(len(model.langs))
    for i in range(len(model.langs)):
        own = found[found["lang"] == i]
        if min(own["toxic"].sum(), (own["n"] - own["toxic"]).sum()) < LEAST:
            own = found
        own = own.groupby("z", sort=False)[["n", "toxic"]].sum()
        z, n, toxic = own.index.to_numpy() / BINS, own["n"].to_numpy(), own["toxic"].to_numpy()
        model.cuts[i] = _best_cut(z, toxic, n)
        spread, losses = z - model.cuts[i], {}
        for s in (0.25, 0.5, 1.0, 2.0):
            logit = np.clip(spread * s + np.log(CUT / (1 - CUT)), -40, 40)
            losses[s] = (toxic * np.log1p(np.exp(-logit)) + (n - toxic) * np.log1p(np.exp(logit))).sum()
        model.scales[i] = min(losses, key=losses.get)


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, lang and toxic of every labelled row that isn't held out."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.filter(F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", lang.alias("lang"))
    return rows.join(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id")


@scoped
def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on every labelled row that isn't held out."""
    tune(docs.sparkSession)
    aside = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(5)) == 0
    narrow = _labelled(docs.withColumn("text", F.octet_length("text")), labels)
    groups = materialise(narrow.groupBy("lang", "toxic", aside.alias("aside")).agg(F.count("*").alias("n"), F.sum(F.col("text").cast("long")).alias("bytes")), "labelled")
    sums = groups.groupBy("toxic", "aside").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).collect()
    clean, toxic = (sum(r.n for r in sums if r.toxic == k) for k in (0, 1))
    if not clean or not toxic:
        return None
    common = groups.filter("lang is not null").groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()
    langs = sorted(r.lang for r in common)
    pooled = sum(r.n for r in common) < clean + toxic
    place = F.array_position(F.array(*map(F.lit, langs)).cast("array<string>"), F.col("lang"))
    keeps = clean + toxic >= 100
    shards = -(-sum(r.bytes for r in sums) // SHARD_BYTES) or 1
    shard = F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(SEED)), F.lit(shards)).cast("int")
    rows = _labelled(docs, labels).dropDuplicates(["doc_id", "text", "lang", "toxic"])
    rows = rows.select("doc_id", "text", "toxic", (aside & F.lit(keeps)).alias("aside"), F.when(place > 0, place.cast("int") - 1).otherwise(len(langs)).alias("lang_no"), shard.alias("shard"))
    order = (F.xxhash64("doc_id", F.lit(17)), F.col("doc_id"), F.xxhash64("text"), F.col("lang_no"))
    # a file has whole shards in order, and one group of rows, so no task gets a part of a shard
    table = materialise(rows.repartition(shards, "shard").sortWithinPartitions("shard", *order), "fitted")
    of = {k: sum(r.n for r in sums if keeps and r.aside and r.toxic == k) for k in (0, 1)}
    if not any(not (keeps and r.aside) and r.toxic == k for r in sums for k in (0, 1)):
        return None
    weight = max(1.0, clean / toxic * BALANCE)
    fit = Fit(weight * toxic / (weight * toxic + clean), SEED)
    for number in range(ROUNDS):
        _round(table, fit, number, weight)
    model = fit.model
    model.langs = [*langs, *[""] * pooled]
    counts = _count_words(table, len(model.langs)) + 0.1
    model.words = np.log(counts / counts.sum(0)).astype(np.float32)
    _calibrate(model, table.filter("aside") if min(of.values()) >= LEAST else table)
    return model


def score_texts(model: Model | None, texts: pa.Array) -> list[pa.Array]:
    data, offsets = text_bytes(texts)
    out = np.zeros(len(offsets) - 1)
    for a, b in slices(offsets) if model else ():
        part = offsets[a : b + 1]
        out[a:b] = model.scores(*features(data[part[0] : part[-1]], part - part[0]))
    return [pa.array(out)]


def with_score(docs: DataFrame, model: Model | None, name: str = "score", text: str = "text") -> DataFrame:
    """docs and a column of scores."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return with_columns(docs, text, lambda texts: score_texts(sent.value, texts), [T.StructField(name, T.DoubleType())])


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    scored = with_score(rows, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
