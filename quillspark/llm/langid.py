"""Language of texts: averaged hashed subword embeddings and a linear softmax, fitted by stochastic gradient descent.

A text's subwords are its byte 2-, 3- and 4-grams (ASCII letters lowered), hashed into BUCKETS rows a length; the text is
the average of their embeddings. A temperature fitted on rows kept aside calibrates the softmax, and the same rows give
the score under which a prediction counts as rejected, so that accepted ones are right at least at the asked precision.

Fitting takes a sample of about rows_a_language rows of each language (not over 1.2 times as many), from rows whose
crc32(doc_id) mod 3 isn't 1; predicting takes every whole text and only the text.

Defined cases: a null text, or one without any letter, is `und` with score 0; if no language could be learned, so is
every text; repeated rows get equal results; an empty table gives no rows. Only doc_id, text and (for fitting) lang are
read; further columns do no harm.

Scale: no shuffle; the model is a broadcast of fixed size (BUCKETS * 3 rows).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.frames import with_columns
from quillspark.llm.sample import fetch, held_out, sampled
from quillspark.llm.words import LOWER, mix, slices, text_bytes

BUCKETS = 1 << 15
SIZES = (2, 3, 4)
DIM = 16
UNKNOWN = "und"
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """Rows of the table for the size-grams at each byte."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    code = np.zeros(n, np.uint32)
    for i in range(size):
        code = (code << np.uint32(8)) | data[i : i + n]
    code *= np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA77)
    return (code >> np.uint32(17)).astype(np.int64) + BUCKETS * (size - SIZES[0])


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's different table rows and their shares."""
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    found = [x for x in (np.unique(grams(data, k), return_counts=True) for k in SIZES) if len(x[0])]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    rows, counts = (np.concatenate([x[i] for x in found]) for i in range(2))
    return rows.astype(np.int32), (counts / counts.sum()).astype(np.float32)


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    temperature: float = 1.0
    reject: float = 0.0


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(texts: list[str], langs: list[str], epochs: int = 4, rate: float = 20.0, precision: float = 0.99, seed: int = 5) -> Model:
    names = sorted(set(langs))
    if not names:
        return Model()
    target = np.array([names.index(x) for x in langs])
    bags = [bag(t) for t in texts]
    rng = np.random.default_rng(seed)
    aside = mix(np.arange(len(texts), dtype=np.uint64)) % np.uint64(5) == 0 if len(texts) >= 50 else np.zeros(len(texts), bool)
    embed = (rng.standard_normal((BUCKETS * len(SIZES), DIM)) * 0.1).astype(np.float32)
    weight = (rng.standard_normal((DIM, len(names))) * 0.3).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    train = np.flatnonzero(~aside)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(train):
            rows, share = bags[i]
            if not len(rows):
                continue
            h = share @ embed[rows]
            g = softmax(h @ weight + bias)
            g[target[i]] -= 1
            back = weight @ g
            weight -= np.float32(0.05 * step) * np.outer(h, g)
            bias -= np.float32(0.005 * step) * g
            embed[rows] -= (np.float32(step) * share)[:, None] * back
    model = Model(names, embed @ weight, bias)
    check = np.flatnonzero(aside) if aside.any() else train
    z = np.array([bags[i][1] @ model.table[bags[i][0]] + bias for i in check]).reshape(len(check), len(names))
    losses = {t: -np.log(np.maximum(softmax(z / t)[np.arange(len(check)), target[check]], 1e-9)).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
    model.temperature = min(losses, key=losses.get)
    p = softmax(z / model.temperature)
    order = np.argsort(-p.max(1), kind="stable")
    right = np.cumsum(p.argmax(1)[order] == target[check][order]) / np.arange(1, len(check) + 1)
    good = np.flatnonzero(right >= precision)
    model.reject = float(p.max(1)[order[good[-1]]]) if len(good) else 1.0
    return model


def predict(model: Model, texts: pa.Array) -> list[pa.Array]:
    """lang_pred, score, rejected."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    scores = np.zeros((n, max(1, len(model.langs))), np.float64)
    for a, b in slices(offsets) if model.langs else ():
        part = LOWER[data[offsets[a] : offsets[b]]]
        at = offsets[a : b + 1] - offsets[a]
        for k in SIZES:
            values = model.table[grams(part, k)]
            if not len(values):
                continue
            start, end = at[:-1], np.maximum(at[1:] - k + 1, at[:-1])
            full = np.flatnonzero(end > start)
            edges = np.stack([start[full], np.minimum(end[full], len(values) - 1)], 1).ravel()
            sums = np.add.reduceat(values, edges, axis=0)[::2].astype(np.float64)
            if len(full) and end[full[-1]] > edges[-1]:  # the last range runs to the end
                sums[-1] = values[start[full[-1]] :].sum(0)
            scores[a + full] += sums
    sizes = np.diff(offsets)
    count = sum(np.maximum(sizes - k + 1, 0) for k in SIZES)
    letter = regex.compile(r"\p{L}")
    known = np.array([bool(model.langs) and t is not None and letter.search(t) is not None for t in texts.to_pylist()], bool)
    if not model.langs:
        return [pa.array([UNKNOWN] * n, pa.string()), pa.array(np.zeros(n)), pa.array(np.ones(n, bool))]
    p = softmax((scores / np.maximum(count, 1)[:, None] + model.bias) / model.temperature)
    best, top = p.argmax(1), p.max(1)
    names = np.array([*model.langs, UNKNOWN], object)[np.where(known, best, len(model.langs))]
    top = np.where(known, top, 0.0)
    return [pa.array(names.tolist(), pa.string()), pa.array(top), pa.array(top < model.reject)]


def learn(docs: DataFrame, rows_a_language: int = 1200) -> Model:
    """Fit on the sample of labelled rows that aren't held out."""
    rows = docs.select("doc_id", "lang", "text").filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = sampled(rows.select("doc_id", "lang"), "lang", rows_a_language).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    found = fetch(rows.select("doc_id", "text"), known)
    return fit(found["text"].tolist(), found["lang"].tolist())


def label_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return with_columns(rows, "text", lambda texts: predict(sent.value, texts), FIELDS).drop("text")
