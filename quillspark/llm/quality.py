"""Quality rules: exact counts of each text, and a linear-chain CRF over its lines that decides on retention.

Each line with a word has features (length, symbols, repetition, case, separators, length of words, equality with an
earlier line). Viterbi decoding of the CRF marks each line content or boilerplate; a text stays if the lines of content
hold at least min_share of its words' characters.

The CRF is fitted by gradient ascent of its likelihood on a sample of about rows_a_label texts of each quality label (not
over 1.2 times as many) within the bounds of sample.py. Labels are of texts, so the states of lines are latent: they begin
as the text's label, and after each of PASSES fits the surest lines of the other kind change, up to a share CHANGED of the
text. SPLICED further texts are joined from the lines of a good and a bad text each, which teaches the chain changes within
a text.

A text that fails a base rule (fewer than 10 words, or over a fifth of its words in repeated 5-word windows) doesn't stay.

Defined cases: a null or empty text has counts of 0 and fails; null labels and texts aren't fitted; without labels of both
kinds the base rules alone decide; repeated rows get equal results; an empty table gives no rows. Only doc_id and text
are read; further columns do no harm.

Scale: no shuffle of texts; the model is a few dozen numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.frames import with_columns
from quillspark.llm.sample import fetch, sampled
from quillspark.llm.words import Sums, Words, find_words, mix, rolled, slices, text_bytes

WINDOW = 5
MIN_WORDS = 10
#: Share of the fitted good texts that must stay.
KEEP_GOOD = 0.998
#: Texts spliced for fitting, of parts shorter than SPLICED_CHARS; times that line states are fitted; share of a text whose states may differ from its label.
SPLICED, SPLICED_CHARS, PASSES, CHANGED = 600, 20_000, 3, 0.4
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
LEAD = (np.arange(256) & 0xC0) != 0x80
U = np.uint64
N_FEATURES = 11
FIELDS = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [
    T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("content_share", T.DoubleType())
]


@dataclass
class Lines:
    """Of each line with a word: its text, features, characters in words; first: each text's first line, and the end."""

    row: np.ndarray
    first: np.ndarray
    x: np.ndarray
    chars: np.ndarray


@dataclass
class Counts:
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def base_fails(counts: Counts) -> np.ndarray:
    return (counts.n_words < MIN_WORDS) | (100 * counts.n_repeat_words > 20 * counts.n_words)


def repeated(words: Words, n: int) -> np.ndarray:
    """For each word, whether a window of WINDOW words over it is found twice or more in its text."""
    m = len(words.start)
    out = np.zeros(m + 1, np.int64)
    keys = rolled(words.hash, WINDOW)
    whole = np.flatnonzero(words.row[: len(keys)] == words.row[WINDOW - 1 :]) if len(keys) else np.zeros(0, np.int64)
    if len(whole):
        keys = mix(keys[whole] + words.row[whole].astype(U) * U(0xD6E8FEB86659FD93))
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(out, whole[twice], 1)
        np.add.at(out, whole[twice] + WINDOW, -1)
    return np.cumsum(out[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[Counts, Lines]:
    n = len(offsets) - 1
    words = find_words(data, offsets)
    total = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    leads, symbols = total(LEAD[data]), total(SYMBOLS[data])
    by_row = lambda values: np.bincount(words.row, weights=values, minlength=n).astype(np.int64)
    chars = leads[words.end] - leads[words.start]
    again = repeated(words, n)
    starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], *([np.flatnonzero(data == 10) + 1] if len(data) else [])]))
    starts = starts[starts < len(data)]
    line_row = np.searchsorted(offsets, starts, "right") - 1
    ends = np.append(starts[1:], len(data))
    ends -= (data[ends - 1] == 10) if len(starts) else 0
    line_of = np.searchsorted(starts, words.start, "right") - 1
    per = lambda values: np.bincount(line_of, weights=values, minlength=len(starts))
    count = per(np.ones(len(line_of)))
    used = np.flatnonzero(count > 0)
    key = mix(Sums.of_bytes(data).hash(starts[used], ends[used]) + (ends - starts)[used].astype(U) * U(0xA0761D6478BD642F))
    key = mix(key + line_row[used].astype(U) * U(0xD6E8FEB86659FD93))
    dup = np.ones(len(used), bool)
    dup[np.unique(key, return_index=True)[1]] = False
    counts = Counts(
        np.bincount(words.row, minlength=n), by_row(chars), symbols[offsets[1:]] - symbols[offsets[:-1]], np.bincount(line_row[used], weights=dup, minlength=n).astype(np.int64), by_row(again)
    )
    count, line_chars = count[used], per(chars)[used]
    upper, digit = total((data >= 65) & (data <= 90)), total((data >= 48) & (data <= 57))
    a, b = starts[used], ends[used]
    last = data[np.maximum(words.end - 1, 0)] if len(words.end) else np.zeros(0, np.uint8)
    lone = per((chars == 1) & SYMBOLS[data[words.start]] if len(words.start) else np.zeros(0))[used]
    next_same = np.zeros(len(words.start), bool)
    if len(words.start) > 1:
        next_same[1:] = (words.hash[1:] == words.hash[:-1]) & (line_of[1:] == line_of[:-1])
    x = np.stack(
        [
            np.ones(len(used)), np.log(count) / 4, np.minimum(1, 5 * (symbols[b] - symbols[a]) / line_chars), np.minimum(line_chars / count, 20) / 8, np.minimum(1, 2 * (upper[b] - upper[a]) / line_chars), (digit[b] - digit[a]) / line_chars,
            np.minimum(1, 3 * lone / count), per(again)[used] / count, np.minimum(1, 3 * per(next_same)[used] / count), dup.astype(float), per((last == 33).astype(float))[used] / count,
        ], 1,
    )
    row = line_row[used]
    return counts, Lines(row, np.searchsorted(row, np.arange(n + 1)), x, line_chars)


@dataclass
class Crf:
    """Linear chain with states 0 (boilerplate) and 1 (content): weights (features, 2), steps (from, to)."""

    weights: np.ndarray
    steps: np.ndarray


def _by_length(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    return order[sizes[order] > 0], sizes


def viterbi(crf: Crf, lines: Lines) -> np.ndarray:
    """The likeliest state of every line; all texts step together, the longest first."""
    score = lines.x @ crf.weights
    state = np.zeros(len(score), np.int64)
    order, sizes = _by_length(lines.first)
    if not len(order):
        return state
    begin, length = lines.first[order], sizes[order]
    best = score[begin].copy()
    back = np.zeros((len(score), 2), np.int8)
    live = [int(np.searchsorted(-length, -t, "left")) for t in range(int(length[0]) + 1)]
    for t in range(1, int(length[0])):
        k = live[t]
        path = best[:k, :, None] + crf.steps[None]
        back[begin[:k] + t] = path.argmax(1)
        best[:k] = path.max(1) + score[begin[:k] + t]
    now = best.argmax(1)
    for t in range(int(length[0]) - 1, -1, -1):
        k = live[t]
        state[begin[:k] + t] = now[:k]
        if t:
            now[:k] = back[begin[:k] + t, now[:k]]
    return state


def _marginals(crf: Crf, lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each line's states, and expected counts of steps, by forward and backward sums."""
    score = lines.x @ crf.weights
    order, sizes = _by_length(lines.first)
    begin, length = lines.first[order], sizes[order]
    live = [int(np.searchsorted(-length, -t, "left")) for t in range(int(length[0]) + 1)]
    ahead, behind = score.copy(), np.zeros_like(score)
    for t in range(1, int(length[0])):
        at = begin[: live[t]] + t
        ahead[at] += np.logaddexp(ahead[at - 1, 0, None] + crf.steps[0], ahead[at - 1, 1, None] + crf.steps[1])
    for t in range(int(length[0]) - 1, 0, -1):
        at = begin[: live[t]] + t
        nxt = score[at] + behind[at]
        behind[at - 1] = np.logaddexp(crf.steps[:, 0] + nxt[:, :1], crf.steps[:, 1] + nxt[:, 1:])
    both = ahead + behind
    norm = np.logaddexp(both[:, 0], both[:, 1])
    inner = np.setdiff1d(np.concatenate([begin[: live[t]] + t for t in range(1, int(length[0]))]) if length[0] > 1 else np.zeros(0, np.int64), [])
    inner = inner.astype(np.int64)
    pair = ahead[inner - 1][:, :, None] + crf.steps[None] + (score[inner] + behind[inner])[:, None, :] - norm[inner][:, None, None]
    return np.exp(both - norm[:, None]), np.exp(pair).sum(0)


def _measured(texts: list[str]) -> tuple[Counts, Lines]:
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    parts = [measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)]
    begin = [a for a, _ in slices(offsets)]
    joined = lambda get: np.concatenate([get(p) for p in parts])
    counts = Counts(*(joined(lambda p, n=n: getattr(p[0], n)) for n in Counts.__dataclass_fields__))
    row = np.concatenate([p[1].row + a for a, p in zip(begin, parts, strict=True)])
    return counts, Lines(row, np.searchsorted(row, np.arange(len(texts) + 1)), joined(lambda p: p[1].x), joined(lambda p: p[1].chars))


def spliced(texts: list[str], good: np.ndarray, n: int, seed: int = 5) -> tuple[list[str], list[np.ndarray]]:
    """Up to n texts made of the lines of a good and of a bad text each, and the states of their lines with a word."""
    rng = np.random.default_rng(seed)
    lines = lambda i: [x for x in texts[i].split("\n") if find_words(*text_bytes(pa.array([x])), hashed=False).start.size]
    short = np.array([len(t) < SPLICED_CHARS for t in texts], bool)
    made, states = [], []
    pairs = zip(rng.permutation(np.flatnonzero((good == 1) & short)).tolist(), rng.permutation(np.flatnonzero((good == 0) & short)).tolist(), strict=False)
    for k, (i, j) in enumerate(pairs):
        if k == n:
            break
        content, other = lines(i), lines(j)
        at = (0, len(content), int(rng.integers(0, len(content) + 1)))[k % 3]
        made.append("\n".join([*content[:at], *other, *content[at:]]))
        states.append(np.concatenate([np.ones(at, np.int64), np.zeros(len(other), np.int64), np.ones(len(content) - at, np.int64)]))
    return made, states


def _ascend(crf: Crf, lines: Lines, y: np.ndarray, rounds: int, rate: float, pull: float) -> None:
    """Gradient ascent of the likelihood of the states y, both states of equal weight."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    same = lines.row[1:] == lines.row[:-1]
    seen_steps = np.zeros((2, 2))
    np.add.at(seen_steps, (y[:-1][same], y[1:][same]), 1)
    squares = [np.full_like(crf.weights, 1e-8), np.full_like(crf.steps, 1e-8)]
    truth = np.eye(2)[y]
    for _ in range(rounds):
        p, steps = _marginals(crf, lines)
        grads = [lines.x.T @ ((truth - p) * weight[:, None]) / len(y) - pull * crf.weights, (seen_steps - steps) / len(y) - pull * crf.steps]
        for value, g, s in zip((crf.weights, crf.steps), grads, squares, strict=True):
            s += g * g
            value += rate * 6 * g / np.sqrt(s)


def _relabelled(crf: Crf, lines: Lines, y: np.ndarray, whole: np.ndarray, good: np.ndarray) -> np.ndarray:
    """States of the lines of whole texts by their marginals, as far as each text's share still gives its label; the rest as it is."""
    p = _marginals(crf, lines)[0][:, 1]
    out = y.copy()
    total = np.bincount(lines.row, weights=lines.chars, minlength=len(good))
    for label in (0, 1):
        some = np.flatnonzero(whole[lines.row] & (good[lines.row] == label) & ((p > 0.5) != (label == 1)))
        some = some[np.lexsort((p[some] if label else -p[some], lines.row[some]))]  # the surest first
        gone = np.cumsum(lines.chars[some])
        before = gone - lines.chars[some]
        first = np.searchsorted(lines.row[some], lines.row[some], "left")
        ahead = gone - (before[first] if len(some) else 0)
        out[some] = np.where(ahead < CHANGED * total[lines.row[some]], 1 - label, label)
    return out


def fit(texts: list[str], good: list[int], rounds: int = 150, rate: float = 0.1, pull: float = 1e-4) -> Crf | None:
    """The CRF of texts with labels; None without texts of both labels that pass the base rules."""
    if not texts:
        return None
    good = np.array(good, np.int64)
    fine = np.flatnonzero(~base_fails(_measured(texts)[0]))
    texts, good = [texts[i] for i in fine.tolist()], good[fine]
    if len(set(good.tolist())) < 2:
        return None
    made, states = spliced(texts, good, SPLICED)
    _, lines = _measured([*texts, *made])
    whole = np.arange(len(texts) + len(made)) < len(texts)
    label = np.concatenate([good, np.full(len(made), -1)])
    y = np.concatenate([good[lines.row[lines.row < len(texts)]], *states])
    crf = Crf(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
    for _ in range(PASSES):
        _ascend(crf, lines, y, rounds, rate, pull)
        y = _relabelled(crf, lines, y, whole, label)
    asked = label == 1
    for _ in range(40):  # content gains ground until nearly all fitted good texts stay
        if (content_share(crf, lines, len(label))[asked] >= 0.5).mean() >= KEEP_GOOD:
            break
        crf.weights[0, 1] += 0.25
    return crf


def content_share(crf: Crf, lines: Lines, n: int) -> np.ndarray:
    """Share of each text's word characters that stand in lines of content."""
    content = viterbi(crf, lines) == 1
    by_text = lambda weights: np.bincount(lines.row, weights=weights, minlength=n)
    return by_text(lines.chars * content) / np.maximum(by_text(lines.chars), 1)


def learn(docs: DataFrame, labels: DataFrame, rows_a_label: int = 1500) -> Crf | None:
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1))
    some = sampled(known.groupBy("doc_id").agg(F.min("quality").alias("quality")), "quality", rows_a_label)
    found = fetch(docs.select("doc_id", "text"), some)
    return fit(found["text"].tolist(), found["quality"].tolist())


def judge(crf: Crf | None, texts: pa.Array, min_share: float) -> list[pa.Array]:
    data, offsets = text_bytes(texts)
    parts: list[list[np.ndarray]] = [[] for _ in FIELDS]
    for a, b in slices(offsets):
        part = offsets[a : b + 1]
        counts, lines = measure(data[part[0] : part[-1]], part - part[0])
        failed = base_fails(counts)
        share = np.ones(b - a)
        if crf is not None:
            share = content_share(crf, lines, b - a)
        values = [counts.n_words, counts.word_chars, counts.n_symbols, counts.n_dup_lines, counts.n_repeat_words, failed, ~failed & (share >= min_share), share]
        for to, v in zip(parts, values, strict=True):
            to.append(v)
    kinds = (pa.int64(),) * 5 + (pa.bool_(),) * 2 + (pa.float64(),)
    return [pa.array(np.concatenate(p) if p else [], k) for p, k in zip(parts, kinds, strict=True)]


def judge_documents(docs: DataFrame, crf: Crf | None, min_share: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, kept and content_share."""
    sent = docs.sparkSession.sparkContext.broadcast(crf)
    return with_columns(docs.select("doc_id", "text"), "text", lambda texts: judge(sent.value, texts, min_share), FIELDS).drop("text")
