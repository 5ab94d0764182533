"""Full-text search: an inverted index as a table, boolean matches by array functions, ranks by BM25 columns.

Words are runs of letters and digits, lower case, accents folded, then stemmed (Porter). The index is built in batch; a
table (term, doc_id, tf) and the lengths; maintain_index() renews what changed, and segments.py keeps an index whose changes cost what they
touch. ranked() joins the query's few terms
with the index, so only their postings move; search() needs no index: it counts the query's stems in one pass over the texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.state import materialise, scoped

K1, B = 1.2, 0.75
_VOWEL = "aeiou"


def _shape(word: str) -> str:
    """v and c for vowels and consonants; y is a vowel behind a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in _VOWEL or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _cvc(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


#: Suffixes of Porter's algorithm (1980) with what replaces them, longest first where they overlap.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")


def porter(word: str) -> str:
    """The stem of a lower-case English word."""
    if len(word) < 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            stem = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _shape(stem):
                word = stem
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _cvc(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for steps in (STEP2, STEP3):
        for suffix, put in sorted(steps, key=lambda s: -len(s[0])):
            if word.endswith(suffix):
                stem = word[: -len(suffix)]
                word = stem + put if _measure(stem) > 0 else word
                break
    for suffix in STEP4:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _cvc(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def folded(text: str) -> str:
    text = text.lower()
    return text if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", text))


_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[" + "".join(chr(c) for c in range(0x250, 0x10000) if unicodedata.combining(chr(c))) + "]")


@lru_cache(maxsize=1 << 18)
def _stem(word: str) -> str:
    return porter(word) if word.isascii() and word.isalpha() else word


def stems(text: str) -> list[str]:
    return [_stem(w) for w in _WORD.findall(folded(text))]


def simple_terms(c: Column) -> Column:
    """Words as the JVM finds them: lower case, no stemming."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), 0)


def and_terms(phrase: str) -> list[str]:
    """Words that all must be there; other marks in a word drop out."""
    words = ("".join(ch for ch in w if ch.isalnum() or ch == "_") for w in phrase.split())
    return [w for w in words if w]


def or_terms(phrase: str) -> list[str]:
    """ASCII words of which one must be there; without any, nothing matches."""
    return re.findall(r"[A-Za-z0-9]+", phrase)


def query_stems(words: list[str]) -> list[str]:
    """The stems that a query's words ask for."""
    return sorted({s for w in words for s in stems(w)})


def forms(stem: str) -> list[str]:
    """The words up to two suffixes of Porter's tables longer than stem that have this stem."""
    ends = {"", "e", "s", "es", "ed", "ing", "y", "ly", "er", *(x for x, _ in (*STEP2, *STEP3)), *STEP4}
    found = {stem + a + b + c for a in ends for b in ends for c in ("", "s")} | {stem[:-1] + "y" if stem.endswith("i") else stem}
    return sorted(w for w in found if porter(w) == stem)


def _counts(texts: pa.Array, wanted: list[str]) -> list[pa.Array]:
    """Of each text the number of its words, and of those with each wanted stem."""
    known: dict[str, int] = {}
    place = {stem: i for i, stem in enumerate(wanted)}
    sizes, counts = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(wanted)), np.int32)
    for i, text in enumerate(texts.to_pylist()):
        words = _WORD.findall(folded(text or ""))
        sizes[i] = len(words)
        for w in words:
            at = known.get(w)
            if at is None:
                if len(known) > 1_000_000:
                    known.clear()
                at = known[w] = place.get(_stem(w), -1)
            if at >= 0:
                counts[i, at] += 1
    return [pa.array(sizes), pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * len(wanted), counts.ravel())]


def word_counts(docs: DataFrame, key: str, text: str, wanted: list[str]) -> DataFrame:
    """key, length and counts: how often each wanted stem stands in a text. One pass, no shuffle."""
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *_counts(batch.column(1), wanted)], names=[key, "length", "counts"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("length", T.LongType()), T.StructField("counts", T.ArrayType(T.IntegerType()))])
    return docs.select(key, text).mapInArrow(run, schema)


def matching(docs: DataFrame, key: str, text: str, wanted: list[str], every: bool) -> DataFrame:
    """Keys of the texts with all wanted stems, or any of them."""
    if not wanted:
        return docs.select(key).limit(0)
    found = lambda test: test("counts", lambda n: n > 0)
    return word_counts(docs, key, text, wanted).filter(found(F.forall if every else F.exists)).select(key)


@scoped
def search(docs: DataFrame, key: str, text: str, wanted: list[str], every: bool, k: int, skip: DataFrame | None = None) -> DataFrame:
    """The k best of the matching texts by BM25 over stems, ties by key; skip: keys to leave out. Statistics are over all texts."""
    wanted = sorted(set(wanted))
    if not wanted:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    counted = materialise(word_counts(docs, key, text, wanted), "counts")  # narrow, so the texts are read once for statistics and hits
    at = [F.col("counts")[i] for i in range(len(wanted))]
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count_if(c > 0).alias(f"df{i}") for i, c in enumerate(at)))
    idf = [F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))) for i in range(len(wanted))]
    part = [w * c * (K1 + 1) / (c + K1 * (1 - B + B * F.col("length") / F.col("mean"))) for w, c in zip(idf, at, strict=True)]
    hits = counted.filter((F.forall if every else F.exists)("counts", lambda n: n > 0))
    if skip is not None:
        hits = hits.join(skip, key, "left_anti")
    scored = hits.join(F.broadcast(stats)).select(key, sum(part[1:], part[0]).alias("score"))  # stats is one row
    return scored.orderBy(F.desc("score"), key).limit(k).select(key, F.round("score", 6).alias("score"))


def build_index(docs: DataFrame, key: str, terms: Column) -> tuple[DataFrame, DataFrame]:
    """(term, key, tf) and (key, length). terms: an array of each row's words."""
    rows = docs.select(key, terms.alias("terms"))
    postings = rows.select(key, F.explode("terms").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))
    return postings, rows.select(key, F.size("terms").alias("length"))


def simple_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf) of simple_terms(), and for each row its number of words as the tf of the empty term."""
    rows = docs.select(key, F.coalesce(simple_terms(F.col(text)), F.array().cast("array<string>")).alias("terms"))
    postings = rows.select(key, F.explode("terms").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))
    return postings.unionByName(rows.select(F.lit("").alias("term"), key, F.size("terms").cast("long").alias("tf")))


def stemmed_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """simple_rows() of folded stems. A text's postings are counted where the text is, so nothing is shuffled; key names one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(stems(t or "")) for t in batch.column(1).to_pylist()]
            row = np.repeat(np.arange(len(counts)), [len(c) + 1 for c in counts])
            terms, tf = [w for c in counts for w in ("", *c)], [n for c in counts for n in (c.total(), *c.values())]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), batch.column(0).take(pa.array(row)), pa.array(tf, pa.int64())], names=["term", key, "tf"])

    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField(key, docs.schema[key].dataType), T.StructField("tf", T.LongType())])
    return docs.select(key, text).mapInArrow(run, schema)


def build_stemmed_index(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """build_index() over folded stems, written in one pass over the texts."""
    rows = materialise(stemmed_rows(docs, key, text), "stems")
    return rows.filter("term <> ''"), rows.filter("term = ''").select(key, F.col("tf").alias("length"))


def maintain_index(index: tuple[DataFrame, DataFrame], key: str, terms: Column, changed: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index after changed rows (new or replaced) and without the keys of gone; untouched postings stay as they are."""
    touched = changed.select(key).unionByName(gone.select(key)).distinct()
    added = build_index(changed, key, terms)
    return tuple(old.join(touched, key, "left_anti").unionByName(new) for old, new in zip(index, added, strict=True))


def ranked(postings: DataFrame, lengths: DataFrame, key: str, wanted: list[str], every: bool, k: int, skip: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """The k best of the matching documents by BM25, ties by key; skip: keys to leave out.

    Statistics are over all documents; stats has them as n and mean if they are known. Only the wanted terms' postings are read, and the lengths of their documents.
    """
    wanted = sorted(set(wanted))
    if not wanted:
        return lengths.select(key, F.lit(0.0).alias("score")).limit(0)
    own = postings.filter(F.col("term").isin(wanted))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean")) if stats is None else stats
    counts = own.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weights = F.broadcast(counts.join(F.broadcast(stats)).select("term", "mean", idf.alias("idf")))  # a row for each query word
    hits = own.join(weights, "term").join(lengths, key)
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = hits.groupBy(key).agg(F.sum(part).alias("score"), F.count("*").alias("matched"))
    if every:
        scored = scored.filter(F.col("matched") == len(wanted))
    if skip is not None:
        scored = scored.join(skip, key, "left_anti")
    return scored.orderBy(F.desc("score"), key).limit(k).select(key, F.round("score", 6).alias("score"))
