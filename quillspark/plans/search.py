"""Search over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import state
from quillspark.operators import search as S
from quillspark.operators.segments import SegmentedIndex
from quillspark.registry import query, spread, table
from quillspark.sources.commits import Store

def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


#: Words with accents folded; a mark between letters drops out as it does in the library.
_WORDS = r"regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+')"


def _any_form(*stems: str) -> str:
    """A list of all words with these stems, for the oracle."""
    return "[" + ", ".join(f"'{w}'" for s in stems for w in S.forms(s)) + "]"


def _stem_cases(*stems: str) -> str:
    return "CASE " + " ".join(f"WHEN list_contains({_any_form(s)}, word) THEN '{s}'" for s in stems) + " END"


_BM25 = """WITH w AS (SELECT doc_id, unnest({words}) AS word FROM documents),
l AS (SELECT doc_id, len({words}) AS len FROM documents),
s AS (SELECT count(*) AS n, avg(len) AS mean FROM l),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {cases} AS term FROM w) WHERE term IS NOT NULL GROUP BY 1, 2),
i AS (SELECT term, greatest(1e-6, ln((n - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM t, s GROUP BY term, n),
r AS (SELECT t.doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM t JOIN i USING (term) JOIN l ON l.doc_id = t.doc_id, s
WHERE {where} GROUP BY t.doc_id HAVING count(*) >= {least})
SELECT doc_id, round(score, 6) AS score FROM r ORDER BY r.score DESC, doc_id LIMIT 20"""


@query(f"SELECT doc_id FROM documents WHERE list_has_any({_WORDS}, {_any_form('thing')}) AND list_has_any({_WORDS}, {_any_form('and')})")
def fts1_all_words(spark: SparkSession, d: str) -> DataFrame:
    return S.matching(_docs(spark, d), "doc_id", "text", S.query_stems(S.and_terms("things, AND")), True)


@query(f"SELECT doc_id FROM documents WHERE list_has_any({_WORDS}, {_any_form('thing', 'heit')})")
def fts2_any_word(spark: SparkSession, d: str) -> DataFrame:
    return S.matching(_docs(spark, d), "doc_id", "text", S.query_stems(S.or_terms("thing; heit 漢字")), False)


@query(_BM25.format(words=_WORDS, cases=_stem_cases("thing", "er"), where="t.doc_id NOT IN (SELECT doc_id FROM labels)", least=2))
def fts3_library_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The best matches of all words, without documents that are attached already."""
    return S.search(_docs(spark, d), "doc_id", "text", S.query_stems(S.and_terms("thing er")), True, 20, table(spark, d, "labels").select("doc_id"))


@query(_BM25.format(words=_WORDS, cases=_stem_cases("thing", "er", "heit"), where="true", least=1))
def fts4_memory_top_k(spark: SparkSession, d: str) -> DataFrame:
    return S.search(_docs(spark, d), "doc_id", "text", S.query_stems(S.or_terms("things er heit")), False, 20)


_CHANGED = r"WITH n AS (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN reverse(text) ELSE text END AS text FROM documents WHERE doc_id % 10 <> 0), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM n) SELECT term, count(DISTINCT doc_id) AS df, count(*)::BIGINT AS tf FROM w GROUP BY 1"


@query(_CHANGED)
def fts5_maintained_index(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the index after replaced and deleted documents."""
    docs, words = _docs(spark, d), S.simple_terms(F.col("text"))
    changed = docs.filter("doc_id % 10 = 1").withColumn("text", F.reverse("text"))
    postings, _ = S.maintain_index(S.build_index(docs, "doc_id", words), "doc_id", words, changed, docs.filter("doc_id % 10 = 0").select("doc_id"))
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(_CHANGED)
def fts5_segments(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of an index in segments, after insertions in parts, replaced and deleted documents, and merges."""
    docs = _docs(spark, d)
    index = SegmentedIndex(Store(spark, state.new_path(spark, "index")), "doc_id", lambda rows: S.simple_rows(rows, "doc_id", "text"), tier=3)
    index.change(docs.filter("doc_id % 3 = 0"))
    index.change(docs.filter("doc_id % 3 > 0"))
    index.change(docs.filter("doc_id % 10 = 1").withColumn("text", F.reverse("text")), docs.filter("doc_id % 10 = 0"))
    return index.postings().filter("term <> ''").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(_BM25.format(words=_WORDS, cases=_stem_cases("thing", "er", "heit"), where="true", least=1))
def fts5_segment_search(spark: SparkSession, d: str) -> DataFrame:
    """The best matches from an index in segments, of which the second replaces texts of the first."""
    docs = _docs(spark, d)
    index = SegmentedIndex(Store(spark, state.new_path(spark, "index")), "doc_id", lambda rows: S.stemmed_rows(rows, "doc_id", "text"))
    index.change(docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("thing "), F.col("text"))).otherwise(F.col("text"))))
    index.change(docs.filter("doc_id % 2 = 0"))
    return index.search(S.query_stems(S.or_terms("things er heit")), False, 20)


@query()
def fts5_stemmed_index(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies of the stemmed index."""
    postings, _ = S.build_stemmed_index(_docs(spark, d), "doc_id", "text")
    return postings.groupBy("term").agg(F.count("*").alias("df"))


@query(r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*)::BIGINT AS tf FROM w GROUP BY 1")
def fts5_index_statistics(spark: SparkSession, d: str) -> DataFrame:
    postings, _ = S.build_index(_docs(spark, d), "doc_id", S.simple_terms(F.col("text")))
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
