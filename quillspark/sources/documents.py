"""Document sources: TeX folders, PDF text and metadata, layout files, and connectors to outer services.

Files are read by Spark's own readers (whole text or binary), so any store it knows will do. The services need a
network; their DataSources take a fetch function, which tests replace.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspark.functions import columns as C
from quillspark.operators.layout import BLOCKS

LATEX = "dir string, root string, text string, preamble string"
_INCLUDE = re.compile(r"\\(?:input|include)\{([^}]+)\}")
_DOCUMENT = re.compile(r"(?m)^[^%\n]*?(\\(?:begin|end)\{document\})")
#: Names a paper's main file often has.
MAIN_NAMES = ("main", "paper", "ms", "manuscript", "root", "article", "arxiv")
#: Titles that writing programs leave behind.
PLACEHOLDER_TITLE = r"^(untitled|microsoft word - .*|layout \d+|document\d*|presentation\d*)$"


def text_files(spark: SparkSession, path: str, pattern: str = "*.tex") -> DataFrame:
    """(path, content) of text files."""
    return spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def root_score(path: Column, content: Column) -> Column:
    """How likely a TeX file is its paper's root."""
    uncommented = C.strip_comments(content)
    has = lambda p: F.when(uncommented.rlike(p), 1.0).otherwise(0.0)
    sections = F.least(F.lit(10), F.size(F.regexp_extract_all(uncommented, F.lit(r"(\\(?:section|chapter)\b)"), 1)))
    stem = F.lower(F.regexp_extract(path, r"([^/]*)\.tex$", 1))
    return 5 * has(r"\\documentclass") + 10 * has(r"\\title\b") + 5 * has(r"\\maketitle") + sections + F.when(stem.isin(*MAIN_NAMES), 8.0).otherwise(0.0) + F.length(content) / 50000.0


def latex_folders(files: DataFrame, base: str) -> DataFrame:
    """dir, root, text, preamble: of each folder in base its root file with inclusions, cut to the document's body.

    files: path, content. Roots are files right in the folder, chosen by a plan; inclusions may lie deeper. Only the
    inlining, which recurses, takes a folder at a time.
    """
    folder = F.regexp_extract("path", "^(.*?" + re.escape(base.rstrip("/").removeprefix("file:")) + "/[^/]+)/", 1)
    rows = files.withColumn("dir", folder).withColumn("opens", F.col("content").rlike(r"(?m)^[^%\n]*\\begin\{document\}"))
    direct = rows.filter(F.regexp_extract("path", r"^(.*)/[^/]*$", 1) == F.col("dir"))
    top = direct.groupBy("dir").agg(F.min_by("path", F.struct(~F.col("opens"), -root_score(F.col("path"), F.col("content")), "path")).alias("root"))

    def inline(pdf: pd.DataFrame) -> pd.DataFrame:
        folder, root = pdf["dir"].iloc[0], pdf["root"].iloc[0]
        texts, seen = dict(zip(pdf["path"], pdf["content"], strict=True)), {root}

        def put(m: re.Match[str]) -> str:
            name = m.group(1).strip()
            path = posixpath.normpath(posixpath.join(folder, name if name.endswith(".tex") else f"{name}.tex"))
            if path in seen or path not in texts:
                return ""
            seen.add(path)
            return _INCLUDE.sub(put, texts[path])

        flat = _INCLUDE.sub(put, texts[root])
        marks = [(m.group(1), m.start(1), m.end(1)) for m in _DOCUMENT.finditer(flat)]
        begin = next(((a, b) for t, a, b in marks if "begin" in t), (0, 0))
        end = next((a for t, a, _ in marks if "end" in t and a >= begin[1]), len(flat))
        return pd.DataFrame([(folder, root, flat[begin[1] : end].strip(), flat[: begin[0]])], columns=["dir", "root", "text", "preamble"])

    return rows.join(top, "dir").select("dir", "root", "path", "content").groupBy("dir").applyInPandas(inline, LATEX)


def pdf_text(pages: DataFrame, key: str) -> DataFrame:
    """Pages (key, page, text) as one text a document, joined by form feeds. A PDF reader isn't installed here."""
    parts = F.sort_array(F.collect_list(F.struct("page", "text")))
    return pages.groupBy(key).agg(parts.alias("p")).select(key, F.array_join(F.transform("p", lambda x: x["text"]), "\n\f\n").alias("text"))


def pdf_metadata(raw: DataFrame, last_year: int) -> DataFrame:
    """key, title, authors, year of raw metadata (key, title, author, created, modified, first_page: array<struct<text, size>>)."""
    title = C.squeeze(F.col("title"))
    usable = (F.length(title) >= 5) & ~F.lower(title).rlike(PLACEHOLDER_TITLE)
    largest = F.array_max(F.transform("first_page", lambda s: s["size"]))
    from_page = C.squeeze(F.array_join(F.transform(F.filter("first_page", lambda s: s["size"] == largest), lambda s: s["text"]), " "))
    authors = F.filter(F.transform(F.split(F.coalesce("author", F.lit("")), r"\s*;\s*|\s+and\s+"), lambda a: F.trim(a)), lambda a: a != "")
    year = F.coalesce(C.year_of(F.col("created"), last_year), C.year_of(F.col("modified"), last_year))
    return raw.select("key", F.when(usable, title).otherwise(F.nullif(from_page, F.lit(""))).alias("title"), authors.alias("authors"), year.alias("year"))


def layout_files(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of layout JSON files (one object with a list of blocks), numbered in their order; the files are the documents."""
    block = T.StructType.fromDDL(BLOCKS.replace("doc long, pos int, ", "").replace("hierarchy", "section_hierarchy"))
    raw = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", T.StructType([T.StructField("blocks", T.ArrayType(block))])).alias("d"))
    rows = raw.select(F.xxhash64("path").alias("doc"), F.posexplode("d.blocks").alias("pos", "b"))
    return rows.select("doc", "pos", "b.*").withColumnRenamed("section_hierarchy", "hierarchy")


class _Page(InputPartition):
    def __init__(self, url: str) -> None:
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], columns: list[str]) -> None:
        self.urls, self.columns = urls, columns

    def partitions(self) -> list[InputPartition]:
        return [_Page(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from urllib.request import urlopen

        with urlopen(partition.url) as answer:  # noqa: S310
            for row in json.loads(answer.read()):
                yield tuple(row.get(c) for c in self.columns)


class JsonService(DataSource):
    """Rows of services that answer with a JSON list: option urls (one a line) and a schema. A URL is a partition.

    Searches of preprints, citation graphs and open-access links are such services; file: URLs serve for tests.
    """

    @classmethod
    def name(cls) -> str:
        return "json_service"

    def schema(self) -> str:
        return "id string, title string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["urls"].split("\n"), schema.names)


def with_retry(fetch: Callable[[], object], waits: list[float], sleep: Callable[[float], None], retry: tuple[type[Exception], ...]) -> object:
    """fetch(), again after each wait while it fails in a way that may pass."""
    for wait in [*waits, None]:
        try:
            return fetch()
        except retry:
            if wait is None:
                raise
            sleep(wait)
    raise AssertionError


def related(edges: DataFrame, paper: str, mode: str) -> DataFrame:
    """Neighbours in a citation graph (citing, cited): cites, cited_by, or similar (papers that cite what it cites)."""
    own = edges.filter(F.col("citing") == paper).select("cited")
    if mode == "cites":
        return own.select(F.col("cited").alias("paper")).distinct()
    if mode == "cited_by":
        return edges.filter(F.col("cited") == paper).select(F.col("citing").alias("paper")).distinct()
    if mode == "similar":
        return edges.join(own.distinct(), "cited", "left_semi").filter(F.col("citing") != paper).groupBy(F.col("citing").alias("paper")).agg(F.count("*").alias("common"))
    raise ValueError(f"no mode {mode}")
