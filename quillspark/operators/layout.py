"""Layout blocks of documents: section names, groups and their children, and block-anchored chunks.

A block: doc, pos, block_id, block_type, html, latex, hierarchy (map of level to block id), bbox, page, caption. Everything up to
the pieces is joins and windows; only the token-budgeted cut depends on what came before, so it runs over sorted partitions
of whole documents, a batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import columns as C
from quillspark.functions import documents as D

BLOCKS = "doc long, pos int, block_id string, block_type string, html string, latex string, hierarchy map<string,string>, bbox array<double>, page int, caption string"
GROUPS = ("TableGroup", "FigureGroup", "PictureGroup")
FIGURES = ("Figure", "Picture")
CHUNKS = "doc long, ordinal int, section string, char_start long, char_end long, text string, page int, bbox array<double>, layout_kind string, layout_caption string"


def deepest(hierarchy: Column) -> Column:
    """The block id at the greatest level of a hierarchy."""
    return F.when(F.size(hierarchy) > 0, F.element_at(hierarchy, F.array_max(F.map_keys(hierarchy))))


def with_sections(blocks: DataFrame) -> DataFrame:
    """blocks with own_section, the name their deepest header reference or own heading gives, else null."""
    title = C.strip_tags(F.col("html"))
    heads = blocks.filter((F.col("block_type") == "SectionHeader") & (title != "")).select("doc", F.col("block_id").alias("__ref"), title.alias("__name"))
    rows = blocks.withColumn("__ref", deepest(F.col("hierarchy"))).join(heads, ["doc", "__ref"], "left").drop("__ref")
    own = F.when((F.col("block_type") == "SectionHeader") & (title != ""), title).otherwise(F.col("__name"))
    return rows.withColumn("own_section", own).drop("__name")


def filled_sections(blocks: DataFrame) -> DataFrame:
    """with_sections() and section: the last one named so far; groups and figures before any take the next one."""
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("doc").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    last, following = F.last("own_section", ignorenulls=True).over(before), F.first("own_section", ignorenulls=True).over(behind)
    floats = F.col("block_type").isin(*GROUPS, *FIGURES)
    return with_sections(blocks).withColumn("section", F.coalesce(last, F.when(floats, following)))


def group_children(blocks: DataFrame) -> DataFrame:
    """(doc, group_id, ordinal, child_id): what each group's content references name."""
    refs = F.regexp_extract_all("html", F.lit(r"content-ref\s+src=['\"]([^'\"]+)['\"]"), 1)
    groups = blocks.filter(F.col("block_type").isin(*GROUPS))
    return groups.select("doc", F.col("block_id").alias("group_id"), F.posexplode(refs).alias("ordinal", "child_id"))


def standalone(blocks: DataFrame) -> DataFrame:
    """blocks that are rendered themselves: no page furniture, no table cells, no children of groups."""
    taken = group_children(blocks).select("doc", F.col("child_id").alias("block_id")).distinct()
    return blocks.filter(~F.col("block_type").isin("PageFooter", "PageHeader", "TableCell")).join(taken, ["doc", "block_id"], "left_anti")


def rendered_groups(blocks: DataFrame) -> DataFrame:
    """(doc, group_id, text, kind, caption, boxes): a group's caption over its table, from its children."""
    told = F.when(F.col("block_type").isin("Caption", "Table", *FIGURES), F.col("html")).alias("html")  # of other children only the box counts
    child = blocks.select("doc", "block_id", "block_type", told, "caption", "bbox").select("doc", F.col("block_id").alias("child_id"), "block_type", "html", F.trim(F.coalesce("caption", C.strip_tags(F.col("html")))).alias("said"), F.col("bbox").alias("box"))
    rows = group_children(blocks).join(child, ["doc", "child_id"])
    is_caption, is_table, is_figure = F.col("block_type") == "Caption", F.col("block_type") == "Table", F.col("block_type").isin(*FIGURES)
    said = F.when((is_caption | is_figure) & (F.col("said") != ""), F.col("said"))
    rows = rows.withColumn("md", F.when(is_table, D.table_markdown("html")))
    out = rows.groupBy("doc", "group_id").agg(
        F.max_by(said, F.struct(F.when(said.isNotNull(), F.when(is_caption, 2).otherwise(1)).otherwise(0), F.when(is_caption, F.col("ordinal")).otherwise(-F.col("ordinal")))).alias("caption"),
        F.max_by("md", F.when(F.length("md") > 0, F.col("ordinal")).otherwise(-1)).alias("table"),
        F.bool_or(is_table).alias("has_table"), F.bool_or(is_figure).alias("has_figure"), F.collect_list("box").alias("boxes"),
    )
    kind = F.when(F.col("has_table"), "table").when(F.col("has_figure"), "figure")
    text = F.concat_ws("\n\n", F.when(F.col("caption").isNotNull(), F.concat(F.lit("*"), F.col("caption"), F.lit("*"))), F.when(F.length("table") > 0, F.col("table")))
    return out.select("doc", "group_id", text.alias("text"), kind.alias("kind"), "caption", "boxes")


def pieces(blocks: DataFrame) -> DataFrame:
    """doc, pos, section, page, text, boxes, atomic, kind, caption: what each rendered block contributes."""
    own = standalone(filled_sections(blocks)).select(F.col("*"))
    groups = rendered_groups(blocks).withColumnRenamed("group_id", "block_id").withColumnsRenamed({"text": "__text", "kind": "__kind", "caption": "__caption", "boxes": "__boxes"})
    rows = own.join(groups, ["doc", "block_id"], "left")
    said, kind = C.strip_tags(F.col("html")), F.col("block_type")
    caption = F.trim(F.coalesce("caption", said))
    text = (
        F.when(kind == "SectionHeader", F.when(said != "", F.concat(F.lit("## "), said))).when(kind.isin(*GROUPS), F.col("__text"))
        .when(kind == "Equation", F.when(F.trim("latex") != "", F.concat(F.lit("$$ "), F.trim("latex"), F.lit(" $$")))).when(kind == "Table", D.table_markdown("html"))
        .when(kind.isin(*FIGURES), F.when(caption != "", F.concat(F.lit("*"), caption, F.lit("*")))).otherwise(said)
    )
    own_box = F.when(F.size("bbox") > 0, F.array("bbox"))
    out = rows.select(
        "doc", "pos", "section", "page", text.alias("text"), F.coalesce(own_box, "__boxes", F.expr("cast(array() as array<array<double>>)")).alias("boxes"),
        kind.isin(*GROUPS, "Table", *FIGURES).alias("atomic"),
        F.when(kind.isin(*GROUPS), F.col("__kind")).when(kind == "Table", "table").when(kind.isin(*FIGURES), "figure").alias("kind"),
        F.when(kind.isin(*GROUPS), F.col("__caption")).when(kind.isin(*FIGURES), caption).alias("caption"),
    )
    return out.filter(F.length("text") > 0)


def assemble(blocks: DataFrame, target: int = 800, hard: int = 1000, count: Callable[[str], int] = D.rough_tokens) -> DataFrame:
    """Chunks of one section and page each, within the token budget; tables and figures stand alone.

    Blocks are dealt out by document once, and joins on a document and an id find them so: that takes a setting of the session.
    """

    def cut(rows: list) -> list[tuple]:
        runs: list[list] = []
        tokens = 0
        for r in rows:
            n = count(r.text)
            last = runs[-1][-1] if runs else None
            joins = last is not None and not r.atomic and not last.atomic and (last.section, last.page) == (r.section, r.page) and tokens < target and tokens + n <= hard
            if joins:
                runs[-1].append(r)
                tokens += n
            else:
                runs.append([r])
                tokens = n
        out, at = [], 0
        for i, run in enumerate(runs):
            text = "\n\n".join(r.text for r in run)
            boxes = [b for r in run for b in r.boxes if b is not None and len(b) >= 4]
            box = [min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)] if boxes else None
            out.append((run[0].doc, i, run[0].section, at, at + len(text), text, run[0].page, box, run[0].kind, run[0].caption))
            at += len(text) + 2
        return out

    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def cut_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Documents come whole and in order, but a batch may end within one, whose rows wait for the next."""
        waiting: list = []
        for pdf in batches:
            out: list[tuple] = []
            for r in pdf.itertuples(index=False):
                if waiting and waiting[-1].doc != r.doc:
                    out += cut(waiting)
                    waiting = []
                waiting.append(r)
            yield pd.DataFrame(out, columns=names)
        if waiting:
            yield pd.DataFrame(cut(waiting), columns=names)

    blocks.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    rows = pieces(blocks.repartition("doc")).repartition("doc").sortWithinPartitions("doc", "pos").mapInPandas(cut_all, CHUNKS)
    return rows.withColumn("layout_label", C.layout_label(F.col("layout_caption"))).withColumn("match_text", C.strip_markdown(F.col("text")))


def layout_index(chunks: DataFrame) -> DataFrame:
    """doc, layout: the tables and figures in document order."""
    entry = F.struct("ordinal", F.col("layout_kind").alias("kind"), F.col("layout_label").alias("label"), F.col("layout_caption").alias("caption"), "page")
    return chunks.filter("layout_kind is not null").groupBy("doc").agg(F.sort_array(F.collect_list(entry)).alias("layout"))


def find_label(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc, label) with the chunk of that label, case and spaces at the ends ignored."""
    rows = index.select("doc", F.explode("layout").alias("e")).select("doc", F.lower(F.trim("e.label")).alias("__key"), F.col("e.ordinal").alias("ordinal"))
    return wanted.withColumn("__key", F.lower(F.trim("label"))).join(rows, ["doc", "__key"], "left").drop("__key")


def headings(spans: DataFrame, low: float = 1.0) -> DataFrame:
    """Headings among font spans (doc, page from 0, pos, text, size): larger than the body's font, smaller than the title's.

    The body's font is the one most characters have, the title's the largest of the first page. Names of 3 to 120 characters count, those
    that repeat don't.
    """
    sizes = spans.groupBy("doc", "size").agg(F.sum(F.length(F.trim("text"))).alias("__chars"), F.max(F.col("page") == 0).alias("__first"))
    body = sizes.groupBy("doc").agg(F.max_by("size", F.struct("__chars", -F.col("size"))).alias("__body"), F.max(F.when(F.col("__first"), F.col("size"))).alias("__title"))
    rows = spans.join(body, "doc").filter((F.col("size") >= F.col("__body") + low) & (F.col("__title").isNull() | (F.col("size") < F.col("__title"))))
    rows = rows.withColumn("name", C.squeeze(F.col("text"))).filter(F.length("name").between(3, 120))
    return rows.withColumn("__n", F.count("*").over(Window.partitionBy("doc", "name"))).filter("__n = 1").select("doc", "page", "pos", "name")


def aligned_groups(groups: DataFrame, frames: DataFrame) -> DataFrame:
    """(deck, frame, pages): page groups zipped with frames when there are as many, or one more (a leading title); else null pages.

    groups: deck, g, pages; frames: deck, frame. Both are numbered from 0.
    """
    counts = groups.groupBy("deck").agg(F.count("*").alias("ng")).join(frames.groupBy("deck").agg(F.count("*").alias("nf")), "deck")
    shift = F.when(F.col("ng") == F.col("nf"), 0).when(F.col("ng") == F.col("nf") + 1, 1)
    rows = frames.join(counts.select("deck", shift.alias("shift")), "deck", "left").withColumn("g", F.col("frame") + F.col("shift"))
    return rows.join(groups, ["deck", "g"], "left").select("deck", "frame", "pages")


def schema() -> T.StructType:
    return T.StructType.fromDDL(BLOCKS)
