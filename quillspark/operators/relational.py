"""Relational operators of the library as functions from DataFrames to DataFrames.

Each is one declarative plan: Catalyst picks join strategies, aggregates are pre-aggregated per task, and ordered logic is
a window over the natural key, never over the whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import columns as C
from quillspark.operators.ranking import forest_order
from quillspark.state import materialise, scoped

COL = F.col
Keys = Sequence[str]


def visible(is_global: Column, is_own_kind: Column, owned: Column) -> Column:
    """Global rows, and rows of the own kind that the owner has."""
    return is_global | (is_own_kind & owned)


def contains_all(df: DataFrame, columns: Keys, phrase: str) -> DataFrame:
    """Rows where each word of phrase is in one of the columns, letters and digits compared, case ignored."""
    for word in phrase.split():
        key = "".join(ch for ch in word.lower() if ch.isalnum())
        if key:
            test = F.lit(False)
            for c in columns:
                test = test | F.contains(C.alnum(F.col(c)), F.lit(key))
            df = df.filter(test)
    return df


def expired(df: DataFrame, column: str, now: Column, days: int) -> DataFrame:
    """Rows older than days before now, strictly."""
    return df.filter(F.col(column) < now - F.make_dt_interval(F.lit(days)))


def describe(df: DataFrame) -> DataFrame:
    """(name, type) of each column."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "name string, type string")


def list_tables(spark: SparkSession, allowed: Keys) -> DataFrame:
    return spark.createDataFrame([(n,) for n in sorted(allowed)], "name string")


SECTIONS = "array<struct<name: string, char_start: bigint, char_end: bigint, token_count: bigint, chunk_count: bigint>>"


def section_toc(sections_json: Column) -> Column:
    """name, tokens and chunks of each stored section; null if the JSON is missing or broken."""
    return F.transform(F.from_json(sections_json, SECTIONS), lambda s: F.struct(s["name"].alias("name"), s["token_count"].alias("tokens"), s["chunk_count"].alias("chunks")))


def clip(c: Column, size: int) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substr(c, F.lit(1), F.lit(size)), F.lit("…"))).otherwise(c)


def layout_line(label: Column, kind: Column, page: Column, chunk: Column, caption: Column) -> Column:
    """An index line of a figure or table; null where the label is."""
    return F.concat(F.lit("- "), label, F.lit(" ("), kind, F.lit(", p."), page.cast("string"), F.lit(") [chunk:"), chunk.cast("string"), F.lit("]: "), F.coalesce(caption, F.lit("")))


def child_summary(parents: DataFrame, children: DataFrame, key: str, child_key: str, counted: str, dated: str, never: Column) -> DataFrame:
    """Each parent with the count and the newest date of its children; the children are grouped before the join."""
    newest = children.groupBy(child_key).agg(F.count(counted).alias("__n"), F.max(dated).alias("__last"))
    rows = parents.join(newest, F.col(key) == F.col(child_key), "left")
    return rows.select(*parents.columns, F.coalesce("__n", F.lit(0)).alias("n_messages"), F.coalesce("__last", never).alias("last_at"))


def resolve_picks(known: DataFrame, key: str, picks: Sequence[int]) -> DataFrame:
    """(key, pos) of picked keys that are known, in pick order, the first of repeats."""
    chosen = known.sparkSession.createDataFrame([(p, i) for i, p in enumerate(dict.fromkeys(picks))], f"{key} long, __order int")
    first = {p: picks.index(p) for p in picks}
    chosen = chosen.withColumn("pos", F.element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), F.col(key)) if first else F.lit(None).cast("int"))
    return known.join(F.broadcast(chosen), key).orderBy("__order").select(key, "pos")


def fresh_ids(rows: DataFrame, key: str, above: int) -> DataFrame:
    """(key, new_id): gapless ids above a bound in key order, numbered within ranges, so no task sorts everything.

    A range's first number is the count of the ranges before it: a small table, one row a range.
    """
    spread = rows.select(key).distinct().repartitionByRange(F.col(key)).withColumn("__part", F.spark_partition_id())
    spread = spread.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(key)))
    sizes = spread.groupBy("__part").agg(F.max("__n").alias("__size"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(ahead), F.lit(0)).alias("__start"))
    return spread.join(F.broadcast(starts), "__part").select(key, (F.col("__start") + F.col("__n") + above).alias("new_id"))


def remap(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """rows with new_id of column by mapping (its first column, new_id); unmapped and null values stay null."""
    old = mapping.columns[0]
    return rows.join(mapping.withColumnRenamed(old, "__old"), F.col(column) == F.col("__old"), "left").drop("__old")


def asof_backward(rows: DataFrame, marks: DataFrame, key: str, at: str, mark: str) -> DataFrame:
    """rows with the last mark of their key at or before them, else null: one union, one sort per key."""
    values = [c for c in marks.columns if c not in (key, mark)]
    left = rows.withColumn("__side", F.lit(1)).withColumn("__at", F.col(at))
    right = marks.select(F.col(key), F.struct(mark, *values).alias("__mark"), F.lit(0).alias("__side"), F.col(mark).alias("__at"))
    both = left.unionByName(right, allowMissingColumns=True)
    so_far = Window.partitionBy(key).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__last", F.last("__mark", ignorenulls=True).over(so_far)).filter("__side = 1")
    return found.select(*rows.columns, *[F.col(f"__last.{c}").alias(c) for c in (mark, *values)])


def interval_overlap(a: DataFrame, b: DataFrame, start: str, end: str, cell: int) -> DataFrame:
    """Pairs of half-open intervals that overlap: an equi-join on grid cells, each pair met in its first common cell only."""
    cells = lambda: F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor((F.col(end) - 1) / cell)))
    left = a.withColumn("__cell", cells()).withColumnsRenamed({start: "__as", end: "__ae"})
    right = b.withColumn("__cell", cells()).withColumnsRenamed({start: "__bs", end: "__be"})
    met = left.join(right, "__cell").filter((F.col("__as") < F.col("__be")) & (F.col("__ae") > F.col("__bs")))
    return met.filter(F.col("__cell") == F.floor(F.greatest("__as", "__bs") / cell)).drop("__cell")


def lookup_with_fallback(wanted: DataFrame, name: str, known: DataFrame, known_name: str, value: str) -> DataFrame:
    """The value of each wanted name: of the equal name, else of the name equal but for case and spaces; the smallest of several."""
    exact = known.groupBy(F.col(known_name).alias("__exact")).agg(F.min(value).alias("__v1"))
    loose = known.groupBy(C.section_key(F.col(known_name)).alias("__loose")).agg(F.min(value).alias("__v2"))
    rows = wanted.join(exact, F.col(name) == F.col("__exact"), "left").join(loose, C.section_key(F.col(name)) == F.col("__loose"), "left")
    return rows.select(*wanted.columns, F.coalesce("__v1", "__v2").alias(value))


def section_index(chunks: DataFrame, doc: str, tokens: Callable[[Column], Column]) -> DataFrame:
    """Per document and section: extent, number of chunks, and tokens of its joined text; chunks without section don't count."""
    rows = chunks.filter(F.col("section").isNotNull()).groupBy(doc, F.col("section").alias("name")).agg(
        F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.count("*").alias("chunk_count"), F.sort_array(F.collect_list(F.struct("char_start", "text"))).alias("__parts")
    )
    text = F.array_join(F.transform("__parts", lambda p: p["text"]), "\n\n")
    return rows.withColumn("token_count", tokens(text).cast("long")).drop("__parts")


def section_index_of_source(chunks: DataFrame, texts: DataFrame, doc: str, text: str, tokens: Callable[[Column], Column]) -> DataFrame:
    """section_index() with the tokens of the source from a section's first character to its last, what lies between chunks included."""
    rows = section_index(chunks, doc, F.length).drop("token_count").join(texts.select(doc, F.col(text).alias("__source")), doc)
    cut = F.substr("__source", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return rows.withColumn("token_count", tokens(cut).cast("long")).drop("__source")


def joined_text(rows: DataFrame, keys: Keys, order: Keys, text: str, between: str, name: str) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct(*order, text)))
    return rows.groupBy(*keys).agg(parts.alias("__parts")).select(*keys, F.array_join(F.transform("__parts", lambda p: p[text]), between).alias(name))


def weighted_mode(rows: DataFrame, keys: Keys, value: str, weight: str) -> DataFrame:
    """The value of the greatest total weight per key, the smallest of equals."""
    totals = rows.groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    return totals.groupBy(*keys).agg(F.max_by(value, F.struct("__w", -F.col(value))).alias(value))


def box_union(rows: DataFrame, keys: Keys, box: str) -> DataFrame:
    """The smallest box around the boxes of four numbers; null if there is none."""
    at = lambda i: F.when(F.size(box) >= 4, F.col(box)[i])
    united = rows.groupBy(*keys).agg(F.min(at(0)).alias("__0"), F.min(at(1)).alias("__1"), F.max(at(2)).alias("__2"), F.max(at(3)).alias("__3"))
    return united.select(*keys, F.when(F.col("__0").isNotNull(), F.array("__0", "__1", "__2", "__3")).alias("box"))


def islands(rows: DataFrame, keys: Keys, order: Keys, value: str) -> DataFrame:
    """rows with island, which counts the runs of equal value; null values stand alone."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.lag(value).over(w) == F.col(value), 0).otherwise(1)
    return rows.withColumn("__new", changed).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def running_offsets(rows: DataFrame, keys: Keys, order: Keys, text: str, gap: int) -> DataFrame:
    """char_start and char_end of each piece in the text that joins them with a gap."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.length(text).cast("long") + gap).over(w)
    return rows.withColumn("char_end", upto - gap).withColumn("char_start", F.col("char_end") - F.length(text))


def first_occurrence(rows: DataFrame, keys: Keys, order: Keys) -> DataFrame:
    """One row of each key, the first by order: a minimum, not a window, so repeats combine before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    least = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("__first")
    return rows.groupBy(*keys).agg(least).select(*[F.col(c) if c in keys else F.col(f"__first.{c}") for c in rows.columns])


def cap_flags(rows: DataFrame, keys: Keys, order: Keys, flag: Column, most: int, name: str) -> DataFrame:
    """rows with the flag kept for the first `most` flagged ones; later ones stay, unflagged."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__flag", flag).withColumn(name, F.col("__flag") & (F.sum(F.col("__flag").cast("int")).over(w) <= most)).drop("__flag")


def merge_spans(rows: DataFrame, keys: Keys, start: str, end: str) -> DataFrame:
    """Unions of spans that overlap; spans that only touch stay apart."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("__new", F.when(reach.isNull() | (F.col(start) >= reach), 1).otherwise(0))
    marked = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def frame_pages(frames: DataFrame, keys: Keys, frame: str, pages: str) -> DataFrame:
    """One row per page of each frame, numbered through the deck."""
    w = Window.partitionBy(*keys).orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
    upto = frames.withColumn("__end", F.sum(pages).over(w))
    return upto.select(*keys, frame, F.explode(F.sequence(F.col("__end") - F.col(pages) + 1, F.col("__end"))).alias("page"))


def page(rows: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of 1 to 200 rows."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(200, max(1, limit)))


def _greedy(parts: list[tuple[str, int, list[str]]], threshold: float) -> list[tuple[int, int, float]]:
    """(target, candidate, score) of one document. Candidates are counted from lists of those that hold a token, so only those that share one are met;
    the first of equals is taken.
    """
    rows = sorted(parts, key=lambda r: r[1])
    last = {c: set(t) for s, c, t in rows if s == "candidate"}
    order = sorted(last)
    every, free, held = np.arange(len(order)), np.ones(len(order), bool), {}
    for i, c in enumerate(order):
        for w in last[c]:
            held.setdefault(w, []).append(i)
    held = {w: np.array(at) for w, at in held.items()}
    out = []
    for side, pos, words in rows:
        if side != "target" or not (own := set(words)):
            continue
        lists = [held[w] for w in own if w in held]
        if not lists:
            continue
        met = np.concatenate(lists)
        at, hits = np.unique(met, return_counts=True) if 16 * len(met) < len(order) else (every, np.bincount(met, minlength=len(order)))
        hits = hits * free[at]
        best = int(hits.argmax())  # the first of equals
        best, score = int(at[best]), int(hits[best]) / len(own)
        if score >= threshold and score > 0:
            free[best] = False
            out.append((pos, order[best], score))
    return out


def greedy_overlap(pairs_of: DataFrame, doc: str, threshold: float = 0.6) -> DataFrame:
    """Per document, each target takes the unused candidate with most of its tokens, in target order.

    pairs_of: doc, side (`target` or `candidate`), pos, tokens. The choice depends on the ones before it, so a document's rows
    are gathered in one row; a document is small.
    """

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = batch.column("__rows")
            rows = each.flatten()
            words = iter(rows.field("tokens").flatten().to_pylist())
            sizes = rows.field("tokens").value_lengths().to_pylist()
            parts = zip(rows.field("side").to_pylist(), rows.field("pos").to_pylist(), ([*islice(words, n or 0)] for n in sizes), strict=True)
            found = [_greedy(list(islice(parts, n)), threshold) for n in each.value_lengths().to_pylist()]
            own = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            target, candidate, score = zip(*(x for f in found for x in f), strict=True) if len(own) else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(doc).take(own), pa.array(target, pa.int64()), pa.array(candidate, pa.int64()), pa.array(score, pa.float64())], names=[doc, "target", "candidate", "score"])

    pairs_of.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    schema = T.StructType([pairs_of.schema[doc], T.StructField("target", T.LongType()), T.StructField("candidate", T.LongType()), T.StructField("score", T.DoubleType())])
    return pairs_of.groupBy(doc).agg(F.collect_list(F.struct("side", F.col("pos").cast("long").alias("pos"), "tokens")).alias("__rows")).mapInArrow(match, schema)


def first_theta_match(frames: DataFrame, roles: DataFrame, threshold: float = 0.6) -> DataFrame:
    """For frames without math, the first role (by its pos) whose topic words they hold by the threshold.

    frames: deck, frame, topic, has_math; roles: deck, pos, role. The candidates come from an equi-join on deck and word.
    """
    words = roles.select("deck", "pos", "role", C.topic_tokens(F.translate("role", "_", " ")).alias("words")).withColumn("need", F.size("words"))
    each = words.select("deck", "pos", "role", "need", F.explode("words").alias("word"))
    topic = frames.filter(~F.col("has_math")).select("deck", "frame", F.explode(C.topic_tokens(F.col("topic"))).alias("word"))
    hits = topic.join(each, ["deck", "word"]).groupBy("deck", "frame", "pos", "role", "need").agg(F.count("*").alias("hit"))
    good = hits.filter(F.col("hit") >= threshold * F.col("need"))
    return good.groupBy("deck", "frame").agg(F.min_by("role", "pos").alias("role"))


def _doubled(links: DataFrame, tall: bool) -> DataFrame:
    """Pointer doubling of links (node, up, ...): each round joins every node's ancestor with that one's own.

    tall: the table has no cycles; depth and path grow until every node has reached its root. Otherwise low becomes the
    smallest ancestor; the rounds end when only nodes on or behind cycles are left, and these have seen all their ancestors.
    """
    reach = 1
    while True:
        open_ = links.filter("up is not null")
        left = open_.count()
        if not left or (not tall and reach > left):
            return links
        above = links.select(COL("node").alias("up"), *(COL(c).alias(f"above_{c}") for c in links.columns if c != "node"))
        joined = open_.join(above, "up")
        if tall:
            rows = joined.select("node", COL("above_up").alias("up"), (COL("depth") + COL("above_depth")).alias("depth"), F.concat("above_path", F.lit("/"), "path").alias("path"))
        else:
            rows = joined.select("node", COL("above_up").alias("up"), F.least("low", "above_low").alias("low"))
        links, reach = materialise(links.filter("up is null").unionByName(rows), "tree"), reach * 2


def forest(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, up): every node once with its parent, null at the root of a tree.

    Unknown parents and the node itself as its parent begin trees. Of the nodes on or behind a cycle one begins a tree if it is
    smaller than all that it descends from; the others are its descendants.
    """
    known = nodes.select(COL(node).alias("up"))
    rows = nodes.select(COL(node).alias("node"), COL(parent).alias("up")).filter("node is not null").dropDuplicates(["node"])
    rooted = rows.join(known, "up", "left_anti").unionByName(rows.filter("up = node")).select("node", F.lit(None).cast(rows.schema["node"].dataType).alias("up"))
    links = materialise(rooted.unionByName(rows.filter("up <> node").join(known.distinct(), "up", "left_semi").select("node", "up")), "tree")
    lows = _doubled(links.withColumn("low", COL("up")), False).filter("up is not null and node <= low").select("node")
    cut = links.join(lows.withColumn("cut", F.lit(True)), "node", "left").select("node", F.when(COL("cut").isNull(), COL("up")).alias("up"))
    return materialise(cut, "tree")


@scoped
def tree_order(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """Every node of the forest() once with depth and a path that sorts as depth-first order.

    Any depth takes about log2(depth) joins, but a path is as long as its node is deep; tree_places() gives numbers instead.
    """
    cut = forest(nodes, node, parent)
    cut = materialise(cut.select("node", "up", COL("up").isNotNull().cast("int").alias("depth"), F.lpad(COL("node").cast("string"), 20, "0").alias("path")), "tree")
    return _doubled(cut, True).select(COL("node").alias(node), "depth", "path")


@scoped
def tree_places(nodes: DataFrame, node: str, parent: str, order: str | None = None) -> DataFrame:
    """Every node of the forest() once with depth and its place in depth-first order, siblings and roots by order, then by node."""
    cut = forest(nodes, node, parent)
    if order:
        cut = cut.join(nodes.select(COL(node).alias("node"), COL(order).alias("by")).dropDuplicates(["node"]), "node")
    return forest_order(cut, "node", "up", "by" if order else None).withColumnRenamed("node", node)
