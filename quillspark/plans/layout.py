"""Layout operators over blocks made from the driver's documents: a line is a block, three blocks a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.operators import layout as L
from quillspark.operators import relational as R
from quillspark.registry import query, spread, table

COL = F.col


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lines as blocks: a header, then text; each page ends in a table group with a caption and a table, and a footer."""
    lines = spread(table(spark, d, "documents").select("doc_id", "text")).select(COL("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line", "html")).filter(F.trim("html") != "")
    bid = F.concat(F.lit("b"), COL("line").cast("string"))
    kind = F.when(COL("line") % 4 == 0, "SectionHeader").when(COL("line") % 4 == 3, "Caption").otherwise("Text")
    head = F.concat(F.lit("b"), (COL("line") - COL("line") % 4).cast("string"))
    box = F.array(F.lit(1.0), COL("line").cast("double"), F.lit(9.0), (COL("line") + 1).cast("double"))
    own = lines.select(
        "doc", (COL("line") * 4 + 1).alias("pos"), bid.alias("block_id"), kind.alias("block_type"), F.concat(F.lit("<p>"), F.regexp_replace("html", "[<>]", ""), F.lit("</p>")).alias("html"), F.lit("").alias("latex"),
        F.when(COL("line") % 4 == 2, F.create_map(F.lit("1"), F.lit("b0"), F.lit("2"), head)).otherwise(F.expr("cast(map() as map<string,string>)")).alias("hierarchy"), box.alias("bbox"), F.floor(COL("line") / 4).cast("int").alias("page"), F.lit(None).cast("string").alias("caption"),
    )
    captions = own.filter("block_type = 'Caption'")
    ref = F.concat(F.lit("<content-ref src='"), COL("block_id"), F.lit("'></content-ref><content-ref src='t"), COL("block_id"), F.lit("'></content-ref>"))
    table_html = F.lit("<table><tr><th>a</th></tr><tr><td>1</td></tr></table>")
    group = captions.withColumn("html", ref).withColumn("block_type", F.lit("TableGroup")).withColumn("pos", COL("pos") - 2).withColumn("block_id", F.concat(F.lit("g"), COL("block_id")))
    cells = captions.withColumn("html", table_html).withColumn("block_type", F.lit("Table")).withColumn("pos", COL("pos") + 1).withColumn("block_id", F.concat(F.lit("t"), COL("block_id")))
    foot = captions.withColumn("block_type", F.lit("PageFooter")).withColumn("pos", COL("pos") + 2).withColumn("block_id", F.concat(F.lit("f"), COL("block_id")))
    return own.unionByName(group).unionByName(cells).unionByName(foot)


_LINES = "WITH l AS (SELECT doc_id AS doc, unnest(range(len(string_split(text, chr(10))))) AS line, string_split(text, chr(10)) AS ls FROM documents), b AS (SELECT doc, line, trim(regexp_replace(ls[line + 1], '[<>]', '', 'g')) AS said FROM l WHERE trim(ls[line + 1]) <> '')"


@query(_LINES + ", h AS (SELECT doc, line, regexp_replace(said, '^\\s+|\\s+$', '', 'g') AS name FROM b WHERE line % 4 = 0), k AS (SELECT b.doc, b.line, CASE WHEN b.line % 4 = 0 THEN h.name WHEN b.line % 4 = 2 THEN (SELECT name FROM h WHERE h.doc = b.doc AND h.line = b.line - 2) END AS own FROM b LEFT JOIN h ON h.doc = b.doc AND h.line = b.line) SELECT doc, 'b' || line AS block_id, nullif(own, '') AS own_section FROM k".replace("\\\\", "\\"))
def joi16_section_of_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return L.with_sections(blocks(spark, d)).filter(COL("block_id").startswith("b")).select("doc", "block_id", "own_section")


@query(_LINES + " SELECT doc, 'gb' || line AS group_id, unnest([0, 1]) AS ordinal, CASE WHEN ordinal = 0 THEN 'b' || line ELSE 'tb' || line END AS child_id FROM b WHERE line % 4 = 3")
def joi15_group_children(spark: SparkSession, d: str) -> DataFrame:
    return L.group_children(blocks(spark, d))


@query(_LINES + " SELECT doc, CASE WHEN line % 4 = 3 THEN 'gb' ELSE 'b' END || line AS block_id FROM b")
def joi15_standalone_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks without page furniture and children of groups."""
    return L.standalone(blocks(spark, d)).select("doc", "block_id")


@query()
def txt4_layout_chunks(spark: SparkSession, d: str) -> DataFrame:
    return L.assemble(blocks(spark, d))


@query(_LINES + r", t AS (SELECT doc, line, regexp_replace(said, '^\s+|\s+$', '', 'g') AS said, line % 4 AS kind FROM b), p AS (SELECT doc, line, CASE WHEN said = '' THEN '' WHEN kind = 0 THEN '##' || said WHEN kind = 3 THEN '*' || said || '*' ELSE said END || CASE WHEN kind = 3 THEN '|a||---||1|' ELSE '' END AS piece FROM t) SELECT doc, true AS gapless, true AS exact, md5(regexp_replace(string_agg(piece, '' ORDER BY line), '\s', '', 'g')) AS said FROM p GROUP BY doc HAVING length(string_agg(piece, '')) > 0")
def txt4_chunk_laws(spark: SparkSession, d: str) -> DataFrame:
    """Chunks are numbered without gaps, offsets follow from the texts, and together they hold each rendered block once, in order."""
    rows = L.assemble(blocks(spark, d)).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("ordinal", "char_start", "char_end", "text"))).alias("c"))
    before = lambda i: F.aggregate(F.slice("c", F.lit(1), i), F.lit(0).cast("long"), lambda n, c: n + F.length(c["text"]) + 2)
    return rows.select(
        "doc", F.forall(F.transform("c", lambda c, i: c["ordinal"] == i), lambda x: x).alias("gapless"),
        F.forall(F.transform("c", lambda c, i: (c["char_start"] == before(i)) & (c["char_end"] - c["char_start"] == F.length(c["text"]))), lambda x: x).alias("exact"),
        F.md5(F.regexp_replace(F.array_join(F.transform("c", lambda c: c["text"]), ""), r"\s", "").cast("binary")).alias("said"),
    )


@query(_LINES + r" SELECT doc, count(*)::INT AS n, true AS in_order, md5(string_agg(regexp_replace(said, '^\s+|\s+$', '', 'g'), chr(10) ORDER BY line)) AS captions FROM b WHERE line % 4 = 3 GROUP BY doc")
def txt6_layout_index(spark: SparkSession, d: str) -> DataFrame:
    """Every table group in document order, with its caption."""
    rows = L.layout_index(L.assemble(blocks(spark, d)))
    rising = F.transform("layout", lambda e, i: (i == 0) | (e["ordinal"] > F.element_at("layout", F.greatest(i, F.lit(1)))["ordinal"]))
    return rows.select("doc", F.size("layout").alias("n"), F.forall(rising, lambda x: x).alias("in_order"), F.md5(F.array_join(F.transform("layout", lambda e: e["caption"]), "\n").cast("binary")).alias("captions"))


@query("SELECT p_partkey, 'TABLE ' || p_size AS label, p_partkey * 10 AS ordinal FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'TABLE ' || p_size, NULL FROM part WHERE p_size % 2 = 1")
def joi20_label_lookup(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    entry = F.struct((COL("p_partkey") * 10).alias("ordinal"), F.lit("table").alias("kind"), F.concat(F.lit(" Table "), COL("p_size").cast("string")).alias("label"), F.lit("").alias("caption"), F.lit(1).alias("page"))
    index = part.filter("p_size % 2 = 0").select(COL("p_partkey").alias("doc"), F.array(entry).alias("layout"))
    wanted = part.select(COL("p_partkey").alias("doc"), F.concat(F.lit("TABLE "), COL("p_size").cast("string")).alias("label"))
    return L.find_label(index, wanted).select(COL("doc").alias("p_partkey"), "label", "ordinal")


@query("WITH s AS (SELECT l_orderkey AS doc, l_linenumber AS pos, (l_quantity % 5)::INT AS size, 'Head ' || (l_partkey % 20) AS text FROM lineitem), c AS (SELECT doc, size, sum(length(text)) AS n FROM s GROUP BY 1, 2), b AS (SELECT doc, max(size) AS title, arg_max(size, n * 100 - size) AS body FROM c GROUP BY 1), h AS (SELECT s.doc, pos, text, count(*) OVER (PARTITION BY s.doc, text) AS r FROM s JOIN b ON b.doc = s.doc WHERE size >= body + 1 AND size < title) SELECT doc, pos, text AS name FROM h WHERE r = 1")
def src4_headings(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "lineitem").select(COL("l_orderkey").alias("doc"), F.lit(0).alias("page"), COL("l_linenumber").alias("pos"), (COL("l_quantity") % 5).cast("int").alias("size"), F.concat(F.lit("Head "), (COL("l_partkey") % 20).cast("string")).alias("text"))
    return L.headings(spans).select("doc", "pos", "name")


@query("WITH n AS (SELECT p_size AS deck, count(*) AS nf, count(*) + p_size % 3 AS ng FROM part GROUP BY 1), f AS (SELECT p_size AS deck, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS frame FROM part) SELECT f.deck, f.frame, CASE WHEN ng = nf THEN frame * 10 WHEN ng = nf + 1 THEN (frame + 1) * 10 END AS pages FROM f JOIN n ON n.deck = f.deck")
def joi23_group_alignment(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    part = table(spark, d, "part").select(COL("p_size").alias("deck"), "p_partkey")
    frames = part.select("deck", (F.row_number().over(Window.partitionBy("deck").orderBy("p_partkey")) - 1).cast("long").alias("frame"))
    groups = part.groupBy("deck").agg(F.count("*").alias("n")).select("deck", F.explode(F.sequence(F.lit(0).cast("long"), COL("n") + COL("deck") % 3 - 1)).alias("g")).withColumn("pages", COL("g") * 10)
    return L.aligned_groups(groups, frames)


@query(
    "WITH RECURSIVE l AS (SELECT doc_id, pos, list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(line, '<[^>]+>', ' ', 'g')), '[a-z0-9]+'), lambda w: length(w) >= 2)) AS toks FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE contains(text, chr(10)))), "
    "p AS (SELECT g.doc_id, g.pos AS target, c.pos AS candidate, len(list_intersect(g.toks, c.toks)) / len(g.toks) AS score FROM l g JOIN l c ON g.doc_id = c.doc_id AND g.pos % 2 = 0 AND c.pos % 2 = 1 AND len(g.toks) > 0), "
    "n AS (SELECT doc_id, target, row_number() OVER (PARTITION BY doc_id ORDER BY target) AS k, cs FROM (SELECT doc_id, target, list({'c': candidate, 's': score} ORDER BY score DESC, candidate) AS cs FROM p WHERE score >= 0.2 GROUP BY 1, 2)), "
    "r AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, []::BIGINT[] AS used, 0::BIGINT AS target, {'c': NULL::BIGINT, 's': NULL::DOUBLE} AS f FROM n UNION ALL "
    "SELECT doc_id, k, CASE WHEN f.c IS NULL THEN used ELSE list_append(used, f.c) END, target, f FROM (SELECT r.doc_id, n.k, r.used, n.target, list_filter(n.cs, lambda x: NOT list_contains(r.used, x.c))[1] AS f FROM r JOIN n ON n.doc_id = r.doc_id AND n.k = r.k + 1)) "
    "SELECT doc_id, target, f.c AS candidate, f.s AS score FROM r WHERE f.c IS NOT NULL"
)
def joi11_greedy_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Each line of a document takes the earlier unused half of another that shares most of its words."""
    lines = table(spark, d, "documents").filter(COL("text").contains("\n")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = lines.select("doc_id", F.when(COL("pos") % 2 == 0, "target").otherwise("candidate").alias("side"), "pos", C.content_tokens(COL("line")).alias("tokens"))
    return R.greedy_overlap(rows, "doc_id", 0.2)


@query("WITH f AS (SELECT p_partkey AS frame, p_size AS deck, p_name AS topic FROM part WHERE p_partkey % 5 > 0), r AS (SELECT DISTINCT p_size AS deck, p_size % 4 AS pos, p_type AS role FROM part WHERE p_partkey % 7 = 0), w AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(role), '[a-z]+'), lambda x: length(x) >= 3)) AS rw FROM r), h AS (SELECT f.deck, f.frame, w.pos, w.role, len(list_intersect(rw, regexp_extract_all(lower(topic), '[a-z]+'))) AS hit, len(rw) AS need FROM f JOIN w ON f.deck = w.deck) SELECT deck, frame, min(role) AS role FROM h WHERE hit > 0 AND hit >= 0.3 * need GROUP BY deck, frame")
def joi12_first_theta_match(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    frames = part.select(COL("p_size").alias("deck"), COL("p_partkey").alias("frame"), COL("p_name").alias("topic"), (COL("p_partkey") % 5 == 0).alias("has_math"))
    roles = part.filter("p_partkey % 7 = 0").select(COL("p_size").alias("deck"), COL("p_type").alias("pos"), COL("p_type").alias("role")).distinct()
    return R.first_theta_match(frames, roles, 0.3)


@query("WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 9 THEN 999999999 ELSE c_custkey - 1 END AS p FROM customer), w AS (SELECT id, 0 AS depth, lpad(id::VARCHAR, 20, '0') AS path FROM n WHERE p IS NULL OR p NOT IN (SELECT id FROM n) UNION ALL SELECT n.id, depth + 1, path || '/' || lpad(n.id::VARCHAR, 20, '0') FROM w JOIN n ON n.p = w.id) SELECT id, depth, path FROM w")
def srt8_fork_tree(spark: SparkSession, d: str) -> DataFrame:
    key = COL("c_custkey")
    nodes = table(spark, d, "customer").select(key.alias("id"), F.when(key % 10 == 0, F.lit(None)).when(key % 10 == 9, F.lit(999999999)).otherwise(key - 1).cast("long").alias("p"))
    return R.tree_order(nodes, "id", "p")


@query("WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 9 THEN 999999999 WHEN c_custkey % 10 > 5 THEN c_custkey // 10 * 10 + 2 ELSE c_custkey - 1 END AS p, lpad(rpad(coalesce(c_mktsegment, ''), 12, ' ') || lpad(c_custkey::VARCHAR, 12, '0'), 24, ' ') AS k FROM customer), w AS (SELECT id, 0 AS depth, k AS path FROM n WHERE p IS NULL OR p NOT IN (SELECT id FROM n) UNION ALL SELECT n.id, depth + 1, path || '/' || k FROM w JOIN n ON n.p = w.id) SELECT id, depth::BIGINT AS depth, row_number() OVER (ORDER BY path) - 1 AS place FROM w")
def srt8_tree_places(spark: SparkSession, d: str) -> DataFrame:
    """Trees of customers, siblings and roots by market segment: depth and place in depth-first order, as numbers."""
    key = COL("c_custkey")
    parent = F.when(key % 10 == 0, F.lit(None)).when(key % 10 == 9, F.lit(999999999)).when(key % 10 > 5, F.floor(key / 10) * 10 + 2).otherwise(key - 1).cast("long")
    return R.tree_places(table(spark, d, "customer").select(key.alias("id"), parent.alias("p"), F.rpad("c_mktsegment", 12, " ").alias("s")), "id", "p", "s")


@query("WITH s AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS sec FROM orders) SELECT o_orderkey, coalesce(last_value(sec IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(sec IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS section FROM s")
def joi14_filled_sections(spark: SparkSession, d: str) -> DataFrame:
    """Figures among headings: the last section named, or before any the next one."""
    named = COL("o_orderstatus") == "F"
    rows = table(spark, d, "orders").select(
        COL("o_custkey").alias("doc"), COL("o_orderkey").alias("pos"), COL("o_orderkey").cast("string").alias("block_id"), F.when(named, "SectionHeader").otherwise("Figure").alias("block_type"),
        F.when(named, F.concat(F.lit("<h2>"), COL("o_orderpriority"), F.lit("</h2>"))).otherwise("").alias("html"), F.expr("cast(map() as map<string,string>)").alias("hierarchy"),
    )
    return L.filled_sections(rows).select(COL("pos").alias("o_orderkey"), "section")
