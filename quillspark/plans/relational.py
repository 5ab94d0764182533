"""Filters, projections, joins, aggregates, windows, sorts and set operations over the driver's tables.

Roles: customer and orders stand for sessions and messages, documents for the library, labels for membership, events for
traces, conversations for messages with roles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.operators import relational as R
from quillspark.registry import query, spread, table

COL = F.col
NOW = "1998-01-01"


@query("SELECT c_custkey, c_name, c_mktsegment, count(o_orderkey) AS n_messages, coalesce(max(o_orderdate), TIMESTAMP '1970-01-01') AS last_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY ALL HAVING count(o_orderkey) < 4")
def agg2_session_summary(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with the count and newest time of their messages; sessions without any stay."""
    orders = table(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_custkey", "o_orderkey", "o_orderdate")
    rows = R.child_summary(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), orders, "c_custkey", "o_custkey", "o_orderkey", "o_orderdate", F.lit("1970-01-01").cast("timestamp_ntz"))
    return rows.filter("n_messages < 4").orderBy(F.desc("last_at"), F.desc("c_custkey"))


@query("SELECT event_id, event_type, json_extract_string(props, '$.k')::INT AS k FROM events WHERE event_id = 17")
def fil1_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("event_id = 17").select("event_id", "event_type", F.from_json("props", "k INT")["k"].alias("k"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O'")
def fil2_equality_and_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter((COL("o_custkey") == 7) & (COL("o_orderstatus") == "O")).select("o_orderkey", "o_totalprice")


@query("SELECT conv_id, turn FROM conversations WHERE (role = 'system' OR (role = 'user' AND conv_id = 5)) AND length(text) > 0")
def fil3_scope_visibility(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    return rows.filter(R.visible(COL("role") == "system", COL("role") == "user", COL("conv_id") == 5) & (F.length("text") > 0)).select("conv_id", "turn")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_id = 3) AND event_id IN (3, 4, 5, 999999999)")
def fil4_scoped_membership(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id")
    return rows.filter(COL("event_id").isin(3, 4, 5, 999999999)).join(rows.filter("event_id = 3").select("user_id"), "user_id", "left_semi").select("event_id", "user_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def fil5_not_attached(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "documents").createOrReplaceTempView("fil5_documents")
    table(spark, d, "labels").createOrReplaceTempView("fil5_labels")
    return spark.sql("SELECT doc_id, lang FROM fil5_documents WHERE doc_id NOT IN (SELECT doc_id FROM fil5_labels)")


@query(r"SELECT doc_id FROM documents WHERE (regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') LIKE '%thin%' OR regexp_replace(lower(source), '[^\p{L}\p{N}]', '', 'g') LIKE '%thin%') AND (regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') LIKE '%src1%' OR regexp_replace(lower(source), '[^\p{L}\p{N}]', '', 'g') LIKE '%src1%')")
def fil6_library_substring(spark: SparkSession, d: str) -> DataFrame:
    return R.contains_all(table(spark, d, "documents"), ["text", "source"], "Th-in !! SRC1").select("doc_id")


@query("SELECT event_id, json_extract_string(props, '$.k') AS section FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND json_extract_string(props, '$.k') <> ''")
def fil7_named_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("section"))
    return rows.filter(COL("section").isNotNull() & (COL("section") != ""))


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '42'")
def fil8_json_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(F.get_json_object("props", "$.k") == "42").select("event_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE 'cUSTOMER#%1'")
def fil9_like_any_case(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").filter(COL("c_name").ilike("cUSTOMER#%1")).select("c_custkey", "c_name")


@query("SELECT o_custkey, page_start, page_end FROM (SELECT o_custkey, min(o_orderkey) AS page_start, max(o_orderkey) AS page_end FROM orders GROUP BY 1) WHERE page_start <= 700 AND page_end >= 700")
def fil10_range_containment(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("page_start"), F.max("o_orderkey").alias("page_end"))
    return rows.filter(F.lit(700).between(COL("page_start"), COL("page_end")))


@query(f"SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '{NOW}' - INTERVAL 365 DAY")
def fil11_retention(spark: SparkSession, d: str) -> DataFrame:
    return R.expired(table(spark, d, "orders"), "o_orderdate", F.lit(NOW).cast("timestamp_ntz"), 365).select("o_orderkey")


@query("SELECT 'doc_id' AS name, 'bigint' AS type, count(doc_id) AS filled FROM documents UNION ALL SELECT 'text', 'string', count(text) FROM documents UNION ALL SELECT 'lang', 'string', count(lang) FROM documents UNION ALL SELECT 'source', 'string', count(source) FROM documents UNION ALL SELECT 'n_chars', lower(any_value(typeof(n_chars))), count(n_chars) FROM documents")
def prj1_describe(spark: SparkSession, d: str) -> DataFrame:
    """The columns of a table, and how many rows have a value there."""
    docs = table(spark, d, "documents")
    counts = docs.agg(*(F.count(c).alias(c) for c in docs.columns))
    return R.describe(docs).join(counts.unpivot([], docs.columns, "of", "filled"), COL("name") == COL("of")).select("name", F.when(COL("type") == "int", "integer").otherwise(COL("type")).alias("type"), "filled")


@query("SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'region', count(*) FROM region")
def prj2_list_tables(spark: SparkSession, d: str) -> DataFrame:
    """The tables that may be read, with their rows."""
    names = ["region", "orders", "nation"]
    counts = [table(spark, d, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("of"), "n") for n in names]
    return R.list_tables(spark, names).join(counts[0].unionByName(counts[1]).unionByName(counts[2]), COL("name") == COL("of")).select("name", "n")


@query("SELECT o_custkey, o_orderpriority AS name, count(*) AS chunks, sum(length(o_orderstatus))::BIGINT AS tokens FROM orders GROUP BY 1, 2")
def prj3_section_toc(spark: SparkSession, d: str) -> DataFrame:
    """A table of contents read back from its JSON."""
    sections = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("chunk_count"), F.sum(F.length("o_orderstatus")).alias("token_count"))
    stored = sections.groupBy("o_custkey").agg(F.to_json(F.collect_list(F.struct(COL("o_orderpriority").alias("name"), "token_count", "chunk_count"))).alias("sections_json"))
    return stored.select("o_custkey", F.explode(R.section_toc(COL("sections_json"))).alias("s")).select("o_custkey", "s.name", "s.chunks", "s.tokens")


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS cell FROM documents ORDER BY doc_id LIMIT 30")
def prj4_result_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").orderBy("doc_id").limit(30).select("doc_id", R.clip(COL("text"), 200).alias("cell"))


@query("SELECT p_partkey, '- ' || 'Table ' || p_size || ' (' || lower(p_brand) || ', p.' || (p_size % 7) || ') [chunk:' || p_partkey || ']: ' || p_name AS line FROM part WHERE p_size % 2 = 0")
def prj5_layout_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").withColumn("label", F.when(COL("p_size") % 2 == 0, F.concat(F.lit("Table "), COL("p_size").cast("string"))))
    return rows.select("p_partkey", R.layout_line(COL("label"), F.lower("p_brand"), COL("p_size") % 7, COL("p_partkey"), COL("p_name")).alias("line")).filter("line is not null")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def joi1_membership(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").join(table(spark, d, "region"), COL("n_regionkey") == COL("r_regionkey")).select("n_name", "r_name").orderBy("r_name", "n_name")


@query("SELECT s_suppkey, count(l_orderkey) AS n_lines FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity > 49 GROUP BY 1")
def joi2_left_aggregate(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").filter("l_quantity > 49").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return table(spark, d, "supplier").join(lines, COL("s_suppkey") == COL("l_suppkey"), "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n_lines"))


@query("SELECT d.doc_id, l.quality, CASE WHEN l.toxic = 0 AND b.item_id IS NOT NULL THEN b.item_id END AS deck FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def joi3_two_left_joins(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    rows = docs.join(table(spark, d, "labels"), "doc_id", "left").join(table(spark, d, "benchmark").select("item_id"), COL("doc_id") == COL("item_id"), "left")
    return rows.select("doc_id", "quality", F.when(COL("toxic") == 0, COL("item_id")).alias("deck"))


@query("SELECT u.conv_id, u.turn FROM conversations u WHERE u.role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = u.conv_id AND a.role = 'assistant' AND a.turn = u.turn + 1)")
def joi6_orphaned_turns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    replies = rows.filter("role = 'assistant'").select("conv_id", (COL("turn") - 1).alias("turn"))
    return rows.filter("role = 'user'").join(replies, ["conv_id", "turn"], "left_anti").select("conv_id", "turn")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def joi7_guarded_delete(spark: SparkSession, d: str) -> DataFrame:
    """What stays when the rows of a semi join are deleted."""
    gone = table(spark, d, "customer").filter("c_acctbal < 0").select(COL("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(gone, "o_custkey", "left_anti").select("o_orderkey")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate < TIMESTAMP '1993-01-01') AS had_deck FROM customer")
def joi8_existence(spark: SparkSession, d: str) -> DataFrame:
    early = table(spark, d, "orders").filter(COL("o_orderdate") < F.lit("1993-01-01").cast("timestamp_ntz")).select(COL("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(True))
    return table(spark, d, "customer").select("c_custkey").join(early, "c_custkey", "left").select("c_custkey", F.coalesce("hit", F.lit(False)).alias("had_deck"))


@query("SELECT * FROM (SELECT doc_id, min(pos) AS pos FROM (VALUES (0, 7), (1, 3), (2, 7), (3, 999999999), (4, 11)) AS p(pos, id) JOIN documents ON doc_id = id GROUP BY 1)")
def joi9_picks(spark: SparkSession, d: str) -> DataFrame:
    """Picked ids in their order, the first of repeats, unknown ones dropped."""
    return R.resolve_picks(table(spark, d, "documents").select("doc_id"), "doc_id", [7, 3, 7, 999999999, 11])


@query("WITH m AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + 1000000 AS new_id FROM orders WHERE o_orderstatus = 'F') SELECT l_orderkey, l_linenumber, new_id FROM lineitem LEFT JOIN m ON o_orderkey = l_orderkey")
def joi10_key_remap(spark: SparkSession, d: str) -> DataFrame:
    """All line items; the orders of one status get new ids, the lines of others stay null."""
    old = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    return R.remap(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", R.fresh_ids(old, "o_orderkey", 1000000)).select("l_orderkey", "l_linenumber", "new_id")


@query("WITH s AS (SELECT o_custkey, o_orderkey AS start FROM orders WHERE o_orderstatus = 'F') SELECT o.o_orderkey, max(s.start) AS section FROM orders o LEFT JOIN s ON s.o_custkey = o.o_custkey AND s.start <= o.o_orderkey GROUP BY 1")
def joi13_asof_backward(spark: SparkSession, d: str) -> DataFrame:
    """The last section start at or before each offset, by one sort per key instead of a range join."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    starts = orders.filter("o_orderstatus = 'F'").select("o_custkey", COL("o_orderkey").alias("start"))
    return R.asof_backward(orders, starts, "o_custkey", "o_orderkey", "start").select("o_orderkey", COL("start").alias("section"))


@query("WITH s AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS sec FROM orders) SELECT o_orderkey, (SELECT t.sec FROM s t WHERE t.o_custkey = s.o_custkey AND t.o_orderkey > s.o_orderkey AND t.sec IS NOT NULL ORDER BY t.o_orderkey LIMIT 1) AS next_section FROM s")
def joi14_asof_forward(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(COL("o_orderstatus") == "F", COL("o_orderpriority")).alias("sec"))
    ahead = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(1, Window.unboundedFollowing)
    return rows.select("o_orderkey", F.first("sec", ignorenulls=True).over(ahead).alias("next_section"))


@query("SELECT a.event_id, b.o_orderkey FROM (SELECT event_id, event_id * 3 AS s, event_id * 3 + 20 AS e FROM events) a JOIN (SELECT o_orderkey, o_orderkey * 2 AS s, o_orderkey * 2 + 15 AS e FROM orders) b ON a.s < b.e AND a.e > b.s")
def joi17_interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The overlaps of all events and orders, on a line that grows with the tables, so an interval meets at most 18 others."""
    a = table(spark, d, "events").select("event_id", (COL("event_id") * 3).alias("s"), (COL("event_id") * 3 + 20).alias("e"))
    b = table(spark, d, "orders").select("o_orderkey", (COL("o_orderkey") * 2).alias("s"), (COL("o_orderkey") * 2 + 15).alias("e"))
    return R.interval_overlap(a, b, "s", "e", 32).select("event_id", "o_orderkey")


@query("SELECT doc_id, first AS owner FROM (SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS first FROM documents)")
def joi18_exact_text(spark: SparkSession, d: str) -> DataFrame:
    """Equal bodies share the entry of the last; the join is on a digest."""
    rows = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("body"))
    last = rows.groupBy("body").agg(F.max("doc_id").alias("owner"))
    return rows.join(last, "body").select("doc_id", "owner")


@query("SELECT p.want, coalesce((SELECT min(n_nationkey) FROM nation WHERE n_name = p.want), (SELECT min(n_nationkey) FROM nation WHERE lower(n_name) = lower(trim(regexp_replace(p.want, '\\s+', ' ', 'g'))))) AS n_nationkey FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '  ' || lower(n_name) || ' ' END AS want FROM nation) p")
def joi19_name_fallback(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation")
    wanted = nations.select(F.when(COL("n_nationkey") % 2 == 0, COL("n_name")).otherwise(F.concat(F.lit("  "), F.lower("n_name"), F.lit(" "))).alias("want"))
    return R.lookup_with_fallback(wanted, "want", nations, "n_name", "n_nationkey")


@query("SELECT coalesce(a.user_id, b.user_id) AS user_id, a.m AS a_mean, b.m AS b_mean, round(b.m - a.m, 6) AS delta FROM (SELECT user_id, round(avg(value), 6) AS m FROM events WHERE event_type = 'click' GROUP BY 1) a FULL JOIN (SELECT user_id, round(avg(value), 6) AS m FROM events WHERE event_type = 'purchase' GROUP BY 1) b ON a.user_id = b.user_id")
def joi21_compare_runs(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    mean = lambda kind, name: events.filter(COL("event_type") == kind).groupBy("user_id").agg(F.round(F.avg("value"), 6).alias(name))
    return mean("click", "a_mean").join(mean("purchase", "b_mean"), "user_id", "full_outer").withColumn("delta", F.round(COL("b_mean") - COL("a_mean"), 6))


@query("SELECT DISTINCT b.l_partkey AS neighbour FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey WHERE a.l_partkey = 5")
def joi22_neighbours(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return lines.join(lines.filter("l_partkey = 5").select("l_orderkey").distinct(), "l_orderkey", "left_semi").filter("l_partkey <> 5").select(COL("l_partkey").alias("neighbour")).distinct()


@query("SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1) AS enabled FROM labels")
def agg1_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").agg(F.count("*").alias("n"), F.count_if(COL("quality") == 1).alias("enabled"))


@query("SELECT o_orderpriority AS section, min(o_orderkey) AS char_start FROM orders GROUP BY 1")
def agg3_sections_by_appearance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(COL("o_orderpriority").alias("section")).agg(F.min("o_orderkey").alias("char_start")).orderBy("char_start")


@query("SELECT DISTINCT event_type FROM events")
def agg4_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_type").distinct()


@query("SELECT c_custkey, coalesce(max(o_orderkey), -1) AS step FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1")
def agg5_last_step(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("m"))
    return table(spark, d, "customer").join(last, COL("c_custkey") == COL("o_custkey"), "left").select("c_custkey", F.coalesce("m", F.lit(-1)).alias("step"))


@query("SELECT o_custkey, o_orderpriority AS name, min(o_orderkey) AS char_start, max(o_orderkey + length(o_orderstatus)) AS char_end, count(*) AS chunk_count, length(string_agg(o_orderstatus, chr(10) || chr(10) ORDER BY o_orderkey)) AS token_count FROM orders GROUP BY 1, 2")
def agg6_section_index(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "orders").select("o_custkey", COL("o_orderpriority").alias("section"), COL("o_orderkey").alias("char_start"), (COL("o_orderkey") + F.length("o_orderstatus")).alias("char_end"), COL("o_orderstatus").alias("text"))
    return R.section_index(chunks, "o_custkey", F.length)


@query("SELECT conv_id, string_agg('[' || role || '] ' || substr(text, 1, 300), chr(10) || chr(10) ORDER BY turn) AS block FROM conversations GROUP BY 1")
def agg7_ordered_text(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("piece", F.concat(F.lit("["), COL("role"), F.lit("] "), F.substr("text", F.lit(1), F.lit(300))))
    return R.joined_text(rows, ["conv_id"], ["turn"], "piece", "\n\n", "block")


@query("SELECT lang, size FROM (SELECT lang, size, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, size) AS r FROM (SELECT lang, doc_id % 5 AS size, sum(n_chars) AS weight FROM documents GROUP BY 1, 2)) WHERE r = 1")
def agg8_weighted_mode(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("lang", (COL("doc_id") % 5).alias("size"), "n_chars")
    return R.weighted_mode(rows, ["lang"], "size", "n_chars")


@query("SELECT max(p_retailprice) AS title_size FROM part WHERE p_size = 1")
def agg9_filtered_max(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter("p_size = 1").agg(F.max("p_retailprice").alias("title_size"))


@query("SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) = 1)")
def agg10_unrepeated(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return rows.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).filter("n = 1").select("doc_id")


@query("SELECT l_orderkey, min(l_quantity) AS x0, min(l_discount) AS y0, max(l_quantity + 1) AS x1, max(l_tax + 1) AS y1 FROM lineitem WHERE l_linenumber > 1 GROUP BY 1")
def agg11_box_union(spark: SparkSession, d: str) -> DataFrame:
    box = F.when(COL("l_linenumber") > 1, F.array("l_quantity", "l_discount", COL("l_quantity") + 1, COL("l_tax") + 1)).otherwise(F.array(F.lit(0.0)))
    rows = table(spark, d, "lineitem").select("l_orderkey", box.alias("bbox"))
    return R.box_union(rows, ["l_orderkey"], "bbox").filter("box is not null").select("l_orderkey", *[COL("box")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query("SELECT event_type, round(avg(CASE WHEN event_id % 3 > 0 THEN value END), 6) AS mean_score, count(DISTINCT user_id) AS n_cases FROM events GROUP BY 1")
def agg12_14_mean_and_cases(spark: SparkSession, d: str) -> DataFrame:
    score = F.when(COL("event_id") % 3 > 0, COL("value"))
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(score), 6).alias("mean_score"), F.count_distinct("user_id").alias("n_cases"))


@query("SELECT event_type, round(avg(m), 6) AS mean_of_means, round(sum(s) / sum(n), 6) AS flat_mean FROM (SELECT event_type, user_id, avg(value) AS m, sum(value) AS s, count(value) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def agg13_mean_of_means(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("m"), F.sum("value").alias("s"), F.count("value").alias("n"))
    return cases.groupBy("event_type").agg(F.round(F.avg("m"), 6).alias("mean_of_means"), F.round(F.sum("s") / F.sum("n"), 6).alias("flat_mean"))


@query("WITH m AS (SELECT user_id % 10 AS testset, round(avg(value) FILTER (WHERE event_type = 'click'), 4) AS click, round(avg(value) FILTER (WHERE event_type = 'view'), 4) AS v FROM events GROUP BY 1) SELECT testset, CASE WHEN click IS NULL THEN '—' ELSE printf('%.4f', click) END AS click, CASE WHEN v IS NULL THEN '—' ELSE printf('%.4f', v) END AS view, CASE WHEN round(v - click, 4) < 0 THEN '⚠' WHEN round(v - click, 4) >= 0 THEN '' ELSE '—' END AS sign FROM m")
def agg15_pivot_matrix(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "events").groupBy((COL("user_id") % 10).alias("testset")).pivot("event_type", ["click", "view"]).agg(F.round(F.avg("value"), 4))
    delta = F.round(COL("view") - COL("click"), 4)
    shown = lambda c: F.coalesce(F.format_string("%.4f", c), F.lit("—"))
    return cells.select("testset", F.when(COL("click").isNull(), "—").otherwise(shown(COL("click"))).alias("click"), F.when(COL("view").isNull(), "—").otherwise(shown(COL("view"))).alias("view"), F.when(delta < 0, "⚠").when(delta >= 0, "").otherwise("—").alias("sign"))


@query("SELECT sum(quality) AS total FROM labels WHERE toxic IS NOT NULL")
def agg16_judge_sum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").filter("toxic is not null").agg(F.sum("quality").alias("total"))


@query("SELECT user_id, bool_and(event_type <> 'error') AS all_steps_ok FROM events GROUP BY 1")
def agg17_all_ok(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(((F.count("*") > 0) & F.bool_and(COL("event_type") != "error")).alias("all_steps_ok"))


@query("SELECT l_orderkey, round(sum(w * w / (1 + l_linenumber % 3)), 4) AS footprint FROM (SELECT l_orderkey, l_linenumber, 0.1 * (1 + l_partkey % 90) AS w FROM lineitem) GROUP BY 1")
def agg18_footprint(spark: SparkSession, d: str) -> DataFrame:
    """The area of each deck's figures, sized by their widths and aspects."""
    from quillspark.operators import slides

    mm = (1 + COL("l_partkey") % 90).cast("string")
    tex = F.concat(F.lit("\\includegraphics[width="), mm, F.lit("mm]{fig}"))
    rows = spread(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")).select("l_orderkey", slides.footprint(tex, F.create_map(F.lit("fig"), (1 + COL("l_linenumber") % 3).cast("double"))).alias("area"))
    return rows.groupBy("l_orderkey").agg(F.round(F.sum("area"), 4).alias("footprint"))


@query("WITH f AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS s FROM events), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM f) SELECT user_id, island::BIGINT AS island, event_type, count(*) AS n FROM g GROUP BY ALL")
def win1_islands(spark: SparkSession, d: str) -> DataFrame:
    rows = R.islands(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    return rows.groupBy("user_id", "island", "event_type").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, (sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) - 2)::BIGINT AS char_start, (sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn) - 2)::BIGINT AS char_end FROM conversations")
def win3_running_offset(spark: SparkSession, d: str) -> DataFrame:
    return R.running_offsets(table(spark, d, "conversations"), ["conv_id"], ["turn"], "text", 2).select("conv_id", "turn", "char_start", "char_end")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS section FROM events")
def win4_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    so_far = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(COL("event_type") == "signup", COL("event_id"))
    return table(spark, d, "events").select("event_id", F.last(mark, ignorenulls=True).over(so_far).alias("section"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def win5_first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return R.first_occurrence(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query("SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY min(o_orderkey)) AS ordinal FROM orders GROUP BY 1, 2")
def win6_citation_ordinal(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("marks"))
    return rows.select("o_custkey", F.posexplode(F.array_distinct(F.transform("marks", lambda m: m["o_orderpriority"]))).alias("pos", "o_orderpriority")).select("o_custkey", "o_orderpriority", (COL("pos") + 1).cast("long").alias("ordinal"))


@query("SELECT event_id, event_type = 'purchase' AND sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 2 AS finalize FROM events")
def win7_capped_flags(spark: SparkSession, d: str) -> DataFrame:
    return R.cap_flags(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], COL("event_type") == "purchase", 2, "finalize").select("event_id", "finalize")


@query("WITH s AS (SELECT o_custkey AS k, o_orderkey % 400 AS s, o_orderkey % 400 + 25 AS e, o_orderkey AS id FROM orders), m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e, id) AS i FROM m) SELECT k, min(s) AS s, max(e) AS e FROM g GROUP BY k, i")
def win8_merge_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(COL("o_custkey").alias("k"), (COL("o_orderkey") % 400).alias("s"), (COL("o_orderkey") % 400 + 25).alias("e"))
    return R.merge_spans(rows, ["k"], "s", "e")


@query("SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS section_end, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev_start FROM orders")
def win9_next_bound(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.lead("o_orderkey").over(w).alias("section_end"), F.lag("o_orderkey").over(w).alias("prev_start"))


@query("SELECT deck, frame, page FROM (SELECT p_size % 4 AS deck, p_partkey AS frame, unnest(range(1 + p_size % 3)) AS overlay, row_number() OVER (PARTITION BY p_size % 4 ORDER BY p_partkey) AS r, (sum(1 + p_size % 3) OVER (PARTITION BY p_size % 4 ORDER BY p_partkey) - (1 + p_size % 3))::BIGINT AS before FROM part) t, LATERAL (SELECT before + overlay + 1 AS page)")
def win10_frame_pages(spark: SparkSession, d: str) -> DataFrame:
    frames = table(spark, d, "part").select((COL("p_size") % 4).alias("deck"), COL("p_partkey").alias("frame"), (1 + COL("p_size") % 3).alias("pages"))
    return R.frame_pages(frames, ["deck"], "frame", "pages")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 50 OFFSET 20")
def srt1_paged(spark: SparkSession, d: str) -> DataFrame:
    return R.page(table(spark, d, "documents").select("doc_id", "n_chars"), [F.desc_nulls_last("n_chars"), F.asc("doc_id")], 50, 20)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC")
def srt2_recency(spark: SparkSession, d: str) -> DataFrame:
    """All rows in that order."""
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))


@query("SELECT o_custkey, max(o_orderkey) AS newest, min(o_orderkey) AS oldest FROM orders GROUP BY 1")
def srt4_latest_and_earliest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", "o_orderkey").alias("newest"), F.min_by("o_orderkey", "o_orderkey").alias("oldest"))


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' ORDER BY turn DESC, conv_id DESC LIMIT 20")
def srt6_recent_memories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn").orderBy(F.desc("turn"), F.desc("conv_id")).limit(20)


@query("SELECT p_brand, p_partkey AS root FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part) WHERE r = 1")
def srt7_argmax(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_size", -COL("p_partkey"))).alias("root"))


@query("SELECT user_id, list_sort(list_distinct(list(event_id % 7) || list(event_id % 5)))::VARCHAR AS ids FROM events GROUP BY 1")
def set1_union_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(COL("event_id") % 7).alias("a"), F.collect_list(COL("event_id") % 5).alias("b"))
    return rows.select("user_id", F.concat(F.lit("["), F.array_join(F.array_sort(F.array_union("a", "b")), ", "), F.lit("]")).alias("ids"))


@query("SELECT a.l_orderkey, count(DISTINCT b.l_partkey) AS common FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber <= 3) a LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber >= 3) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey GROUP BY 1")
def set2_intersection_size(spark: SparkSession, d: str) -> DataFrame:
    part = lambda test: F.collect_set(F.when(test, COL("l_partkey")))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(part(COL("l_linenumber") <= 3).alias("a"), part(COL("l_linenumber") >= 3).alias("b"))
    return rows.filter(F.size("a") > 0).select("l_orderkey", F.size(F.array_intersect("a", "b")).cast("long").alias("common"))


@query("SELECT doc_id FROM labels EXCEPT SELECT item_id FROM benchmark")
def set3_difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("doc_id").subtract(table(spark, d, "benchmark").select(COL("item_id").alias("doc_id")))


@query("SELECT kind, id, origin FROM (SELECT kind, id, origin, row_number() OVER (PARTITION BY kind, id ORDER BY origin) AS r FROM (SELECT 'doc' AS kind, doc_id AS id, 0 AS origin FROM labels UNION ALL SELECT 'doc', item_id, 1 FROM benchmark)) WHERE r = 1")
def set4_merged_parses(spark: SparkSession, d: str) -> DataFrame:
    parsed = lambda name, key, origin: table(spark, d, name).select(F.lit("doc").alias("kind"), COL(key).alias("id"), F.lit(origin).alias("origin"))
    return R.first_occurrence(parsed("labels", "doc_id", 0).unionByName(parsed("benchmark", "item_id", 1)), ["kind", "id"], ["origin"])


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def star_pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").filter(COL("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(COL("l_extendedprice") * (1 - COL("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN length(t) <= 40 THEN t WHEN position(' ' IN substr(t, 1, 40)) > 0 AND 40 - position(' ' IN reverse(substr(t, 1, 40))) > 20 THEN rtrim(substr(t, 1, 40 - position(' ' IN reverse(substr(t, 1, 40))))) || '…' ELSE substr(t, 1, 40) || '…' END AS title FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)".replace("\\\\", "\\"))
def txt12_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.derive_title(COL("text")).alias("title"))
