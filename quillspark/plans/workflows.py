"""Workflows over the driver's tables: customers as sessions, conversations as messages, orders as runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import workflows as W
from quillspark.registry import query, table

COL = F.col
NOW = "1998-01-01"


def _fork(spark: SparkSession, d: str) -> W.Fork:
    sessions = table(spark, d, "customer").select(COL("c_custkey").alias("id"), COL("c_name").alias("title"))
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    messages = orders.select(COL("o_custkey").alias("session_id"), COL("o_orderkey").alias("id"), F.lit("user").alias("role"), COL("o_orderpriority").alias("content"), F.when(COL("o_orderkey") % 3 > 0, COL("o_orderkey")).alias("run_id"))
    runs = orders.select(COL("o_orderkey").alias("id"), COL("o_custkey").alias("session_id"), COL("o_orderstatus").alias("status"))
    papers = table(spark, d, "labels").select((COL("doc_id") % 20).alias("session_id"), "doc_id")
    memories = table(spark, d, "events").select((COL("user_id") % 20).alias("session_id"), F.when(COL("event_type") == "click", "session").otherwise("global").alias("scope"), F.when(COL("event_id") % 2 == 0, "active").otherwise("superseded").alias("status"), COL("event_id").cast("string").alias("content"))
    decks = orders.filter("o_orderstatus = 'F'").select(COL("o_custkey").alias("session_id"), COL("o_orderkey").alias("run_id"))
    return W.fork(sessions, messages, runs, papers, memories, decks, 7, 1000, 900001, 5000000)


_USED = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + 5000000 AS new_id FROM orders WHERE o_custkey = 7 AND o_orderkey < 1000 AND o_orderkey % 3 > 0"


@query(f"WITH m AS ({_USED}) SELECT 900001 AS session_id, o.o_orderkey AS id, 'user' AS role, o_orderpriority AS content, new_id AS run_id FROM orders o LEFT JOIN m ON m.o_orderkey = o.o_orderkey WHERE o_custkey = 7 AND o.o_orderkey < 1000")
def wfl1_fork_messages(spark: SparkSession, d: str) -> DataFrame:
    return _fork(spark, d).messages


@query(f"WITH m AS ({_USED}) SELECT 'deck' AS kind, new_id::VARCHAR AS key FROM m JOIN orders USING (o_orderkey) WHERE false UNION ALL SELECT 'run', new_id || o_orderstatus FROM m JOIN orders USING (o_orderkey) UNION ALL SELECT 'deck', o_orderkey::VARCHAR FROM m JOIN orders USING (o_orderkey) WHERE o_orderstatus = 'F' UNION ALL SELECT 'paper', doc_id::VARCHAR FROM labels WHERE doc_id % 20 = 7 UNION ALL SELECT 'memory', event_id::VARCHAR FROM events WHERE user_id % 20 = 7 AND event_type = 'click' AND event_id % 2 = 0 UNION ALL SELECT 'session', 'Fork of ' || c_name FROM customer WHERE c_custkey = 7")
def wfl1_fork_tables(spark: SparkSession, d: str) -> DataFrame:
    f = _fork(spark, d)
    parts = (("run", f.runs, F.concat(COL("id").cast("string"), COL("status"))), ("deck", f.decks, COL("run_id").cast("string")), ("paper", f.papers, COL("doc_id").cast("string")), ("memory", f.memories, COL("content")), ("session", f.session, COL("title")))
    out = None
    for kind, df, key in parts:
        rows = df.select(F.lit(kind).alias("kind"), key.alias("key"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH gone AS (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0) SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone) AND o_orderdate < TIMESTAMP '{NOW}'")
def wfl2_purge(spark: SparkSession, d: str) -> DataFrame:
    """Tombstones, then the purge of what they mark with its children."""
    sessions = table(spark, d, "customer").select("c_custkey", F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    marked = W.restore(W.soft_delete(sessions, COL("c_custkey") % 2 == 0, F.lit(NOW).cast("timestamp_ntz")), COL("c_custkey") % 4 == 2)
    gone = marked.filter("deleted_at is not null").select("c_custkey")
    _, (orders,) = W.purge(sessions, "c_custkey", gone, [(table(spark, d, "orders"), "o_custkey")])
    return orders.filter(COL("o_orderdate") < F.lit(NOW).cast("timestamp_ntz")).select("o_orderkey")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'superseded' ELSE 'active' END AS status, CASE WHEN doc_id % 10 = 0 THEN doc_id + 1000000 END AS superseded_by FROM documents UNION ALL SELECT doc_id + 1000000, 'active', NULL FROM documents WHERE doc_id % 10 = 0")
def wfl3_supersede(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    old = docs.select(COL("doc_id").alias("id"), COL("lang").alias("content"), F.lit("active").alias("status"), F.lit(None).cast("long").alias("supersedes"), F.lit(None).cast("long").alias("superseded_by"))
    new = docs.filter("doc_id % 10 = 0").select((COL("doc_id") + 1000000).alias("id"), COL("lang").alias("content"), COL("doc_id").alias("supersedes"))
    return W.supersede(old, new).select("id", "status", "superseded_by")


@query("SELECT * FROM (VALUES (5, 0), (12, 1), (19, 2), (26, 3)) t(id, step)")
def wfl3_history(spark: SparkSession, d: str) -> DataFrame:
    chain = spark.range(5, 40, 7).select("id", F.lit("m").alias("content"), F.when(COL("id") < 26, COL("id") + 7).alias("superseded_by"))
    return W.history(chain, 5).select("id", "step")


@query("SELECT c_custkey AS session_id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE (SELECT arg_max(props, event_id) FROM events WHERE event_type = 'signup') END AS style FROM customer")
def wfl4_style(spark: SparkSession, d: str) -> DataFrame:
    sessions = table(spark, d, "customer").select(COL("c_custkey").alias("session_id"))
    overrides = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(COL("c_custkey").alias("session_id"), COL("c_name").alias("preamble"))
    memory = table(spark, d, "events").filter("event_type = 'signup'").select(COL("event_id").alias("id"), COL("event_id").alias("updated_at"), COL("props").alias("content"))
    return W.resolve_style(sessions, overrides, memory, "default")


@query("SELECT p_partkey, n AS n_references FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey WHERE p_size = 3")
def wfl5_restrict(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_size")
    _, refused = W.restricted_delete(part, "p_partkey", part.filter("p_size = 3").select("p_partkey"), table(spark, d, "lineitem").select(COL("l_partkey").alias("p_partkey")))
    return refused


@query("SELECT conv_id, turn, role = 'system' OR conv_id = 3 AS editable FROM conversations")
def wfl6_ownership(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(COL("role") == "system", "global").otherwise("session").alias("scope"), COL("conv_id").alias("session_id"))
    return W.may_edit(rows, 3).select("conv_id", "turn", "editable")


@query("WITH s AS (SELECT user_id, event_id, '[' || event_id || '] agent.' || event_type || ' ' || CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS line FROM events) SELECT user_id AS run_id, 'run ' || user_id || ': ok' || chr(10) || string_agg(line, chr(10) ORDER BY event_id) AS text FROM s GROUP BY 1")
def wfl7_replay(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    steps = events.select(COL("user_id").alias("run_id"), F.lit("main").alias("branch"), COL("event_id").alias("step_index"), F.lit("agent").alias("agent"), COL("event_type").alias("tool"), F.when(COL("event_type") == "error", "error").otherwise("ok").alias("status"))
    return W.replay_text(events.select(COL("user_id").alias("run_id"), F.lit("ok").alias("status")).distinct(), steps)


@query("SELECT user_id AS run_id, user_id % 3 = 0 OR user_id % 2 = 0 AS intent_match, bool_and(event_type <> 'error') AS all_steps_ok, CASE WHEN user_id % 2 = 0 THEN sum(value) > 100 END AS deck_generated, CASE WHEN user_id % 2 = 1 THEN true END AS answered FROM events GROUP BY 1")
def wfl8_grounding(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events").groupBy(COL("user_id").alias("run_id")).agg(F.collect_list(F.when(COL("event_type") == "error", "error").otherwise("ok")).alias("statuses"), F.when(F.sum("value") > 100, 1).otherwise(0).alias("pages"))
    runs = runs.select("*", F.when(COL("run_id") % 3 > 0, "slides").alias("expected"), F.when(COL("run_id") % 2 == 0, "slides").otherwise("chitchat").alias("actual"), F.lit("hello").alias("answer"), F.array(F.lit(1)).alias("cited"), F.lit(1).alias("resolved"), F.lit(0).alias("results"))
    return W.grounding(runs).select("run_id", "intent_match", "all_steps_ok", "deck_generated", "answered")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0::DOUBLE WHEN event_id % 3 = 0 THEN CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS score FROM events")
def wfl9_grade(spark: SparkSession, d: str) -> DataFrame:
    expected = F.when(COL("event_id") % 3 == 0, "click")
    return table(spark, d, "events").select("event_id", W.grade(COL("event_type") == "error", expected, COL("event_type")).alias("score"))


@query("SELECT CASE WHEN l_partkey % 3 > 0 AND p_partkey IS NOT NULL THEN p_partkey END AS p_partkey, coalesce(CASE WHEN l_partkey % 3 > 0 THEN p_size END, l_linenumber) AS p_size FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND l_partkey % 3 > 0")
def add1_checked_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims against what is known: unknown keys become null, known values win (outline and bundle checks)."""
    claims = table(spark, d, "lineitem").select(COL("l_partkey").alias("p_partkey"), COL("l_linenumber").alias("p_size"))
    known = table(spark, d, "part").filter("p_partkey % 3 > 0").select("p_partkey", "p_size")
    return W.checked_claims(claims, known, "p_partkey")[0]


@query("SELECT DISTINCT l_partkey AS p_partkey FROM lineitem WHERE l_partkey % 3 = 0")
def add4_dropped_claims(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "lineitem").select(COL("l_partkey").alias("p_partkey"))
    return W.checked_claims(claims, table(spark, d, "part").filter("p_partkey % 3 > 0").select("p_partkey"), "p_partkey")[1]


@query("SELECT p_partkey AS frame, p_partkey * 2 AS page_start, p_partkey * 2 + 1 AS page_end FROM part WHERE 25 BETWEEN p_partkey * 2 AND p_partkey * 2 + 1")
def add2_scope(spark: SparkSession, d: str) -> DataFrame:
    frames = table(spark, d, "part").select(COL("p_partkey").alias("frame"), (COL("p_partkey") * 2).alias("page_start"), (COL("p_partkey") * 2 + 1).alias("page_end"))
    return W.scope_frames(frames, "current", 25)


@query("SELECT p_size AS deck, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS content, p_partkey AS frame FROM part WHERE p_partkey % 4 > 0")
def add3_content_numbers(spark: SparkSession, d: str) -> DataFrame:
    frames = table(spark, d, "part").select(COL("p_size").alias("deck"), COL("p_partkey").alias("frame"), (COL("p_partkey") % 4 == 0).alias("is_title"))
    return W.content_numbers(frames).select("deck", COL("content").cast("long").alias("content"), "frame")


@query("SELECT CASE WHEN n_nationkey > 3 THEN n_nationkey + 1 ELSE n_nationkey END AS frame, n_name AS tex FROM nation UNION ALL SELECT 4, 'new'")
def add5_deck_edit(spark: SparkSession, d: str) -> DataFrame:
    return W.edit_frames(table(spark, d, "nation").select(COL("n_nationkey").alias("frame"), COL("n_name").alias("tex")), "insert", 3, "new")


@query("SELECT n_nationkey AS frame, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'none' END AS note FROM nation")
def add8_carried_notes(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    old = nation.select(COL("n_nationkey").alias("frame"), F.when(COL("n_nationkey") % 2 == 0, COL("n_name")).otherwise("").alias("note"))
    return W.carried(old, nation.select(COL("n_nationkey").alias("frame"), F.lit("none").alias("note")), "frame", ["note"])


@query("WITH r AS (SELECT user_id AS run_id, CASE WHEN event_type = 'error' THEN -1 ELSE (event_id % 5)::INT END AS step_index, event_id FROM events) SELECT run_id, step_index, max(event_id)::VARCHAR AS payload FROM r GROUP BY 1, 2")
def add10_trace_upsert(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "events").select(COL("user_id").alias("run_id"), F.when(COL("event_type") == "error", -1).otherwise((COL("event_id") % 5).cast("int")).alias("step_index"), COL("event_id").cast("string").alias("payload"), COL("event_id").alias("arrival"))
    return W.upsert_trace(records).select("run_id", "step_index", "payload")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'server' ELSE 'local' END AS title FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def add11_reconcile(spark: SparkSession, d: str) -> DataFrame:
    key = COL("c_custkey")
    sessions = table(spark, d, "customer").select(key.alias("id"), key.alias("place"))
    local = sessions.filter("id % 5 > 0 or id % 2 > 0").select("id", F.lit("local").alias("title"), (COL("id") % 3 == 0).alias("is_draft"), "place")
    return W.reconcile(local, sessions.filter("id % 2 = 0").select("id", F.lit("server").alias("title"), "place")).select("id", "title")


@query("WITH m AS (SELECT *, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations WHERE role IN ('user', 'assistant')) SELECT conv_id AS session_id, turn AS id, role, CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN 'error' ELSE 'ok' END AS state FROM m UNION ALL SELECT conv_id, NULL, 'assistant', 'processing' FROM m WHERE role = 'user' AND nx IS NULL AND turn % 3 > 0")
def add12_message_states(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(COL("conv_id").alias("session_id"), COL("turn").alias("id"), "role", F.when(COL("turn") % 3 == 0, "error").otherwise("running").alias("run_status"))
    return W.message_states(rows)


@query("SELECT event_type, round(avg(CASE WHEN event_type = 'error' THEN 0 WHEN event_id % 4 = 0 THEN NULL ELSE value END), 6) AS mean_score FROM events GROUP BY 1")
def add13_judge_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Failed cases count 0, failed judgements don't count."""
    score = F.when(COL("event_type") == "error", 0.0).when(COL("event_id") % 4 == 0, F.lit(None)).otherwise(COL("value"))
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(score), 6).alias("mean_score"))


@query("SELECT lang, doc_id // 100 AS part, string_agg('- ' || doc_id || ': ' || substr(text, 1, 200), chr(10) ORDER BY doc_id) AS block FROM documents GROUP BY 1, 2")
def add15_context_block(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of all documents, a hundred ids to a block of each language."""
    from quillspark.operators.relational import joined_text

    rows = table(spark, d, "documents").withColumn("part", F.expr("doc_id div 100")).withColumn("line", F.concat(F.lit("- "), COL("doc_id").cast("string"), F.lit(": "), F.substr("text", F.lit(1), F.lit(200))))
    return joined_text(rows, ["lang", "part"], ["doc_id"], "line", "\n", "block")


_SURVEY = "regexp_matches(lower(CASE WHEN doc_id % 3 = 0 THEN 'A Survey' ELSE 'A title' END || ' ' || text), 'survey|a review|review of|overview of|taxonomy of')"


@query(
    "SELECT doc_id, '### paper_id=' || doc_id || ': ' || CASE WHEN doc_id % 3 = 0 THEN 'A Survey' ELSE 'A title' END || CASE WHEN " + _SURVEY + " THEN ' [SURVEY — decompose into its surveyed branches]' ELSE '' END"
    " || chr(10) || 'Abstract: ' || substr(text, 1, 600) || chr(10) || 'Section insights:' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '- One: ' || lang || chr(10) || '- Two: x' ELSE '- (none)' END"
    " || chr(10) || 'Figure keys: ' || CASE WHEN doc_id % 5 = 0 THEN 'p0-a, p0-b' ELSE '(none)' END || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Key equations:' || chr(10) || '  - a+b  (loss)' || chr(10) || '  - c' ELSE '' END AS block FROM documents"
)
def add15_digest(spark: SparkSession, d: str) -> DataFrame:
    """The digest of every document as a paper."""
    from quillspark.operators import context as K

    pair = lambda a, b, names: F.struct(a.alias(names[0]), b.alias(names[1]))
    none = lambda kind: F.expr(f"cast(array() as {kind})")
    sections = F.when(COL("doc_id") % 2 == 0, F.array(pair(F.lit("One"), COL("lang"), ("name", "insight")), pair(F.lit("Two"), F.lit("x"), ("name", "insight")))).otherwise(none("array<struct<name: string, insight: string>>"))
    equations = F.when(COL("doc_id") % 2 == 0, F.array(pair(F.lit("a+b"), F.lit("loss"), ("latex", "role")), pair(F.lit("c"), F.lit(""), ("latex", "role")))).otherwise(none("array<struct<latex: string, role: string>>"))
    figures = F.when(COL("doc_id") % 5 == 0, F.array(F.lit("p0-a"), F.lit("p0-b"))).otherwise(none("array<string>"))
    title = F.when(COL("doc_id") % 3 == 0, "A Survey").otherwise("A title")
    return table(spark, d, "documents").select("doc_id", K.digest(COL("doc_id"), title, COL("text"), sections, figures, equations).alias("block"))


@query("SELECT conv_id, string_agg('[read-' || turn || ']' || chr(10) || '  chunk_ids=[' || turn || ', ' || turn + 1 || ']' || chr(10) || '  ' || substr(text, 1, 500), chr(10) || chr(10) ORDER BY turn) AS block FROM conversations GROUP BY 1")
def add15_reads(spark: SparkSession, d: str) -> DataFrame:
    from quillspark.operators import context as K

    turn = COL("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("read-"), turn.cast("string")).alias("key"), F.array(turn, turn + 1).alias("chunk_ids"), "text")
    return K.reads(rows, "conv_id", "turn")


@query("SELECT doc_id, '[paper ' || doc_id || '] ' || CASE WHEN doc_id % 4 = 0 THEN '(untitled)' ELSE 'T' END || chr(10) || '  authors: ' || lang || ', B' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '  narrative: told' ELSE '  abstract: ' || source END || chr(10) || '  section excerpts:' || CASE WHEN t = '' THEN '' ELSE chr(10) || '    - [S] ' || CASE WHEN length(t) > 400 THEN substr(t, 1, 400) || '…' ELSE t END END AS block FROM (SELECT *, trim(text) AS t FROM documents)")
def add15_paper_notes(spark: SparkSession, d: str) -> DataFrame:
    from quillspark.operators import context as K

    title, told = F.when(COL("doc_id") % 4 > 0, "T"), F.when(COL("doc_id") % 2 == 0, "told")
    excerpts = F.array(F.struct(F.lit("S").alias("name"), COL("text").alias("text")), F.struct(F.lit(None).cast("string").alias("name"), F.lit("  ").alias("text")))
    return table(spark, d, "documents").select("doc_id", K.paper_notes(COL("doc_id"), title, F.array("lang", F.lit("B")), told, COL("source"), excerpts).alias("block"))
