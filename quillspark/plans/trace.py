"""Trace and stream operators over events: a user is a run, an event a step."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark import state
from quillspark.registry import query, table
from quillspark.sources import tables as S
from quillspark.sources.commits import Store, Transaction
from quillspark.streaming import log as G
from quillspark.streaming import trace as R
from quillspark.streaming.queue import JobQueue

COL = F.col


def steps(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, d, "events").select(COL("user_id").alias("run_id"), F.lit("main").alias("branch"), n.cast("long").alias("step_index"), "event_id", "ts", "event_type", "value", "props")


_STEPS = "WITH s AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step_index, * FROM events) "


@query(_STEPS + "SELECT run_id, event_id FROM s WHERE step_index >= 3")
def str1_delta(spark: SparkSession, d: str) -> DataFrame:
    return R.since(steps(spark, d).withColumn("seq", COL("step_index")), 3)[0].select("run_id", "event_id")


@query(_STEPS + "SELECT run_id, max(step_index) + 1 AS next_cursor FROM s GROUP BY 1")
def str1_next_cursor(spark: SparkSession, d: str) -> DataFrame:
    return R.since(steps(spark, d).withColumn("seq", COL("step_index")), 0)[1]


@query(_STEPS + "SELECT run_id, step_index, event_type FROM s WHERE step_index > 2")
def str2_drain(spark: SparkSession, d: str) -> DataFrame:
    return R.drain(steps(spark, d), 2).select("run_id", "step_index", "event_type")


@query(_STEPS + "SELECT run_id, step_index FROM s WHERE NOT (event_id % 3 = 0)")
def str3_out_of_order(spark: SparkSession, d: str) -> DataFrame:
    rows = steps(spark, d)
    return R.new_steps(rows, rows.filter("event_id % 3 = 0")).select("run_id", "step_index")


@query("SELECT event_id FROM events")
def str4_snapshot_and_tail(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", COL("event_id").alias("seq"))
    old, new = R.snapshot_then_tail(rows, rows, 400)
    return old.unionByName(new).select("event_id")


@query("SELECT event_type, event_id, 1 AS seen, count(*) OVER (PARTITION BY event_type) AS told FROM events")
def str4_log_tail(spark: SparkSession, d: str) -> DataFrame:
    """All events through a log that is followed, left, appended to and followed again: each comes once, and the report of counts is written in the commit of its events."""
    rows = table(spark, d, "events").select("event_id", "event_type")
    log, out = Store(spark, state.new_path(spark, "log")), Store(spark, state.new_path(spark, "followed"))

    def count_up(tx: Transaction, batch: DataFrame) -> None:
        counts = batch.groupBy("event_type").agg(F.count("*").alias("n"))
        old = tx.read("report") if "report" in tx.before["tables"] else counts.limit(0)
        tx.replace("report", counts.unionByName(old).groupBy("event_type").agg(F.sum("n").alias("n")))

    for part in (COL("event_id") % 3 == 0, COL("event_id") % 3 == 1, COL("event_id") % 3 == 2):
        log.transact(lambda tx, part=part: tx.append("events", rows.filter(part)))
        G.drain_into(G.follow(spark, log, "events"), out, "seen", "reader", also=count_up)
    seen = out.read("seen").groupBy("event_id", "event_type").agg(F.count("*").cast("int").alias("seen"))
    return seen.join(out.read("report").withColumnRenamed("n", "told"), "event_type").select("event_type", "event_id", "seen", "told")


@query(_STEPS + "SELECT run_id, event_id FROM s WHERE step_index >= run_id % 7")
def str1_log_from_cursors(spark: SparkSession, d: str) -> DataFrame:
    """A reader who comes back with a cursor for each run gets what is behind it."""
    rows = steps(spark, d).select("run_id", "event_id", "step_index")
    log, out = Store(spark, state.new_path(spark, "log")), Store(spark, state.new_path(spark, "followed"))
    log.transact(lambda tx: tx.append("steps", rows))
    cursors = {str(r.run_id): r.run_id % 7 for r in rows.select("run_id").distinct().toLocalIterator()}
    G.drain_into(G.follow(spark, log, "steps", key="run_id", at="step_index", cursors=json.dumps(cursors)), out, "steps", "reader")
    return out.read("steps").select("run_id", "event_id")


@query("WITH r AS (SELECT user_id * 100 + day(ts) AS run_id, count(*) AS n_events, min(CASE WHEN event_type = 'error' THEN ts END) AS ended FROM events GROUP BY 1), m AS (SELECT max(ts) AS last FROM events) SELECT run_id, 'error' AS status, n_events, strftime(ended, '%Y-%m-%d %H:%M:%S.%f') AS ended FROM r, m WHERE ended + INTERVAL 60 SECOND <= last - INTERVAL 10 MINUTE")
def str5_run_evictions(spark: SparkSession, d: str) -> DataFrame:
    """A user's day as a run that its first error ends: the runs that timers evict, in event time, over a log that is followed twice."""
    R.rocks(spark)
    rows = table(spark, d, "events").select((COL("user_id") * 100 + F.dayofmonth("ts")).alias("run_id"), F.when(COL("event_type") == "error", "error").alias("status"), COL("ts").cast("timestamp").alias("ts"))
    log, out = Store(spark, state.new_path(spark, "log")), Store(spark, state.new_path(spark, "runs"))
    for part in (F.dayofmonth("ts") <= 15, F.dayofmonth("ts") > 15, F.lit(False)):  # with the last, empty one the watermark of all events holds
        log.transact(lambda tx, part=part: tx.append("events", rows.filter(part)))
        G.drain_into(R.run_lifecycle(G.follow(spark, log, "events")), out, "changes", "broker", "update")
    return out.read("changes").filter("evicted").select("run_id", "status", "n_events", F.date_format("ended", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ended"))


@query("SELECT conv_id AS run_id, CASE conv_id % 3 WHEN 0 THEN 'final' WHEN 1 THEN 'error' ELSE 'interrupted' END AS type, coalesce((SELECT arg_max(text, turn) FROM conversations a WHERE a.conv_id = c.conv_id AND role = 'assistant'), '') AS data FROM (SELECT DISTINCT conv_id FROM conversations) c")
def str6_replay(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    status = F.element_at(F.array(F.lit("ok"), F.lit("error"), F.lit("cancelled")), (COL("run_id") % 3 + 1).cast("int"))
    runs = rows.select(COL("conv_id").alias("run_id")).distinct().withColumn("status", status)
    return R.replay(runs, rows.select(COL("conv_id").alias("run_id"), "role", COL("text").alias("content"), COL("turn").alias("id")))


@query("SELECT conv_id AS run_id, 'assistant' AS role FROM conversations GROUP BY conv_id HAVING bool_or(role = 'user') AND NOT bool_or(role = 'assistant')")
def str7_dangling(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    messages = rows.select(COL("conv_id").alias("session_id"), COL("conv_id").alias("run_id"), "role", COL("text").alias("content"))
    runs = rows.select(COL("conv_id").alias("run_id"), F.lit("running").alias("status")).distinct()
    return R.reconcile_dangling(runs, messages)[1].select("run_id", "role").distinct()


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 3 THEN 'failed' WHEN c_custkey % 5 = 2 THEN 'pending' ELSE 'done' END AS status, CASE WHEN c_custkey % 5 = 2 AND c_custkey % 7 <> 3 THEN 2 ELSE 1 END AS tries, CASE WHEN c_custkey % 7 <> 3 AND c_custkey % 5 <> 2 THEN length(c_name)::VARCHAR END AS detail FROM customer")
def str8_queue_drain(spark: SparkSession, d: str) -> DataFrame:
    """Customers as jobs, drained twice: some fail, some fail in a way that may pass and are tried again by the second call."""
    queue = JobQueue(Store(spark, state.new_path(spark, "queue")))
    queue.put(table(spark, d, "customer").select(COL("c_custkey").alias("id"), "c_name"))

    def handle(row: dict) -> int:
        if row["id"] % 7 == 3:
            raise ValueError("never")
        if row["id"] % 5 == 2:
            raise ConnectionError("not now")
        return len(row["c_name"])

    for lanes in (4, 1):
        queue.drain(handle, lanes=lanes)
    said = queue.store.read("results").filter("status = 'done'").select(COL("id").alias("of"), "detail")
    return queue.states().join(said, COL("id") == COL("of"), "left").select("id", "status", COL("tries").cast("int").alias("tries"), "detail")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext_hourly_windows(spark: SparkSession, d: str) -> DataFrame:
    """Extension: tumbling windows, the batch form of the watermarked stream."""
    return R.windowed_counts(table(spark, d, "events"), "ts", "1 hour", "10 minutes").select(COL("window.start").alias("w"), "event_type", "n")


@query("SELECT event_id, user_id AS run_id FROM events WHERE event_type IN ('click', 'view') ORDER BY user_id DESC, event_id LIMIT 200")
def src12_harvest(spark: SparkSession, d: str) -> DataFrame:
    """The newest steps of all runs; the cap is the operator's own."""
    rows = table(spark, d, "events").select("event_id", COL("user_id").alias("run_id"), "event_type")
    return S.harvest(rows, COL("event_type").isin("click", "view"), ["event_id"]).select("event_id", "run_id")


@query("SELECT event_id, user_id FROM events WHERE event_id % 2 = 0 UNION SELECT event_id, user_id + 0 FROM events WHERE event_id % 3 = 0")
def snk2_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id")
    return S.insert_ignore(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 3 = 0"), ["event_id"])


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 6 > 0 THEN 'new' WHEN event_id % 2 = 0 AND event_id % 6 = 0 THEN event_type WHEN event_id % 2 = 0 THEN event_type END AS v FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0")
def snk3_upsert(spark: SparkSession, d: str) -> DataFrame:
    """New values win unless they are null, then the old ones stay."""
    rows = table(spark, d, "events")
    old = rows.filter("event_id % 2 = 0").select("event_id", COL("event_type").alias("v"))
    new = rows.filter("event_id % 3 = 0").select("event_id", F.when(COL("event_id") % 2 > 0, "new").alias("v"))
    return S.upsert(old, new, ["event_id"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 5 > 0 UNION ALL SELECT o_orderkey + 9000000, o_custkey FROM orders WHERE o_custkey % 5 = 0 AND o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 5 = 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 5 = 0 AND o_orderstatus = 'F')")
def snk4_replace_partition(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = orders.filter("o_custkey % 5 = 0 and o_orderstatus = 'F'").select((COL("o_orderkey") + 9000000).alias("o_orderkey"), "o_custkey")
    return S.replace_partitions(orders.select("o_orderkey", "o_custkey"), new, ["o_custkey"])


@query("SELECT event_id, '{\"args\":\"<redacted:anthropic> ' || event_type || '\"}' AS args FROM events")
def snk5_redacted_append(spark: SparkSession, d: str) -> DataFrame:
    raw = F.to_json(F.struct(F.concat(F.lit("sk-ant-xyz "), COL("event_type")).alias("args")))
    return S.redacted(table(spark, d, "events").select("event_id", raw.alias("args")), ["args"])


@query("SELECT event_id, 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) AS value FROM events")
def snk6_sse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    return rows.select("event_id", F.concat(F.lit("event: "), COL("event_type"), F.lit("\ndata: "), COL("props"), F.lit("\n\n")).alias("value"))


@query("SELECT event_id FROM events WHERE event_type <> 'error' EXCEPT SELECT event_id FROM events WHERE event_id % 4 = 0")
def snk7_resume(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    return S.remaining(rows.filter("event_type <> 'error'").select("event_id"), rows.filter("event_id % 4 = 0").select("event_id"), "event_id")


@query("SELECT o_custkey, max(o_orderkey) AS version FROM orders GROUP BY 1")
def snk8_latest_versions(spark: SparkSession, d: str) -> DataFrame:
    return S.latest(table(spark, d, "orders").select("o_custkey", COL("o_orderkey").alias("version")), ["o_custkey"], "version").select("o_custkey", "version")
