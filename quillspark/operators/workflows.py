"""Workflows over tables as pure functions from old frames to new ones; the caller writes the results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.relational import fresh_ids, remap
from quillspark.state import materialise


@dataclass
class Fork:
    """What a fork adds to each table."""

    session: DataFrame
    messages: DataFrame
    runs: DataFrame
    papers: DataFrame
    memories: DataFrame
    decks: DataFrame


def fork(sessions: DataFrame, messages: DataFrame, runs: DataFrame, papers: DataFrame, memories: DataFrame, decks: DataFrame, source: int, at_message: int, new_session: int, run_above: int) -> Fork:
    """A new session with everything of the source before a message: runs get new ids, memories begin new chains.

    The deck comes along only if a run before the fork point made it.
    """
    session = sessions.filter(F.col("id") == source).select(F.lit(new_session).alias("id"), F.concat(F.lit("Fork of "), F.col("title")).alias("title"), F.lit(source).alias("forked_from"))
    kept = messages.filter((F.col("session_id") == source) & (F.col("id") < at_message))
    used = kept.select("run_id").filter("run_id is not null").distinct().join(runs.select(F.col("id").alias("run_id")), "run_id", "left_semi")
    ids = fresh_ids(used, "run_id", run_above)
    new_messages = remap(kept, "run_id", ids).select(F.lit(new_session).alias("session_id"), "id", "role", "content", F.col("new_id").alias("run_id"))
    new_runs = runs.join(ids.withColumnRenamed("run_id", "id"), "id").select(F.col("new_id").alias("id"), F.lit(new_session).alias("session_id"), "status")
    new_papers = papers.filter(F.col("session_id") == source).withColumn("session_id", F.lit(new_session))
    new_memories = memories.filter((F.col("session_id") == source) & (F.col("scope") == "session") & (F.col("status") == "active")).select(F.lit(new_session).alias("session_id"), "content")
    new_decks = decks.filter(F.col("session_id") == source).join(ids.select("run_id"), "run_id", "left_semi").withColumn("session_id", F.lit(new_session))
    return Fork(session, new_messages, new_runs, new_papers, new_memories, new_decks)


def soft_delete(rows: DataFrame, test: Column, now: Column) -> DataFrame:
    """rows with a tombstone where the test holds and none stood."""
    return rows.withColumn("deleted_at", F.when(test & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at")))


def restore(rows: DataFrame, test: Column) -> DataFrame:
    return rows.withColumn("deleted_at", F.when(~test, F.col("deleted_at")))


def purge(parents: DataFrame, key: str, gone: DataFrame, children: Sequence[tuple[DataFrame, str]]) -> tuple[DataFrame, list[DataFrame]]:
    """parents and their children without the gone keys (a frame with the column key)."""
    return parents.join(gone, key, "left_anti"), [c.join(gone.withColumnRenamed(key, k), k, "left_anti") for c, k in children]


def supersede(memories: DataFrame, new: DataFrame) -> DataFrame:
    """memories with the new ones (id, content, supersedes); those they replace are superseded."""
    old = new.select(F.col("supersedes").alias("id"), F.col("id").alias("__by"))
    flipped = memories.join(old, "id", "left").select("id", "content", F.when(F.col("__by").isNotNull(), "superseded").otherwise(F.col("status")).alias("status"), "supersedes", F.coalesce("__by", "superseded_by").alias("superseded_by"))
    return flipped.unionByName(new.select("id", "content", F.lit("active").alias("status"), "supersedes", F.lit(None).cast("long").alias("superseded_by")))


def history(memories: DataFrame, root: int) -> DataFrame:
    """The chain a memory began, from oldest to newest, of any length: the known part doubles with each round."""
    seen = materialise(memories.filter(F.col("id") == int(root)).select("id", F.lit(0).cast("long").alias("step")), "chain")
    ahead, reach = memories.filter("superseded_by is not null").select("id", F.col("superseded_by").alias("to")), 1
    while True:
        new = seen.join(ahead, "id").select(F.col("to").alias("id"), (F.col("step") + reach).alias("step"))
        new = materialise(new.join(seen.select("id"), "id", "left_anti").groupBy("id").agg(F.min("step").alias("step")), "chain")
        if new.isEmpty():
            break
        seen = materialise(seen.unionByName(new), "chain")
        ahead, reach = materialise(ahead.join(ahead.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")), "chain"), reach * 2
    return memories.select("id", "content").join(seen, "id").select("id", "content", F.col("step").cast("int").alias("step"))


def resolve_style(sessions: DataFrame, overrides: DataFrame, memory: DataFrame, default: str) -> DataFrame:
    """session_id and style: the session's override, else the newest global memory, else the default."""
    newest = memory.agg(F.max_by("content", F.struct("updated_at", "id")).alias("__global"))
    rows = sessions.join(overrides, "session_id", "left").join(F.broadcast(newest))  # newest is one row
    return rows.select("session_id", F.coalesce("preamble", "__global", F.lit(default)).alias("style"))


def restricted_delete(content: DataFrame, key: str, wanted: DataFrame, references: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(what stays, refused): referenced rows are refused unless forced; refused has the count of references."""
    used = references.groupBy(key).agg(F.count("*").alias("n_references"))
    refused = wanted.join(used, key) if not force else wanted.join(used, key).limit(0)
    return content.join(wanted.join(refused.select(key), key, "left_anti"), key, "left_anti"), refused


def may_edit(rows: DataFrame, session: int) -> DataFrame:
    return rows.withColumn("editable", (F.col("scope") == "global") | (F.col("session_id") == session))


def replay_text(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """run_id and text: a line for each step, in order."""
    line = F.format_string("[%d] %s.%s %s", "step_index", "agent", "tool", "status")
    lines = steps.select("run_id", "branch", "step_index", line.alias("line"))
    joined = lines.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("branch", "step_index", "line"))).alias("l"))
    return runs.join(joined, "run_id", "left").select("run_id", F.concat_ws("\n", F.concat(F.lit("run "), F.col("run_id").cast("string"), F.lit(": "), F.col("status")), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))


def grounding(runs: DataFrame) -> DataFrame:
    """Checks of finished runs, by intent.

    runs: run_id, expected, actual, answer, cited (array), resolved (count), statuses (array), pages, results.
    """
    intent = F.coalesce("actual", "expected")
    checks = {
        "intent_match": F.col("expected").isNull() | F.col("expected").eqNullSafe(F.col("actual")),
        "all_steps_ok": (F.size("statuses") > 0) & F.forall("statuses", lambda s: s == "ok"),
        "deck_generated": F.when(intent == "slides", F.coalesce("pages", F.lit(0)) > 0),
        "citations_present": F.when(intent == "paper_qa", F.size("cited") > 0),
        "citations_resolve": F.when(intent == "paper_qa", (F.col("resolved") > 0) & (F.col("resolved") == F.size("cited"))),
        "results_returned": F.when(intent.isin("paper_search", "paper_suggest"), F.coalesce("results", F.lit(0)) > 0),
        "answered": F.when(~F.coalesce(intent, F.lit("")).isin("slides", "paper_qa", "paper_search", "paper_suggest"), F.trim(F.coalesce("answer", F.lit(""))) != ""),
    }
    return runs.select("run_id", *[c.alias(n) for n, c in checks.items()])


def grade(error: Column, expected: Column, actual: Column, judged: Column | None = None) -> Column:
    """0 for errors, 1 or 0 for a labelled intent, else the judge's score or null."""
    out = F.when(error, 0.0).when(expected.isNotNull(), F.when(expected == actual, 1.0).otherwise(0.0))
    return out if judged is None else out.otherwise(judged)


def scope_frames(frames: DataFrame, scope: str, page: int | None) -> DataFrame:
    """Frames (frame, page_start, page_end) of a scope: all, current (else the first), or page (else that of the page)."""
    if scope == "all":
        return frames
    hit = frames.filter(F.lit(page).between(F.col("page_start"), F.col("page_end"))) if page is not None else frames.limit(0)
    if scope == "page":
        return hit
    first = frames.orderBy("frame").limit(1)
    return hit.unionByName(first.join(hit.agg(F.count("*").alias("__n")).filter("__n = 0")).drop("__n"))


def content_numbers(frames: DataFrame) -> DataFrame:
    """content (from 0, titles skipped) and frame, the frame's number in the deck."""
    w = Window.partitionBy("deck").orderBy("frame")
    return frames.filter("not is_title").withColumn("content", F.row_number().over(w) - 1).select("deck", "content", "frame")


def checked_claims(claims: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(claims with known values over claimed ones and unknown keys null, dropped: unknown keys).

    known: key and trusted columns, which claims may have too.
    """
    trusted = [c for c in known.columns if c != key]
    side = known.withColumnsRenamed({c: f"__{c}" for c in trusted}).withColumn("__hit", F.lit(True))
    rows = claims.join(side, key, "left")
    out = rows.select(F.when(F.col("__hit"), F.col(key)).alias(key), *[F.coalesce(f"__{c}", c).alias(c) if c in trusted else F.col(c) for c in claims.columns if c != key])
    return out, claims.join(known.select(key), key, "left_anti").select(key).distinct()


def edit_frames(frames: DataFrame, op: str, at: int, tex: str = "") -> DataFrame:
    """Frames (frame from 0, tex) after one edit: insert behind (-1: in front), replace, delete. Indices out of range fail."""
    n = frames.count()
    if not (-1 if op == "insert" else 0) <= at < n:
        raise IndexError(f"frame {at} of {n}")
    if op == "replace":
        return frames.withColumn("tex", F.when(F.col("frame") == at, tex).otherwise(F.col("tex")))
    if op == "delete":
        return frames.filter(F.col("frame") != at).withColumn("frame", F.col("frame") - F.when(F.col("frame") > at, 1).otherwise(0))
    new = frames.sparkSession.createDataFrame([(at + 1, tex)], frames.schema)
    return frames.withColumn("frame", F.col("frame") + F.when(F.col("frame") > at, 1).otherwise(0)).unionByName(new)


def carried(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """new with the old values of columns by key; empty ones don't count."""
    side = old.select(F.col(key), *[F.when(F.col(c) != "", F.col(c)).alias(f"__{c}") for c in columns])
    return new.join(side, key, "left").select(*[c for c in new.columns if c not in columns], *[F.coalesce(f"__{c}", F.col(c) if c in new.columns else F.lit(None)).alias(c) for c in columns])


def upsert_trace(records: DataFrame) -> DataFrame:
    """Per run and step the newest record by arrival; of heartbeats (negative steps) one, the newest, last in order."""
    step = F.when(F.col("step_index") < 0, F.lit(None).cast("int")).otherwise(F.col("step_index"))
    rows = records.withColumn("__step", step).groupBy("run_id", "__step").agg(F.max_by(F.struct("step_index", "payload"), "arrival").alias("r"))
    return rows.select("run_id", "r.step_index", "r.payload", F.coalesce("__step", F.lit(2147483647)).alias("place"))


def reconcile(local: DataFrame, server: DataFrame) -> DataFrame:
    """Local sessions (id, title, is_draft, place) against the server's (id, title, place): drafts and listed rows stay,

    titles are the server's, and rows only the server has come first, in its order.
    """
    a, b = local.select(F.col("id"), F.col("title").alias("lt"), F.col("is_draft"), F.col("place").alias("lp")), server.select(F.col("id"), F.col("title").alias("st"), F.col("place").alias("sp"))
    rows = a.join(b, "id", "full_outer").filter(F.col("sp").isNotNull() | F.coalesce("is_draft", F.lit(False)))
    return rows.select("id", F.coalesce("st", "lt").alias("title"), F.struct(F.col("lp").isNotNull().alias("known"), F.coalesce("lp", "sp").alias("place")).alias("order_key"))


def message_states(messages: DataFrame) -> DataFrame:
    """session_id, id, role, state; a running turn without a reply gets a placeholder."""
    w = Window.partitionBy("session_id").orderBy("id")
    rows = messages.filter(F.col("role").isin("user", "assistant")).withColumn("__next", F.lead("id").over(w))
    bad = F.col("run_status").isin("interrupted", "error") & (F.col("role") == "assistant")
    states = rows.select("session_id", "id", "role", F.when(bad, F.col("run_status")).otherwise("ok").alias("state"))
    waiting = rows.filter((F.col("role") == "user") & (F.col("run_status") == "running") & F.col("__next").isNull())
    return states.unionByName(waiting.select("session_id", F.lit(None).cast("long").alias("id"), F.lit("assistant").alias("role"), F.lit("processing").alias("state")))
