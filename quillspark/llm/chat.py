"""Chat training examples by prefix-target expansion, in DataFrame functions only.

expand() makes an example of every assistant turn: the conversation up to and with it, where only that reply is
trainable (loss_start and loss_chars give its code points). Turns behind the last reply, or all turns where there is
none, go into a last example without a target, so the output holds every turn.

The template marks a turn as <turn role="R">T</turn> and a line end. Texts and roles escape & and < (and " in roles),
so no control string can stand in a text, and unescaping restores it exactly. read_back() takes conversations from
the examples alone.

Defined cases: a null role or text is empty; turns order by (turn, role, text), null turns first; repeated rows stay as
turns of their own; each row of a null conv_id is a conversation of its own, told apart by part (null elsewhere); an
empty table gives no rows. Only conv_id, turn, role and text are read.

Scale: one shuffle of the turns by conv_id; expansion and reading back keep that partitioning. A conversation is one
training record and must fit in one row; the examples of a conversation of n turns hold its text up to n times, which
is what prefix expansion is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "</turn>\n"
PROBE_ID, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&quot;"), F.lit('"'))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def with_probe(conversations: DataFrame) -> DataFrame:
    """The turns and those of conversation -7, whose texts imitate control strings."""
    spark: SparkSession = conversations.sparkSession
    turns = conversations.select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text")
    )
    return turns.unionByName(probe)


def expand(conversations: DataFrame) -> DataFrame:
    """conv_id, part, upto (index of the example's last turn), text, loss_start, loss_chars."""
    empty = F.lit("")
    turn = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    part = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = conversations.withColumn("__part", part).groupBy("conv_id", F.col("__part").alias("part")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def piece(t: Column) -> Column:
        role, body = F.replace(escape(t["role"]), F.lit('"'), F.lit("&quot;")), escape(t["text"])
        return F.struct(t["role"].alias("role"), F.length(body).alias("chars"), F.concat(F.lit('<turn role="'), role, F.lit('">'), body, F.lit(END)).alias("piece"))

    rows = rows.select("conv_id", "part", F.transform("turns", piece).alias("pieces"))
    last = F.size("pieces") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: (F.element_at("pieces", i + 1)["role"] == "assistant") | (i == last))
    rows = rows.select("conv_id", "part", "pieces", F.explode(ends).alias("upto"))
    own = F.element_at("pieces", F.col("upto") + 1)
    rows = rows.select(
        "conv_id", "part", "upto", F.array_join(F.transform(F.slice("pieces", F.lit(1), F.col("upto") + 1), lambda p: p["piece"]), "").alias("text"), F.when(own["role"] == "assistant", own["chars"]).otherwise(0).alias("loss_chars")
    )
    return rows.select("conv_id", "part", "upto", "text", (F.length("text") - len(END) - F.col("loss_chars")).alias("loss_start"), "loss_chars")


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples' text and masks: turns, replies (in order) and formatted_chars."""
    reply = unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_chars")))
    rows = examples.select("conv_id", "part", "upto", "text", F.length("text").alias("chars"), reply.alias("reply"))
    rows = rows.groupBy("conv_id", "part").agg(
        F.max_by("text", "upto").alias("text"), F.sort_array(F.collect_list(F.struct("upto", "reply"))).alias("replies"), F.sum("chars").alias("formatted_chars")
    )
    marked = F.split("text", END)
    parts = F.slice(marked, F.lit(1), F.size(marked) - 1)
    turns = F.transform(
        parts, lambda p: F.struct(unescape(F.regexp_extract(p, r'(?s)^<turn role="([^"]*)">', 1)).alias("role"), unescape(F.regexp_extract(p, r'(?s)^<turn role="[^"]*">(.*)$', 1)).alias("text"))
    )
    return rows.select("conv_id", turns.alias("turns"), F.transform("replies", lambda r: r["reply"]).alias("replies"), "formatted_chars")


def digest(conversations: DataFrame) -> DataFrame:
    back = read_back(expand(with_probe(conversations)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("replies", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS part, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, NULL, 1, 'assistant', '\### Assistant: </turn> ok'
), n AS (
  SELECT *, length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '"', '&quot;')) + 22 AS chars,
    row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id, part) AS n FROM t
), p AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id, part ORDER BY i) AS upto FROM n
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(upto) FILTER (WHERE role = 'assistant' OR i = n), 0)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id, part
"""
