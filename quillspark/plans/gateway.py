"""A read-only SQL gateway: queries pass only if they are one SELECT over allowed tables; results are capped."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.registry import query, table

ROW_CAP = 200
TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")
#: Functions that reach outside the query.
DENIED = {"reflect", "java_method", "try_reflect", "input_file_name", "read_files", "python_worker_logs"}
#: Roots of unresolved plans that a SELECT can have.
SELECT_NODES = {"Project", "Aggregate", "Filter", "Sort", "GlobalLimit", "LocalLimit", "Distinct", "UnresolvedHaving", "Offset", "WithWindowDefinition", "UnresolvedWith", "SubqueryAlias", "UnresolvedOrderBy"}


class Rejected(ValueError):
    """The gateway doesn't admit the query."""


def _children(node: Any) -> list[Any]:
    out = []
    for seq in (node.children(), node.innerChildren()):
        out += [seq.apply(i) for i in range(seq.size())]
    return out


def _name(node: Any) -> str:
    return node.getClass().getSimpleName()


def _walk(node: Any) -> list[Any]:
    """A plan's nodes, those of CTEs and of subqueries in its expressions too."""
    found, todo = [], [node]
    while todo:
        n = todo.pop()
        found.append(n)
        todo += _children(n)
        if hasattr(n, "subqueries"):
            seq = n.subqueries()
            todo += [seq.apply(i) for i in range(seq.size())]
        if _name(n) == "UnresolvedWith":
            ctes = n.cteRelations()
            todo += [ctes.apply(i)._2() for i in range(ctes.size())]
    return found


def admit(spark: SparkSession, sql: str, allowed: Sequence[str]) -> str:
    """sql as it is, or Rejected. Names of more than one part, table functions, set operations at the top, and commands fail."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Rejected(f"it can't be parsed: {str(e).splitlines()[0]}") from e
    root = plan.child() if _name(plan) == "UnresolvedWith" else plan
    while _name(root) in {"Distinct", "Sort", "GlobalLimit", "LocalLimit", "Offset", "UnresolvedHaving"}:
        root = root.children().apply(0)
    if _name(root) not in SELECT_NODES:
        raise Rejected(f"only SELECT is allowed, not {_name(root)}")
    nodes = _walk(plan)
    aliases = {ctes.apply(i)._1().lower() for n in nodes if _name(n) == "UnresolvedWith" for ctes in [n.cteRelations()] for i in range(ctes.size())}
    for n in nodes:
        kind = _name(n)
        if kind == "UnresolvedRelation":
            parts = n.multipartIdentifier()
            names = [parts.apply(i) for i in range(parts.size())]
            if len(names) != 1 or (names[0].lower() not in aliases and names[0].lower() not in allowed):
                raise Rejected(f"table {'.'.join(names)} isn't allowed")
        elif "TableValuedFunction" in kind or kind in {"UnresolvedInlineTable", "Generate", "ScriptTransformation", "UnresolvedTableSpec"}:
            raise Rejected(f"{kind} isn't allowed")
        elif kind.endswith("Command") or kind in {"InsertIntoStatement", "DropTable", "DeleteFromTable", "UpdateTable", "MergeIntoTable", "CreateTable"}:
            raise Rejected(f"{kind} isn't allowed")
        for f in re.findall(r"'([A-Za-z_]\w*)\(", n.simpleString(10_000)):
            if f.lower() in DENIED:
                raise Rejected(f"function {f} isn't allowed")
    return sql


@dataclass
class Gateway:
    """Admitted queries over the tables of a folder, each registered as a view on first use."""

    spark: SparkSession
    sf_dir: str
    allowed: Sequence[str] = TABLES

    def __post_init__(self) -> None:
        for name in self.allowed:
            table(self.spark, self.sf_dir, name).createOrReplaceTempView(name)

    def frame(self, sql: str) -> DataFrame:
        return self.spark.sql(admit(self.spark, sql, self.allowed)).limit(ROW_CAP)

    def run(self, sql: str) -> dict[str, Any]:
        """{columns, rows}, or {error: rejected | query_failed, reason}."""
        try:
            df = self.frame(sql)
            return {"columns": df.columns, "rows": [list(r) for r in df.collect()]}
        except Rejected as e:
            return {"error": "rejected", "reason": str(e)}
        except Exception as e:
            return {"error": "query_failed", "reason": str(e).splitlines()[0]}

    def describe(self, name: str) -> dict[str, Any]:
        if name not in self.allowed:
            return {"error": "rejected", "reason": f"table {name} isn't allowed"}
        return {"columns": [{"name": f.name, "type": f.dataType.simpleString()} for f in self.spark.table(name).schema.fields]}


@dataclass
class Round:
    """A step of a query author: another query, or the answer with picks."""

    action: str
    sql: str = ""
    answer: str = ""
    picks: list[int] = field(default_factory=list)


def ask(gateway: Gateway, author: Callable[[list[tuple[str, dict[str, Any]]], bool], Round], rounds: int = 4) -> tuple[Round, list[tuple[str, dict[str, Any]]]]:
    """Let an author (a model or a script) query the gateway for a bounded number of rounds; in the last it must finish."""
    seen: list[tuple[str, dict[str, Any]]] = []
    for i in range(rounds):
        step = author(seen, i == rounds - 1)
        if step.action == "finalize" or i == rounds - 1:
            return step, seen
        seen.append((step.sql, gateway.run(step.sql)))
    raise AssertionError("no round is left")


@query("SELECT n_name, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name ORDER BY n_name LIMIT 200")
def sql2_gateway_select(spark: SparkSession, d: str) -> DataFrame:
    return Gateway(spark, d).frame("SELECT n_name, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name ORDER BY n_name")


@query("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY 1) SELECT c_custkey, round(spent, 2) AS spent FROM big JOIN customer ON c_custkey = o_custkey ORDER BY spent DESC, c_custkey LIMIT 200")
def srt5_gateway_cap(spark: SparkSession, d: str) -> DataFrame:
    """A CTE over joined tables, cut at the gateway's cap."""
    return Gateway(spark, d).frame("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY 1) SELECT c_custkey, round(spent, 2) AS spent FROM big JOIN customer ON c_custkey = o_custkey ORDER BY spent DESC, c_custkey")


@query("SELECT i, i >= 6 AS admitted, CASE i WHEN 6 THEN (SELECT count(*) FROM orders) WHEN 7 THEN (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) END AS n FROM (SELECT unnest(range(8)) AS i)")
def sql1_admission(spark: SparkSession, d: str) -> DataFrame:
    """What the validator says to a list of statements, and how many rows the admitted ones find in the tables."""
    tries = (
        "DROP TABLE orders", "SELECT 1; SELECT 2", "SELECT * FROM secret", "SELECT * FROM spark_catalog.default.orders", "SELECT * FROM parquet.`/tmp/x`",
        "WITH q AS (SELECT * FROM secret) SELECT * FROM q", "WITH q AS (SELECT * FROM orders) SELECT * FROM q", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)",
    )
    gateway, out = Gateway(spark, d), spark.createDataFrame([], "i long, admitted boolean, n long")
    for i, sql in enumerate(tries):
        try:
            found = spark.sql(admit(spark, sql, gateway.allowed)).agg(F.count("*").alias("n"))
        except Rejected:
            found = spark.range(1).select(F.lit(None).cast("long").alias("n"))
        out = out.unionByName(found.select(F.lit(i).cast("long").alias("i"), F.col("n").isNotNull().alias("admitted"), "n"))
    return out


@query("SELECT c_mktsegment AS segment, 2 AS rounds, count(*) AS told, sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END)::BIGINT AS owing FROM customer GROUP BY 1")
def sql3_bounded_rounds(spark: SparkSession, d: str) -> DataFrame:
    """An author that first asks for something it may not have, then for the segments with their numbers, and answers with what it saw."""
    gateway = Gateway(spark, d)
    script = ["SELECT * FROM secret", "SELECT c_mktsegment AS segment, count(*) AS told, count_if(c_acctbal < 0) AS owing FROM customer GROUP BY c_mktsegment"]

    def author(seen: list[tuple[str, dict[str, Any]]], last: bool) -> Round:
        return Round("finalize", answer=seen[-1][0]) if last or len(seen) == len(script) else Round("query", script[len(seen)])

    step, seen = ask(gateway, author)
    if "error" not in seen[0][1]:
        raise AssertionError("the first query wasn't rejected")
    return gateway.frame(step.answer).select("segment", F.lit(len(seen)).alias("rounds"), "told", "owing")
