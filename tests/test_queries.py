"""Every query with an oracle gives DuckDB's rows; the others run and keep their schema."""

from __future__ import annotations

import datetime
import decimal
import hashlib
import os

import duckdb
import pytest

from quillspark import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, sf_dir, oracle, name):
    df = core.queries()[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    sql = core.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = oracle.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == names
    want = sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in cursor.fetchall())
    assert got == want


def test_overlaps_of_all_rows(spark, tmp_path):
    events, orders = range(0, 900, 7), range(0, 1300, 3)
    spark.createDataFrame([(i,) for i in events], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(i,) for i in orders], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(map(tuple, core.queries()["joi17_interval_overlap"](spark, str(tmp_path)).collect()))
    assert got == [(a, b) for a in events for b in orders if 3 * a < 2 * b + 15 and 3 * a + 20 > 2 * b]


def test_blocks_of_all_documents(spark, tmp_path):
    langs = {i: "en" if i % 3 else "de" for i in range(0, 500, 7)}
    spark.createDataFrame([(i, "x" * 250, x) for i, x in langs.items()], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.lang, r.part): r.block for r in core.queries()["add15_context_block"](spark, str(tmp_path)).collect()}
    assert got == {(x, p): "\n".join(f"- {i}: {'x' * 200}" for i in langs if langs[i] == x and i // 100 == p) for x in ("de", "en") for p in range(5)}


def test_sql_function_reads_whole_texts(spark, tmp_path):
    texts = [("Ab, 1 " * 30) + end for end in ("Y!", "z?")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(map(tuple, core.queries()["udf1_sql_function"](spark, str(tmp_path)).collect()))
    assert got == {i: hashlib.md5(("ab1" * 30 + end).encode()).hexdigest() for i, end in enumerate("yz")}


def test_recency_of_all_rows(spark, tmp_path):
    days = [datetime.datetime(1995, 1, 1 + i * 11 % 5) for i in range(60)]
    spark.createDataFrame(list(enumerate(days)), "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    got = [r.o_orderkey for r in core.queries()["srt2_recency"](spark, str(tmp_path)).collect()]
    assert got == sorted(range(60), key=lambda i: (days[i], i), reverse=True)


def test_remap_of_all_rows(spark, tmp_path):
    spark.createDataFrame([(k, 40 + k, "FOP"[k % 3]) for k in range(90)], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, n) for k in range(90) for n in (1, 2, 3)], "l_orderkey long, l_linenumber long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, core.queries()["joi10_key_remap"](spark, str(tmp_path)).collect()))
    assert got == [(k, n, None if k % 3 else 1000001 + k // 3) for k in range(90) for n in (1, 2, 3)]


def test_harvest_of_all_runs(spark, tmp_path):
    rows = [(i, i % 90, ("click", "view", "error")[i % 7 % 3]) for i in range(900)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r) for r in core.queries()["src12_harvest"](spark, str(tmp_path)).collect()]
    assert got == sorted(((i, u) for i, u, t in rows if t != "error"), key=lambda x: (-x[1], x[0]))[:200]


def test_headings_cut_within_an_entity(spark, tmp_path):
    heads = ["a &amp; b &amp", "x &copy &lt;i&gt;", "&amp;lt; <b>c</b>  d"]
    spark.createDataFrame([(i, f"<p><h1>{h}</h1></p>") for i, h in enumerate(heads)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.md.split("\n")[2] for r in core.queries()["txt8_html_tables"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == {i: md.split("\n")[2] for i, md in con.execute(core.oracle_sql()["txt8_html_tables"]).fetchall()}
    assert got[0] == "| a & b &amp |  |"


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(core.queries()) <= set(entry.queries())
