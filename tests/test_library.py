"""Gateway, search, workflows, streams, sources."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators import layout as L
from quillspark.operators import relational as R
from quillspark.operators import search as S
from quillspark.operators import workflows as W
from quillspark.plans.gateway import Gateway, Rejected, Round, admit, ask
from quillspark.sources import documents as SD
from quillspark.sources import tables as ST
from quillspark.streaming import trace as R_

ALLOWED = ("orders", "customer")


@pytest.mark.parametrize("sql", [
    "SELECT * FROM orders", "WITH q AS (SELECT * FROM orders) SELECT * FROM q", "SELECT count(*) FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_name HAVING count(*) > 1 ORDER BY 1 LIMIT 3",
    "SELECT DISTINCT o_custkey FROM orders", "WITH secret AS (SELECT 1 AS x) SELECT * FROM secret", "SELECT 'UnresolvedRelation [secret]' FROM orders",
])
def test_admitted(spark, sql):
    assert admit(spark, sql, ALLOWED) == sql


@pytest.mark.parametrize("sql", [
    "DROP TABLE orders", "DELETE FROM orders", "INSERT INTO orders SELECT * FROM orders", "UPDATE orders SET a = 1", "SELECT 1; SELECT 2", "SHOW TABLES", "SET x=1", "EXPLAIN SELECT 1", "CACHE TABLE orders",
    "SELECT * FROM secret", "SELECT * FROM main.orders", "WITH orders AS (SELECT 1) SELECT * FROM main.orders", "SELECT * FROM parquet.`/tmp/x`", "WITH q AS (SELECT * FROM secret) SELECT * FROM q",
    "SELECT * FROM orders WHERE o_custkey IN (SELECT id FROM secret)", "SELECT (SELECT max(x) FROM secret) FROM orders", "SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM orders",
    "SELECT reflect('a', 'b') FROM orders", "SELECT * FROM range(5)", "SELECT * FROM orders UNION SELECT * FROM orders", "not sql",
])
def test_rejected(spark, sql):
    with pytest.raises(Rejected):
        admit(spark, sql, ALLOWED)


def test_gateway_errors_cap_and_rounds(spark, sf_dir):
    g = Gateway(spark, sf_dir)
    assert len(g.run("SELECT * FROM lineitem")["rows"]) == 200
    assert g.run("SELECT nope FROM orders")["error"] == "query_failed" and g.run("DROP TABLE orders")["error"] == "rejected"
    assert g.describe("region")["columns"][0] == {"name": "r_regionkey", "type": "int"} and g.describe("x")["error"] == "rejected"
    asked = []

    def author(seen, last):
        asked.append(last)
        return Round("query", "SELECT 1 AS x FROM region")

    step, seen = ask(g, author)
    assert asked == [False, False, False, True] and len(seen) == 3 and step.action == "query"


@pytest.mark.parametrize(("word", "stem"), [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"),
    ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"),
    ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"),
])
def test_porter(word, stem):
    assert S.porter(word) == stem


def test_search_builders():
    assert S.and_terms("deep AND! (nets) -- a_b") == ["deep", "AND", "nets", "a_b"] and S.or_terms("漢字") == [] and S.stems("Café NETWORKS") == ["cafe", "network"]


def test_ranked_search(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red hen and more words here"), (3, "blue hen"), (4, "x"), (5, None)], "id long, t string")
    postings, lengths = S.build_index(docs, "id", S.simple_terms(F.col("t")))
    assert [r.id for r in S.ranked(postings, lengths, "id", ["red"], True, 9).collect()] in ([1, 2], [2, 1])
    assert [r.id for r in S.ranked(postings, lengths, "id", ["red", "hen"], True, 9).collect()] == [2]
    assert S.ranked(postings, lengths, "id", [], True, 9).collect() == []
    skip = spark.createDataFrame([(2,)], "id long")
    assert {r.id for r in S.ranked(postings, lengths, "id", ["red", "hen"], False, 9, skip).collect()} == {1, 3}


def test_segments_equal_a_rebuild(spark, tmp_path):
    from quillspark.operators.segments import SegmentedIndex
    from quillspark.sources.commits import Store

    rng, now = random.Random(2), {}
    store = Store(spark, (tmp_path / "index").as_uri())
    index = SegmentedIndex(store, "id", lambda rows: S.simple_rows(rows, "id", "t"), tier=3)
    table = lambda texts: spark.createDataFrame(list(texts.items()), "id long, t string")
    for _ in range(9):
        new = {rng.randrange(40): rng.choice([None, "", " ".join(rng.choice("abcde") for _ in range(rng.randrange(9)))]) for _ in range(rng.randrange(6))}
        gone = {rng.randrange(40) for _ in range(rng.randrange(4))} - set(new)
        before = {p.name for p in (tmp_path / "index" / "data").iterdir()} if now else set()
        index.change(table(new), spark.createDataFrame([(i,) for i in gone], "id long"))
        assert before <= {p.name for p in (tmp_path / "index" / "data").iterdir()}
        now = {i: t for i, t in (now | new).items() if i not in gone}
    want = sorted(map(tuple, S.simple_rows(table(now), "id", "t").collect()))
    assert sorted(map(tuple, index.postings().select("term", "id", "tf").collect())) == want
    known = index._segments(store.manifest())
    assert len(known) < 6 and sum(s.docs for s in known) == len(now) and sum(s.words for s in known) == sum(n for t, _, n in want if t == "")
    lengths = table(now).select("id", F.size(F.coalesce(S.simple_terms(F.col("t")), F.array())).alias("length"))
    whole = S.ranked(S.simple_rows(table(now), "id", "t").filter("term <> ''"), lengths, "id", ["a", "c"], False, 50)
    assert index.search(["a", "c"], False, 50).collect() == whole.collect()


def test_tree_order_covers_cycles(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5), (7, 7)], "id long, p long")
    got = {r.id: r.depth for r in R.tree_order(rows, "id", "p").collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 0, 5: 0, 6: 1, 7: 0}


def test_tree_order_walks_behind_cycles_and_down_long_chains(spark):
    """A node that comes before all that it descends from begins a tree, the rest of a cycle and what hangs on it follow."""
    parents = {1: 2, 2: 1, 3: 2, 4: 3, 10: 13, 13: 14, 14: 15, 15: 13, 11: 10, 12: 11, **{i: i - 1 for i in range(101, 1600)}, 100: None}
    out = R.tree_order(spark.createDataFrame(list(parents.items()), "id long, p long"), "id", "p").collect()
    depth = {r.id: r.depth for r in out}
    assert len(out) == len(parents) and [depth[i] for i in (1, 2, 3, 4)] == [0, 1, 2, 3]
    assert [depth[i] for i in (10, 11, 12, 13, 14, 15)] == [0, 1, 2, 0, 2, 1] and all(depth[i] == i - 100 for i in range(100, 1600))
    order = [r.id for r in sorted(out, key=lambda r: r.path) if r.id < 100]
    assert order == [1, 2, 3, 4, 10, 11, 12, 13, 15, 14]


def test_tree_places_of_long_chains_and_wide_trees(spark):
    from quillspark.operators import ranking

    rng = random.Random(9)
    parents = {i: None if i == 5000 or rng.random() < 0.001 else i - 1 if i > 5000 and i % 1000 < 900 else rng.randrange(i) if i else None for i in rng.sample(range(8000), 8000)}
    order = {i: rng.randrange(4) for i in parents}
    children, want = {}, []
    for i, p in parents.items():
        children.setdefault(p, []).append(i)
    todo = [(i, 0) for i in sorted(children[None], key=lambda i: (order[i], i), reverse=True)]
    while todo:
        i, depth = todo.pop()
        want.append((i, depth, len(want)))
        todo += [(c, depth + 1) for c in sorted(children.get(i, []), key=lambda i: (order[i], i), reverse=True)]
    nodes = spark.createDataFrame([(i, p, order[i]) for i, p in parents.items()], "id long, p long, o int")
    assert max(d for _, d, _ in want) > 500
    for small in (600, 1 << 16):
        got = ranking.forest_order(nodes, "id", "p", "o", small=small)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert R.tree_places(nodes.limit(0), "id", "p").collect() == []


def test_history_of_a_long_chain(spark):
    chain = spark.range(700).select("id", F.lit("m").alias("content"), F.when(F.col("id") % 350 != 349, F.col("id") + 1).alias("superseded_by"))
    from quillspark.operators import workflows as W

    assert sorted(map(tuple, W.history(chain, 360).select("id", "step").collect())) == [(360 + i, i) for i in range(340)]
    assert W.history(chain, 9999).count() == 0


def test_search_stems_folds_and_orders_by_the_raw_score(spark):
    docs = spark.createDataFrame([(1, "Café networks, networked"), (2, "a network of cafés"), (3, "nothing"), (4, None), (5, "cafe " * 30)], "id long, t string")
    wanted = S.query_stems(S.and_terms("CAFÉ network"))
    assert wanted == ["cafe", "network"] and sorted(r.id for r in S.matching(docs, "id", "t", wanted, True).collect()) == [1, 2]
    assert sorted(r.id for r in S.matching(docs, "id", "t", wanted, False).collect()) == [1, 2, 5]
    assert [r.id for r in S.search(docs, "id", "t", wanted, True, 9, docs.filter("id = 2").select("id")).collect()] == [1]
    assert "networking" in S.forms("network") and all(S.porter(w) == "network" for w in S.forms("network"))
    same = spark.createDataFrame([(i, "red " + "pad " * (1000 - i)) for i in range(4)], "id long, t string")
    assert [r.id for r in S.search(same, "id", "t", ["red"], True, 4).collect()] == [3, 2, 1, 0]


def test_layout_chunks_deal_texts_out_twice(spark):
    rows = [(d, 4 * i, f"b{i}", "SectionHeader" if i % 4 == 0 else "Text", f"<p>said {i}</p>", "", {"1": f"b{i - i % 4}"}, [0.0, 0.0, 1.0, 1.0], i // 8, None) for d in (1, 2) for i in range(16)]
    rows += [(d, 4 * i + 2, f"g{i}", "TableGroup", f"<content-ref src='b{i + 1}'></content-ref>", "", {}, [0.0, 0.0, 2.0, 2.0], i // 8, None) for d in (1, 2) for i in (4, 8)]
    chunks = L.assemble(spark.createDataFrame(rows, L.BLOCKS))
    got = {d: " ".join(r.text for r in chunks.filter(f"doc = {d}").orderBy("ordinal").collect()).split() for d in (1, 2)}
    assert got[1] == got[2] == " ".join(f"## said {i}" if i % 4 == 0 else f"said {i}" for i in range(16) if i not in (5, 9)).split()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = L.assemble(spark.createDataFrame(rows, L.BLOCKS))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(doc#") - plan.count("ENSURE_REQUIREMENTS") <= 7 and plan.count("ENSURE_REQUIREMENTS") <= 4, plan


def test_greedy_overlap_uses_each_candidate_once(spark):
    rows = spark.createDataFrame([(1, "target", 0, ["a", "b"]), (1, "target", 1, ["a", "b"]), (1, "candidate", 0, ["a", "b", "c"]), (1, "candidate", 1, ["a", "z"]), (1, "target", 2, [])], "doc long, side string, pos int, tokens array<string>")
    assert sorted((r.target, r.candidate) for r in R.greedy_overlap(rows, "doc", 0.5).collect()) == [(0, 0), (1, 1)]


def test_greedy_overlap_meets_only_candidates_that_share_a_word(spark):
    rng, words = random.Random(3), [f"w{i}" for i in range(12)]
    parts = [(rng.choice(["target", "candidate"]), pos, rng.sample(words, rng.randrange(5))) for pos in range(60)]
    free, want = {c: set(t) for s, c, t in parts if s == "candidate"}, []
    for _, pos, t in (p for p in parts if p[0] == "target" and p[2]):
        score, minus = max(((len(set(t) & have) / len(set(t)), -c) for c, have in free.items()), default=(0.0, 0))
        if score >= 0.3:
            free.pop(-minus)
            want.append((pos, -minus, score))
    rows = spark.createDataFrame([(d, s, p, t) for d in (1, 2) for s, p, t in parts], "doc long, side string, pos int, tokens array<string>")
    got = [(r.doc, r.target, r.candidate, r.score) for r in R.greedy_overlap(rows, "doc", 0.3).collect()]
    assert sorted(got) == [(d, *w) for d in (1, 2) for w in want]
    n = 6000  # each line has a word of its own: before, 36 million pairs of sets
    lines = [("candidate", 2 * i + 1, [f"c{i}"]) for i in range(n)] + [("target", 2 * i, [f"c{n - 1 - i}", "x"]) for i in range(n)]
    began = time.perf_counter()
    assert R._greedy(lines, 0.5) == [(2 * i, 2 * (n - 1 - i) + 1, 0.5) for i in range(n)] and time.perf_counter() - began < 5


def test_spans_and_intervals(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 4, 8), (1, 8, 9), (1, 1, 2)], "k int, s int, e int")
    assert sorted((r.s, r.e) for r in R.merge_spans(rows, ["k"], "s", "e").collect()) == [(0, 8), (8, 9)]
    a, b = spark.createDataFrame([(1, 0, 100), (2, 7, 8)], "a int, s int, e int"), spark.createDataFrame([(1, 99, 101), (2, 100, 102), (3, 7, 8)], "b int, s int, e int")
    assert sorted((r.a, r.b) for r in R.interval_overlap(a, b, "s", "e", 16).collect()) == [(1, 1), (1, 3), (2, 3)]


def test_workflow_edits(spark):
    frames = spark.createDataFrame([(0, "a"), (1, "b")], "frame int, tex string")
    order = lambda df: [r.tex for r in df.orderBy("frame").collect()]
    assert order(W.edit_frames(frames, "insert", -1, "x")) == ["x", "a", "b"] and order(W.edit_frames(frames, "delete", 0)) == ["b"] and order(W.edit_frames(frames, "replace", 1, "y")) == ["a", "y"]
    with pytest.raises(IndexError):
        W.edit_frames(frames, "delete", 2)
    pages = spark.createDataFrame([(0, 1, 2), (1, 3, 3)], "frame int, page_start int, page_end int")
    assert [r.frame for r in W.scope_frames(pages, "current", 9).collect()] == [0] and W.scope_frames(pages, "page", 9).count() == 0 and W.scope_frames(pages, "all", None).count() == 2


def test_layout_assembly(spark):
    box = [0.0, 0.0, 1.0, 1.0]
    rows = [
        (1, 0, "t0", "TableGroup", "<content-ref src='c'></content-ref><content-ref src='t'></content-ref>", "", {}, None, 0, None), (1, 1, "c", "Caption", "<p>Table 2: Results</p>", "", {}, box, 0, None),
        (1, 2, "t", "Table", "<table><tr><th>x</th></tr></table>", "", {}, [0.0, 0.0, 5.0, 2.0], 0, None), (1, 3, "h", "SectionHeader", "<h2>Method</h2>", "", {}, box, 0, None), (1, 4, "p1", "Text", "<p>one</p>", "", {"1": "h"}, box, 0, None),
        (1, 5, "p2", "Text", "<p>two</p>", "", {}, [0.0, 3.0, 2.0, 4.0], 0, None), (1, 6, "e", "Equation", "", "x=1", {}, box, 1, None), (1, 7, "f", "PageFooter", "<p>9</p>", "", {}, box, 1, None), (1, 8, "g", "Figure", "<p>Fig. 3 shows</p>", "", {}, box, 1, None),
    ]
    chunks = L.assemble(spark.createDataFrame(rows, L.BLOCKS)).orderBy("ordinal").collect()
    assert [(c.section, c.text, c.layout_label) for c in chunks] == [
        ("Method", "*Table 2: Results*\n\n| x |\n| --- |", "Table 2"), ("Method", "## Method\n\none\n\ntwo", None), ("Method", "$$ x=1 $$", None), ("Method", "*Fig. 3 shows*", "Figure 3")]
    assert chunks[0].bbox == [0.0, 0.0, 5.0, 2.0] and chunks[1].bbox == [0.0, 0.0, 2.0, 4.0] and chunks[1].char_start == chunks[0].char_end + 2


def test_sources(spark, tmp_path):
    good, bad = tmp_path / "good", tmp_path / "bad"
    good.mkdir(), bad.mkdir()
    (good / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (bad / "b.jsonl").write_text('{"a": 1}\n{oops\n')
    assert ST.read_jsonl(spark, str(good), "a int").filter("a is not null").count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        ST.read_jsonl(spark, str(bad), "a int").collect()
    assert [(r.line, r.value) for r in ST.line_errors(spark, str(bad), "a int").collect()] == [(2, "{oops")]
    paper = tmp_path / "papers" / "p1"
    (paper / "sections").mkdir(parents=True)
    (paper / "main.tex").write_text("\\documentclass{x}\\title{T}\n\\begin{document}\nHi \\input{sections/a} \\include{gone}\n\\end{document} tail")
    (paper / "aaa.tex").write_text("\\documentclass{x}\\begin{document}t\\end{document}")
    (paper / "sections" / "a.tex").write_text("inner \\input{main}")
    got = SD.latex_folders(SD.text_files(spark, str(tmp_path / "papers")), str(tmp_path / "papers")).collect()
    assert [(r.text, r.preamble) for r in got] == [("Hi inner", "\\documentclass{x}\\title{T}\n")]
    (tmp_path / "hits.json").write_text(json.dumps([{"id": "1", "title": "A"}]))
    spark.dataSource.register(SD.JsonService)
    assert [tuple(r) for r in spark.read.format("json_service").option("urls", (tmp_path / "hits.json").as_uri()).load().collect()] == [("1", "A")]
    waits = []
    assert SD.with_retry(iter([1]).__next__, [1.0], waits.append, (OSError,)) == 1 and waits == []


def test_versions(spark, tmp_path):
    v = ST.Versions(spark, str(tmp_path / "v"))
    one, two = v.save(spark.range(1)), v.save(spark.range(2))
    assert v.read().count() == 2 and [r.version for r in v.list().collect()] == [two, one]
    three = v.restore(one)
    v.delete(two)
    assert [r.version for r in v.list().collect()] == [three, one] and v.read().count() == 1


def test_streams(spark, tmp_path):
    schema = T.StructType.fromDDL("run_id long, branch string, step_index int, status string, ts timestamp")
    src = tmp_path / "in"
    src.mkdir()
    step = lambda i, s: json.dumps({"run_id": 1, "branch": "m", "step_index": i, "status": s, "ts": f"2024-01-01T00:00:0{i}Z"}) + "\n"
    (src / "a.json").write_text(step(2, "running") + step(1, "running") + step(2, "running"))
    (src / "b.json").write_text(step(3, "ok") + step(4, "error"))
    rows = R_.file_stream(spark, str(src), schema, 1)
    q = R_.unique_steps(rows).writeStream.format("memory").queryName("uniq").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.step_index for r in spark.table("uniq").collect()) == [1, 2, 3, 4]
    q = R_.run_states(rows).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert max((r.n_events, r.status) for r in spark.table("states").collect()) == (5, "ok")


def test_queue_worker(spark):
    def handle(r):
        if r["id"] == 2:
            raise TimeoutError
        if r["id"] == 3:
            raise ValueError

    batch = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "pending"), (4, "done")], "id long, status string")
    assert {r.id: r.status for r in R_.queue_worker(handle, (TimeoutError,))(batch, 0).collect()} == {1: "done", 2: "pending", 3: "failed"}


def test_tools_and_cache():
    from quillspark.sources.tools import Expiring, Tools, unwrap

    def broken():
        raise OSError

    made = []
    tools = Tools({"web": lambda: made.append(1) or {"search": lambda q: '{"result": ["' + q + '"]}'}, "down": broken})
    assert tools.names() == ["web.search"] and tools.call("web.search", q="x") == ["x"] and made == [1]
    with pytest.raises(KeyError):
        tools.call("web.nope")
    assert unwrap(unwrap('{"result": 1}')) == 1 and unwrap("{bad") == "{bad" and unwrap({"result": 1, "b": 2}) == {"result": 1, "b": 2}
    now, calls = [0.0], []
    cache = Expiring(5, lambda: now[0])
    for t in (0, 4, 5):
        now[0] = t
        cache.get("k", lambda: calls.append(1))
    assert len(calls) == 2


def test_replace_table(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (1, 3):
        ST.replace_table(spark.range(n), path)
        assert ST.current_table(spark, path).count() == n
    with pytest.raises(Exception, match="raised"):
        ST.replace_table(spark.range(9).select(F.assert_true(F.col("id") < 5, F.lit("raised"))), path)
    assert ST.current_table(spark, path).count() == 3


def test_lines_are_numbered_over_the_parts_of_a_file(spark, tmp_path):
    path = str(tmp_path / "lines")
    (tmp_path / "lines").mkdir()
    for name, n in (("a", 5000), ("b", 3)):
        (tmp_path / "lines" / name).write_text("".join(f"{i}{'x' * (i % 50)}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = ST.numbered_lines(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 5003 and all(r.value.rstrip("x") == str(r.line) for r in rows)


def test_pdf_rows(spark):
    raw = spark.createDataFrame([("a", "  A  Good Title ", "X Y; Z and W", "D:2019", None, [("t", 9.0)]), ("b", "Untitled", None, "D:1800", "D:2020", [("Big", 20.0), ("Title", 20.0), ("x", 9.0)])], "key string, title string, author string, created string, modified string, first_page array<struct<text:string,size:double>>")
    assert [tuple(r) for r in SD.pdf_metadata(raw, 2027).orderBy("key").collect()] == [("a", "A Good Title", ["X Y", "Z", "W"], 2019), ("b", "Big Title", [], 2020)]
    pages = spark.createDataFrame([("a", 1, "y"), ("a", 0, "x")], "key string, page int, text string")
    assert SD.pdf_text(pages, "key").first().text == "x\n\f\ny"


def test_citation_graph(spark):
    edges = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("z", "a")], "citing string, cited string")
    got = {m: sorted(r.paper for r in SD.related(edges, "a", m).collect()) for m in ("cites", "cited_by", "similar")}
    assert got == {"cites": ["x"], "cited_by": ["z"], "similar": ["b"]}


def test_layout_files(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"blocks": [{"block_type": "Text", "html": "<p>x</p>", "block_id": "b", "section_hierarchy": {"1": "h"}, "bbox": [0, 1, 2, 3], "page": 2}]}))
    r = SD.layout_files(spark, str(tmp_path)).first()
    assert (r.pos, r.block_type, r.hierarchy, r.bbox, r.page, r.caption) == (0, "Text", {"1": "h"}, [0.0, 1.0, 2.0, 3.0], 2, None)
