"""Sources, sinks and whole-document functions over the driver's tables: round trips, and laws with an oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import state
from quillspark.functions import documents as D
from quillspark.operators import slides
from quillspark.registry import query, spread, table
from quillspark.sources import documents as SD
from quillspark.sources import pdf as SP
from quillspark.sources import tables as ST
from quillspark.sources.commits import Conflict, Store, Transaction

COL = F.col


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


@query("SELECT item_id, item_id || '/main.tex' AS root, regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10) || 'part ' || item_id || chr(10) || 'end' AS body FROM benchmark".replace("\\\\", "\\"))
def src2_tex_folders(spark: SparkSession, d: str) -> DataFrame:
    """Each item as a folder of TeX files, written and read back: the root is found, the included part put in, the frame around it cut."""
    items = table(spark, d, "benchmark").select("item_id", "text")
    main = F.concat(F.lit("\\documentclass{a}\n\\begin{document}\n"), "text", F.lit("\n\\input{part}\nend\n\\end{document}\nafter"))
    files = F.array(
        F.struct(F.lit("main").alias("name"), main.alias("content")), F.struct(F.lit("part").alias("name"), F.concat(F.lit("part "), COL("item_id").cast("string")).alias("content")),
        F.struct(F.lit("notes").alias("name"), F.lit("\\section{x} notes only").alias("content")),
    )
    rows = items.select(F.concat(F.lit("/papers/"), COL("item_id").cast("string"), F.lit("/")).alias("dir"), F.explode(files).alias("f"))
    found = SD.latex_folders(rows.select(F.concat("dir", "f.name", F.lit(".tex")).alias("path"), "f.content"), "/papers")
    number = F.regexp_extract("dir", r"(\d+)$", 1)
    return found.select(number.cast("long").alias("item_id"), F.regexp_extract("root", "([^/]*/[^/]*)$", 1).alias("root"), COL("text").alias("body"))


#: A page of a text: PAGE characters, in lines of LINE.
PAGE, LINE = 2000, 80
_PAGES = "SELECT doc_id, page, substr(body, 1 + page * 2000, 2000) AS part FROM (SELECT doc_id, body, unnest(range(greatest(1, (length(body) + 1999) // 2000))) AS page FROM (SELECT doc_id, {body} AS body FROM documents))"
_PLAIN = "trim(regexp_replace(coalesce(text, ''), '[\\x00-\\x20\\x7f-\\xa0]+', ' ', 'g'))"


@query("SELECT doc_id, string_agg(part, chr(10) || chr(12) || chr(10) ORDER BY page) AS text FROM (" + _PAGES.format(body="coalesce(text, '')") + ") GROUP BY 1")
def src3_page_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every text as pages of a fixed length to its end, joined again."""
    text = F.coalesce("text", F.lit(""))
    rows = _docs(spark, d).select("doc_id", text.alias("text"), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(text) - 1) / PAGE).cast("int")))).alias("page"))
    return SD.pdf_text(rows.select("doc_id", "page", F.substr("text", 1 + COL("page") * PAGE, F.lit(PAGE)).alias("text")), "doc_id")


def _cut(c: Column, size: int) -> Column:
    """A text in pieces of size characters, one at least."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(c) - 1) / size).cast("int"))), lambda i: F.substr(c, 1 + i * size, F.lit(size)))


def _pdfs(spark: SparkSession, d: str, headed: bool) -> DataFrame:
    """(doc_id, content): every document as a PDF, of either kind; some with wrong references, some that are none. headed: with a title, banners and headings."""
    line = lambda size, text: F.struct(F.lit(size).alias("size"), text.alias("text"))
    key = COL("doc_id").cast("string")
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x20\x7f-\xa0]+", " "))
    head = lambda i: F.array(line(13.0, F.lit("Journal")), line(13.0, F.concat(F.lit("Part "), (i + 1).cast("string"), F.lit(" of "), key)), line(13.0, F.lit("see www.x")))
    body = lambda page: F.transform(_cut(page, LINE), lambda t: line(10.0, t))
    pages = F.transform(_cut(COL("plain"), PAGE), (lambda p, i: F.concat(F.when(i == 0, F.array(line(18.0, F.lit("A title")))).otherwise(F.array().cast("array<struct<size:double,text:string>>")), head(i), body(p))) if headed else lambda p: body(p))
    rows = _docs(spark, d).select("doc_id", plain.alias("plain")).select("doc_id", pages.alias("pages"), F.concat(F.lit("The title of "), key).alias("title"), F.concat(F.lit("Ä. B; C "), key).alias("author"), (COL("doc_id") % 2 == 0).alias("packed"))
    made = SP.with_pdf(rows, "pages", "title", "author", "packed")
    wrong = F.concat(F.expr("substring(content, 1, octet_length(content) - 12)"), F.lit("7\n%%EOF\n").cast("binary"))  # another place for the references
    return made.select("doc_id", F.when(COL("doc_id") % 11 == 3, F.concat(F.lit("no").cast("binary"), F.expr("substring(content, 9)"))).when(COL("doc_id") % 11 == 5, wrong).otherwise(COL("content")).alias("content"))


@query("WITH p AS (" + _PAGES.format(body=_PLAIN) + "), l AS (SELECT doc_id, page, string_agg(substr(part, 1 + i * 80, 80), chr(10) ORDER BY i) AS part FROM (SELECT *, unnest(range(greatest(1, (length(part) + 79) // 80))) AS i FROM p) GROUP BY 1, 2), t AS (SELECT doc_id, count(*)::INT AS pages, string_agg(part, chr(10) || chr(12) || chr(10) ORDER BY page) AS text FROM l GROUP BY 1) SELECT doc_id, CASE WHEN doc_id % 11 <> 3 THEN pages END AS pages, CASE WHEN doc_id % 11 <> 3 THEN md5(text) END AS text_md5, CASE WHEN doc_id % 11 <> 3 THEN 'The title of ' || doc_id END AS title, CASE WHEN doc_id % 11 <> 3 THEN 'Ä. B|C ' || doc_id END AS authors, CASE WHEN doc_id % 11 = 3 THEN 'not a PDF' END AS error FROM t")
def src3_pdf_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a PDF, written and read: pages, text, title and authors; what is no PDF has an error."""
    files = state.materialise(_pdfs(spark, d, headed=False), "pdf")
    texts = SD.pdf_text(SP.page_texts(SP.spans(files), "doc_id"), "doc_id").withColumnRenamed("doc_id", "id")
    said = state.materialise(SP.info(files), "info").withColumnRenamed("doc_id", "key")
    raw = said.select("key", "title", "author", "created", "modified", F.expr("cast(array() as array<struct<text: string, size: double>>)").alias("first_page"))
    named = SD.pdf_metadata(raw, 2026).select(COL("key").alias("named"), COL("title").alias("own"), F.array_join("authors", "|").alias("authors"))
    rows = said.join(texts, COL("key") == COL("id"), "left").join(named, COL("key") == COL("named"), "left")
    return rows.select(COL("key").alias("doc_id"), "pages", F.md5(COL("text").cast("binary")).alias("text_md5"), COL("own").alias("title"), F.when(COL("error").isNull(), COL("authors")).alias("authors"), "error")


@query(
    "WITH p AS (" + _PAGES.format(body=_PLAIN) + "), i AS (SELECT *, unnest(range(greatest(1, (length(part) + 79) // 80))) AS i FROM p WHERE doc_id % 11 <> 3), "
    "l AS (SELECT doc_id, page, sum(length(trim(substr(part, 1 + i * 80, 80)))) AS solid, sum(length(substr(part, 1 + i * 80, 80))) + count(*) - 1 AS n FROM i GROUP BY 1, 2), "
    "h AS (SELECT *, CASE WHEN page = 0 THEN 8 ELSE 0 END AS above, 'Part ' || (page + 1) || ' of ' || doc_id AS name FROM l), "
    "s AS (SELECT *, coalesce(sum(above + 8 + length(name) + 11 + n + 3) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, count(*) OVER (PARTITION BY doc_id) AS pages, "
    "sum(solid) OVER (PARTITION BY doc_id) >= sum(16 + length(name)) OVER (PARTITION BY doc_id) AS set FROM h) "
    "SELECT doc_id, name, (start + above + 8)::BIGINT AS char_start FROM s WHERE set UNION ALL SELECT doc_id, 'Journal', 8 FROM s WHERE set AND pages = 1"
)
def src4_pdf_headings(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a PDF with a title, banners and a heading a page: the headings and where they stand in the whole text."""
    files = state.materialise(_pdfs(spark, d, headed=True), "pdf")
    return SP.sections(state.materialise(SP.spans(files), "spans"), "doc_id").select("doc_id", "name", "char_start")


@query(
    r"WITH t AS (SELECT doc_id, trim(regexp_replace(substr(coalesce(text, ''), 1, 60), '[\x09-\x0D\x20]+', ' ', 'g')) AS said, coalesce(regexp_extract_all(text, '[A-Za-z]+'), []) AS ws FROM documents) "
    "SELECT doc_id::VARCHAR AS key, CASE WHEN doc_id % 4 > 1 AND length(said) >= 5 AND NOT regexp_matches(lower(said), '^(untitled|microsoft word - .*|layout [0-9]+|document[0-9]*|presentation[0-9]*)$') THEN said ELSE 'Big words ' || doc_id END AS title, "
    "array_to_string(list_filter([ws[1] || 'q', ws[2] || 'q', ws[3] || 'q'], lambda w: w IS NOT NULL), '|') AS authors, CASE WHEN doc_id % 5 = 0 THEN 2019 WHEN doc_id % 5 = 1 THEN 2001 END::INT AS year FROM t"
)
def src5_pdf_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The first words of each text as a title, or one that says nothing, so that the largest words of the first page count; its first words as authors; the first year that may be one."""
    key = COL("doc_id").cast("string")
    title = F.when(COL("doc_id") % 4 == 0, "Untitled").when(COL("doc_id") % 4 == 1, "ab").otherwise(F.concat(F.lit(" "), F.regexp_replace(F.substr(F.coalesce("text", F.lit("")), F.lit(1), F.lit(60)), "\x0b", " ")))
    names = F.slice(F.coalesce(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0), F.array().cast("array<string>")), 1, 3)
    names = F.transform(names, lambda w: F.concat(w, F.lit("q")))
    author = F.concat(F.array_join(F.slice(names, 1, 2), "; "), F.when(F.size(names) > 2, F.concat(F.lit(" and "), F.get(names, 2))).otherwise(""))
    page = F.array(F.struct(F.lit("Big  words").alias("text"), F.lit(20.0).alias("size")), F.struct(F.lit("small").alias("text"), F.lit(9.0).alias("size")), F.struct(key.alias("text"), F.lit(20.0).alias("size")))
    raw = table(spark, d, "documents").select(
        key.alias("key"), title.alias("title"), author.alias("author"), F.when(COL("doc_id") % 5 == 0, "D:20190203").when(COL("doc_id") % 5 == 1, "D:1017").alias("created"),
        F.when(COL("doc_id") % 5 < 2, "D:2001").alias("modified"), page.alias("first_page"),
    )
    return SD.pdf_metadata(raw, 2026).select("key", "title", F.array_join("authors", "|").alias("authors"), COL("year").cast("int").alias("year"))


@query("SELECT doc_id, md5(text) AS h, lang FROM documents")
def src13_jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All documents as JSON lines, written and read back."""
    path = state.new_path(spark, "jsonl")
    ST.write_jsonl(table(spark, d, "documents").select("doc_id", "text", "lang"), path)
    return ST.read_jsonl(spark, path, "doc_id long, text string, lang string").select("doc_id", F.md5(COL("text").cast("binary")).alias("h"), "lang")


@query("SELECT e.event_id AS first, 2 * (e.event_id - 1) % 2 + 2 AS parity, count(*) OVER () AS bad FROM events e WHERE e.event_id % 7 = 3")
def src13_bad_lines(spark: SparkSession, d: str) -> DataFrame:
    """Two lines an event in files, the second broken for every seventh: each broken line with an even number, told apart by its text."""
    path = state.new_path(spark, "lines")
    lines = F.concat(F.lit('{"a": '), COL("event_id").cast("string"), F.lit("}\n"), F.when(COL("event_id") % 7 == 3, F.concat(F.lit("{bad "), COL("event_id").cast("string"))).otherwise('{"a": 0}'))
    table(spark, d, "events").select(lines.alias("value")).write.text(path)
    bad = ST.line_errors(spark, path, "a long")
    return bad.select(F.regexp_extract("value", r"bad (\d+)", 1).cast("long").alias("first"), (COL("line") % 2 + 2).alias("parity")).crossJoin(F.broadcast(bad.agg(F.count("*").alias("bad"))))  # one row


@query("SELECT doc_id, true AS same, length(text)::INT AS last FROM documents")
def txt2_original_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Places in a text without its comments, mapped back, hold the same characters; comments stand before, within and behind."""
    from quillspark.functions import columns as C

    half = F.floor(F.length("text") / 2).cast("int")
    plain = F.translate("text", "%\\", "")
    rows = _docs(spark, d).select("doc_id", F.length("text").alias("n"), F.concat(F.lit("% one\n"), F.substr(plain, F.lit(1), half), F.lit(" % two\n"), F.substr(plain, half + 1, F.length("text")), F.lit("% three")).alias("raw"))
    rows = rows.withColumn("bare", C.strip_comments(COL("raw"))).withColumn("at", F.sequence(F.lit(0), F.length("bare") - 1, F.lit(37)))
    rows = rows.withColumn("to", D.original_places("raw", "at"))
    same = F.zip_with("at", "to", lambda a, b: F.substr("bare", a + 1, F.lit(1)) == F.substr("raw", b + 1, F.lit(1)))
    return rows.select("doc_id", F.forall(same, lambda x: x).alias("same"), COL("n").alias("last"))


_HALVES = r"h AS (SELECT doc_id, t, 'a ' || substr(t, 1, length(t) // 2) || '.' AS one, 'b ' || substr(t, length(t) // 2 + 1) || '.' AS two FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g') AS t FROM documents))"


def _halves(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, t, one, two): a text's letters and digits, and their halves with something around them."""
    half = F.floor(F.length("t") / 2).cast("int")
    rows = _docs(spark, d).select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " ").alias("t"))
    return rows.select("doc_id", "t", F.concat(F.lit("a "), F.substr("t", F.lit(1), half), F.lit(".")).alias("one"), F.concat(F.lit("b "), F.substr("t", half + 1, F.length("t")), F.lit(".")).alias("two"))


@query("WITH " + _HALVES + r", w AS (SELECT *, regexp_extract(t, '[A-Za-z]+') AS w FROM h) SELECT doc_id, one || '\includegraphics[width=3cm]{' || CASE WHEN w IN ('Der', 'The', 'La', 'El', 'fig') THEN w ELSE 'example-image' END || 'x} ' || two || ' \includegraphics{fig}' AS tex, CASE WHEN w IN ('Der', 'The', 'La', 'El', 'fig') THEN '' ELSE w || 'x' END AS rejected FROM w".replace("|| 'x} '", "|| '} '").replace("THEN w ELSE", "THEN w || 'x' ELSE"))
def txt35_graphics(spark: SparkSession, d: str) -> DataFrame:
    """Each text's first word as the name of a graphic between its halves, of which a few are known."""
    name = F.concat(F.regexp_extract("t", "[A-Za-z]+", 0), F.lit("x"))
    tex = F.concat("one", F.lit("\\includegraphics[width=3cm]{"), name, F.lit("} "), "two", F.lit(" \\includegraphics{fig}"))
    rows = _halves(spark, d).select("doc_id", D.graphics(tex, ["fig", "Derx", "Thex", "Lax", "Elx", "figx"]).alias("g"))
    return rows.select("doc_id", "g.tex", F.array_join("g.rejected", ",").alias("rejected"))


@query("SELECT doc_id, true AS restored, 3 AS n FROM documents")
def txt23_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Marks at the thirds of each text, outside words, formulas and commands; without them the text is as it was."""
    third = F.floor(F.length("text") / 3).cast("int")
    marked = D.anchors("text", F.array(F.lit(0), third, 2 * third), whole_words=True)
    bare = F.regexp_replace("marked", r"@@A\d+@@", "")
    inside = F.regexp_like("marked", F.lit(r"[A-Za-z0-9]@@A\d+@@[A-Za-z0-9]"))
    rows = _docs(spark, d).withColumn("marked", marked)
    return rows.select("doc_id", ((bare == COL("text")) & ~inside).alias("restored"), F.size(F.regexp_extract_all("marked", F.lit(r"@@A(\d+)@@"), 1)).alias("n"))


@query(
    "WITH p AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g') AS t FROM documents), c AS (SELECT doc_id, [substr(t, 1 + i * (length(t) // 10), length(t) // 10) || 'xy' FOR i IN range(10)] AS c FROM p) "
    # in the table, the braces or the listing: before them; in the formula: behind; in the comment: at the end of its line
    r"SELECT doc_id, '@@A0@@' || left(c[1], -1) || '@@A1@@' || right(c[1], 1) || '\begin{table}{' || c[2] || '}\end{table} ' || '@@A2@@' || c[3] || '$' || c[4] || '$' || '@@A3@@' || ' ' || '@@A4@@' || left(c[5], -1) || '@@A5@@' || right(c[5], 1) || '\textbf{a {' || c[6] || '} b}' || "
    r"'@@A6@@' || c[7] || '% {' || c[8] || '@@A7@@' || chr(10) || '@@A8@@' || left(c[9], -1) || '@@A9@@' || right(c[9], 1) || '\begin{verbatim}' || c[10] || '\end{verbatim}' AS marked FROM c"
)
def txt23_safe_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Ten pieces of each text in and between a table, a formula, nested braces, a comment and a listing: a mark at the start of each piece, or at the safe place that stands for it."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " ")
    size = F.floor(F.length("t") / 10).cast("int")
    piece = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.substr("t", 1 + i * size, size), F.lit("xy")))
    around = ["\\begin{table}{", "}\\end{table} ", "$", "$ ", "\\textbf{a {", "} b}", "% {", "\n", "\\begin{verbatim}", "\\end{verbatim}"]
    rows = _docs(spark, d).select("doc_id", plain.alias("t")).select("doc_id", piece.alias("c"))
    parts = [x for i, mark in enumerate(around) for x in (COL("c")[i], F.lit(mark))]
    ahead = [sum((F.length(COL("c")[k]) for k in range(i)), F.lit(sum(map(len, around[:i])))) for i in range(10)]
    rows = rows.select("doc_id", F.concat(*parts).alias("tex"), F.array(*ahead).alias("starts"))
    return rows.select("doc_id", D.anchors("tex", COL("starts")).alias("marked"))


@query(r"SELECT item_id, 'fig-001:figure:f' || item_id || ':One|eq-001:equation:a+' || item_id || ':One|eq-002:equation:c:Two' AS assets FROM benchmark")
def add6_assets(spark: SparkSession, d: str) -> DataFrame:
    """Figures, then equations of both kinds in one count, each with its section, between the halves of every item."""
    n = COL("item_id").cast("string")
    tex = F.concat("text", F.lit("\n\\section{One}\n\\begin{figure}\\includegraphics{f"), n, F.lit("}\\end{figure}\n\\begin{equation}a+"), n, F.lit("\\end{equation}\n"), F.lit("\\section{Two} \\[c\\]"), "text")
    rows = table(spark, d, "benchmark").select("item_id", D.assets(tex).alias("a"))
    return rows.select("item_id", F.array_join(F.transform("a", lambda a: F.concat_ws(":", a["id"], a["kind"], a["body"], a["section"])), "|").alias("assets"))


@query("SELECT user_id, count(*) AS n, md5(string_agg(event_type || props, '' ORDER BY event_id)) AS said FROM events GROUP BY 1")
def add7_sse_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as a server-sent stream, parsed again."""
    rows = table(spark, d, "events").select("user_id", "event_id", F.concat(F.lit("event: "), "event_type", F.lit("\ndata: "), "props", F.lit("\n\n")).alias("value"))
    streams = rows.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("s")).select("user_id", F.array_join(F.transform("s", lambda x: x["value"]), "").alias("stream"))
    parsed = streams.select("user_id", D.sse_events("stream").alias("e"))
    return parsed.select("user_id", F.size("e").cast("long").alias("n"), F.md5(F.array_join(F.transform("e", lambda e: F.concat(e["event"], e["data"])), "").cast("binary")).alias("said"))


@query("WITH " + _HALVES + r" SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN one || chr(10) || '\begin{center}' || chr(10) || '\includegraphics{f}' || chr(10) || '\end{center}' || chr(10) || '\par' || chr(10) || chr(10) || two ELSE one || chr(10) || '\begin{columns}' || chr(10) || '\includegraphics{f}' || chr(10) || '\end{columns}' || chr(10) || two END AS tex, true AS stable FROM h")
def add14_lone_figures(spark: SparkSession, d: str) -> DataFrame:
    """A figure on a line of its own between the halves of each text, with columns around it or not."""
    tex = F.when(COL("doc_id") % 2 == 0, F.concat("one", F.lit("\n\\includegraphics{f}\n"), "two")).otherwise(F.concat("one", F.lit("\n\\begin{columns}\n\\includegraphics{f}\n\\end{columns}\n"), "two"))
    rows = _halves(spark, d).select("doc_id", slides.figures_apart(tex).alias("tex"))
    return rows.select("doc_id", "tex", (slides.figures_apart("tex") == COL("tex")).alias("stable"))


@query("WITH " + _HALVES + r", w AS (SELECT doc_id, one, two, 2 + doc_id % 4 AS n, regexp_extract_all(t, '[A-Za-z]+') AS ws FROM h) SELECT doc_id, one || ' \begin{tabular}{l' || CASE WHEN doc_id % 2 = 0 THEN '|c' || repeat('l', n - 2) ELSE repeat('l', n - 1) END || '}' || array_to_string([coalesce(ws[i], 'y') FOR i IN range(1, n + 1)], ' & ') || ' \\ ' || two || chr(10) || '\end{tabular}' AS tex FROM w")
def txt30_tables(spark: SparkSession, d: str) -> DataFrame:
    """Each text's first words as the row of a table with unknown marks, too few columns and no end."""
    spec = F.concat(F.lit("l"), F.when(COL("doc_id") % 2 == 0, "|c").otherwise("Q"))
    words = F.regexp_extract_all("t", F.lit("[A-Za-z]+"), 0)
    cells = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), 1 + COL("doc_id") % 4), lambda i: F.coalesce(F.get(words, i.cast("int")), F.lit("y"))), " & ")
    tex = F.concat("one", F.lit(" \\begin{tabular}{"), spec, F.lit("}"), cells, F.lit(" \\\\ "), "two")
    return _halves(spark, d).select("doc_id", slides.tables_repaired(tex).alias("tex"))


@query("SELECT 1 AS versions, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM labels WHERE quality = 1")
def snk1_replace_table(spark: SparkSession, d: str) -> DataFrame:
    """A table replaced twice: readers get the last version whole."""
    path = state.new_path(spark, "table")
    labels = table(spark, d, "labels")
    ST.replace_table(labels, path)
    ST.replace_table(labels.filter("quality = 1"), path)
    return ST.current_table(spark, path).agg(F.lit(1).alias("versions"), F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT source, count(*) AS rows, count(*) AS told, 3 AS head FROM documents WHERE doc_id % 4 > 0 GROUP BY 1")
def snk1_two_tables(spark: SparkSession, d: str) -> DataFrame:
    """A table and its counts by source, changed together: first all, then some rows taken out; a transaction that fails and one that comes too late change nothing."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    store = Store(spark, state.new_path(spark, "store"))

    def put(tx: Transaction, rows: DataFrame) -> None:
        tx.replace("docs", rows)
        tx.replace("counts", rows.groupBy("source").agg(F.count("*").alias("n")))

    store.transact(lambda tx: put(tx, docs.limit(0)))
    store.transact(lambda tx: put(tx, docs))
    late = store.begin()
    put(late, late.read("docs").filter("doc_id % 4 = 0"))
    store.transact(lambda tx: put(tx, tx.read("docs").filter("doc_id % 4 > 0")))
    try:
        late.commit()
    except Conflict:
        late.abort()
    now = store.manifest()
    rows = store.at(now, "docs").groupBy("source").agg(F.count("*").alias("rows"))
    return rows.join(store.at(now, "counts").select(COL("source").alias("of"), COL("n").alias("told")), COL("source").eqNullSafe(COL("of"))).select("source", "rows", "told", F.lit(store.head()).alias("head"))


@query("SELECT event_type AS case_id, '| ' || event_type || ' | ' || count(*) || ' |' AS line FROM events GROUP BY 1")
def snk7_report(spark: SparkSession, d: str) -> DataFrame:
    """Results as JSON lines and a table in markdown, read back."""
    path = state.new_path(spark, "report")
    ST.report(table(spark, d, "events").groupBy(COL("event_type").alias("case_id")).agg(F.count("*").alias("n")), path)
    cases = ST.read_jsonl(spark, f"{path}/json", "case_id string, n long")
    lines = spark.read.text(f"{path}/markdown").withColumnRenamed("value", "line")
    return cases.join(lines, COL("line").contains(F.concat(F.lit("| "), COL("case_id"), F.lit(" |")))).select("case_id", "line")
