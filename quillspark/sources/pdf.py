"""PDF files as rows: spans of text, pages, headings with their places, and what a file says of itself; and files from lines.

Files come from Spark's binary reader, or as a column of bytes in any table, so any store will do and files are dealt over all tasks.
A file that can't be read is one row with an error, and the others are read on. Everything behind the spans is a plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import pdf as P
from quillspark.operators import layout as L

SPANS = "page int, pos int, line int, font string, size double, x0 double, y0 double, x1 double, y1 double, before string, text string, error string"
INFO = "pages int, title string, author string, created string, modified string, error string"
PAGE_BREAK = "\n\f\n"
#: Bytes of one batch of files handed to Python.
BATCH_BYTES = 4 << 20
_FAULTS = (P.PdfError, TypeError, ValueError, KeyError, IndexError, AttributeError, RecursionError, OverflowError)


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, content) of the files below path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def _each(rows: DataFrame, content: str, schema: str, of: Callable[[P.Document], Iterator[tuple]]) -> DataFrame:
    """The other columns of rows and, for each tuple that of() gives for a file, those of schema, the last being the error."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    at = rows.columns.index(content)
    out = T.StructType([f for f in rows.schema.fields if f.name != content] + T.StructType.fromDDL(schema).fields)
    width = len(T.StructType.fromDDL(schema).fields)

    def told(raw: bytes | None) -> Iterator[tuple]:
        if raw is None:
            yield (*[None] * (width - 1), "no file")
            return
        try:
            yield from ((*row, None) for row in of(P.Document(raw)))
        except _FAULTS as e:
            yield (*[None] * (width - 1), f"{type(e).__name__}: {e}" if not isinstance(e, P.PdfError) else str(e))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(out)
        for batch in batches:
            keys = [c for i, c in enumerate(batch.columns) if i != at]
            for i in range(batch.num_rows):
                found = told(batch.column(at)[i].as_py())
                while some := list(islice(found, 4096)):
                    own = [k.take(pa.array([i] * len(some))) for k in keys]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, kinds.field(len(own) + j).type) for j, c in enumerate(zip(*some, strict=True)))], names=kinds.names)

    return rows.mapInArrow(run, out)


def spans(rows: DataFrame, content: str = "content") -> DataFrame:
    """The other columns of rows with SPANS: page from 1, pos and line within the page, before: what stands between a span and the one before.

    A page without text is a row without pos, a file that can't be read one with an error; a file that breaks off within a page has both
    the pages before it and an error.
    """

    def of(doc: P.Document) -> Iterator[tuple]:
        for number, page in enumerate(doc.pages(), 1):
            line = None
            found = P.page_spans(doc, page)
            if not found:
                yield (number, *[None] * 10)
            for pos, s in enumerate(found):
                before = "" if line is None else "\n" if line != s.line else " " if s.gap else ""
                line = s.line
                yield (number, pos, s.line, s.font, s.size, *s.box, before, s.text)

    return _each(rows, content, SPANS, of)


def info(rows: DataFrame, content: str = "content") -> DataFrame:
    """The other columns of rows with INFO, a row a file."""

    def of(doc: P.Document) -> Iterator[tuple]:
        said = doc.info()
        yield (len(doc.pages()), *(said.get(k) for k in ("Title", "Author", "CreationDate", "ModDate")))

    return _each(rows, content, INFO, of)


def page_texts(found: DataFrame, key: str) -> DataFrame:
    """(key, page, text) of spans."""
    pieces = F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "before", "text"))))
    pages = found.filter("page is not null").groupBy(key, "page").agg(pieces.alias("p"))
    return pages.select(key, "page", F.array_join(F.transform("p", lambda x: F.concat(x["before"], x["text"])), "").alias("text"))


def _shaped(name: Column) -> Column:
    """Whether a line may be a heading: not too short or long, with a letter, no address, nothing that can't be printed."""
    return F.length(name).between(3, 120) & name.rlike(r"\p{L}") & ~name.contains("www.") & ~name.contains("http") & ~name.rlike(r"[\p{C}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]")


def sections(found: DataFrame, key: str) -> DataFrame:
    """(key, name, char_start): headings, and where they stand in the text of all pages joined by PAGE_BREAK."""
    lines = found.filter("pos is not null").groupBy(key, "page", "line").agg(F.sort_array(F.collect_list(F.struct("pos", "before", "text"))).alias("p"), F.max(F.when(F.trim("text") != "", F.col("size"))).alias("size"))
    name = F.trim(F.array_join(F.transform("p", lambda x: F.concat(F.when(x["before"] == " ", " ").otherwise(""), x["text"])), ""))
    rows = lines.select(F.col(key).alias("doc"), (F.col("page") - 1).alias("page"), F.col("line").alias("pos"), "size", name.alias("text"))
    heads = L.headings(rows.filter(F.col("size").isNotNull())).filter(_shaped(F.col("name")))
    texts = page_texts(found, key)
    before = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    starts = texts.select(F.col(key).alias("doc"), (F.col("page") - 1).alias("page"), (F.length("text") + len(PAGE_BREAK)).alias("n")).select("doc", "page", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias("start"))
    placed = heads.join(starts, ["doc", "page"]).join(texts.select(F.col(key).alias("doc"), (F.col("page") - 1).alias("page"), F.col("text").alias("whole")), ["doc", "page"])
    return placed.select(F.col("doc").alias(key), "name", (F.col("start") + F.expr("locate(name, whole)") - 1).alias("char_start"))


def pdf_bytes(pages: list[list[tuple[float, str]]], info: dict[str, str], packed: bool) -> bytes:
    """A PDF of pages of lines (font size, text), set from the top; packed: with object streams and a cross-reference stream."""
    ids = {c: i + 1 for i, c in enumerate(sorted({c for page in pages for _, text in page for c in text}))}
    some, codes = list(ids.items()), {c: f"{i:04X}" for c, i in ids.items()}
    blocks = "".join(f"{len(part)} beginbfchar\n" + "".join(f"<{i:04X}> <{c.encode('utf-16-be').hex().upper()}>\n" for c, i in part) + "endbfchar\n" for part in (some[k : k + 100] for k in range(0, len(some), 100)))
    cmap = f"/CIDInit /ProcSet findresource begin 12 dict begin begincmap\n1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n{blocks}endcmap end end".encode()
    squeezed = lambda data: (f"<< /Length {len(z := zlib.compress(data))} /Filter /FlateDecode >>", z)
    kids = " ".join(f"{6 + 2 * i} 0 R" for i in range(len(pages)))
    objects: list[tuple[str, bytes | None]] = [
        ("<< /Type /Catalog /Pages 2 0 R >>", None), (f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> >>", None),
        ("<< /Type /Font /Subtype /Type0 /BaseFont /Plain /Encoding /Identity-H /DescendantFonts [<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Plain /DW 500 >>] /ToUnicode 4 0 R >>", None), squeezed(cmap),
        ("<< " + " ".join(f"/{k} <FEFF{v.encode('utf-16-be').hex().upper()}>" for k, v in info.items()) + " >>", None),
    ]
    for i, page in enumerate(pages):
        y, body = 800.0, ["BT"]
        for size, text in page:
            body += [f"/F1 {size:g} Tf 1 0 0 1 40 {y:g} Tm", f"<{''.join(map(codes.__getitem__, text))}> Tj"]
            y -= 1.2 * size + 2
        objects += [(f"<< /Type /Page /Parent 2 0 R /Contents {7 + 2 * i} 0 R >>", None), squeezed("\n".join([*body, "ET"]).encode())]
    out, places, inner = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}, [n for n, (_, raw) in enumerate(objects, 1) if packed and raw is None]

    def put(number: int, head: str, raw: bytes | None) -> None:
        places[number] = len(out)
        out.extend(f"{number} 0 obj\n{head}\n".encode())
        if raw is not None:
            out.extend(b"stream\n" + raw + b"\nendstream\n")
        out.extend(b"endobj\n")

    for number, (head, raw) in enumerate(objects, 1):
        if not packed or raw is not None:
            put(number, head, raw)
    last = len(objects)
    if not packed:
        at = len(out)
        out += f"xref\n0 {last + 1}\n0000000000 65535 f \n".encode() + b"".join(b"%010d 00000 n \n" % places[n] for n in range(1, last + 1))
        out += f"trailer\n<< /Size {last + 1} /Root 1 0 R /Info 5 0 R >>\nstartxref\n{at}\n%%EOF\n".encode()
        return bytes(out)
    bodies = [objects[n - 1][0] + "\n" for n in inner]
    starts = list(accumulate((len(b.encode()) for b in bodies), initial=0))[:-1]
    index = " ".join(f"{n} {s}" for n, s in zip(inner, starts, strict=True)) + "\n"
    head, raw = squeezed((index + "".join(bodies)).encode())
    put(last + 1, head.replace("<<", f"<< /Type /ObjStm /N {len(inner)} /First {len(index)}", 1), raw)
    at = len(out)
    entry = lambda kind, a, b: bytes([kind]) + a.to_bytes(4) + b.to_bytes(2)
    order = {n: i for i, n in enumerate(inner)}
    rows = [entry(0, 0, 65535)] + [entry(2, last + 1, order[n]) if n in order else entry(1, places[n], 0) for n in range(1, last + 2)] + [entry(1, at, 0)]
    above, predicted = bytes(7), b""
    for row in rows:
        predicted += b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above, strict=True))
        above = row
    head, raw = squeezed(predicted)
    put(last + 2, head.replace("<<", f"<< /Type /XRef /W [1 4 2] /Size {last + 3} /Root 1 0 R /Info 5 0 R /DecodeParms << /Predictor 12 /Columns 7 >>", 1), raw)
    return bytes(out + f"startxref\n{at}\n%%EOF\n".encode())


def with_pdf(rows: DataFrame, pages: str, title: str, author: str, packed: str, name: str = "content") -> DataFrame:
    """rows with a PDF of each: pages are array<array<struct<size double, text string>>>."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    at = {c: rows.columns.index(c) for c in (pages, title, author, packed)}
    keep = [c for c in rows.columns if c not in at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, each = [], batch.column(at[pages])
            lines = each.flatten().flatten()
            rest = zip(lines.field("size").to_pylist(), lines.field("text").to_pylist(), strict=True)
            sizes, counts = each.value_lengths().to_pylist(), iter(each.flatten().value_lengths().to_pylist())
            for n, own, by, tight in zip(sizes, *(batch.column(at[c]).to_pylist() for c in (title, author, packed)), strict=True):
                made.append(pdf_bytes([list(islice(rest, next(counts) or 0)) for _ in range(n or 0)], {k: v for k, v in (("Title", own), ("Author", by)) if v}, bool(tight)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(made, pa.binary())], names=[*keep, name])

    return rows.mapInArrow(run, rows.select(*keep).schema.add(name, "binary"))
