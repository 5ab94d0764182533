"""The PDF reader: kinds of files, fonts and damage; rows from files on disk."""

from __future__ import annotations

import base64
import zlib

import pytest

from quillspark.functions import pdf as P
from quillspark.sources import documents as SD
from quillspark.sources import pdf as SP


def classic(objects, trailer="/Root 1 0 R", before=b"%PDF-1.4\n", previous=None):
    """A file of objects {number: body}; previous: the place of the references that these go on from."""
    out, places = bytearray(before), {}
    for n, body in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    at = len(out)
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, p) for n, p in places.items())
    prev = f"/Prev {previous}" if previous is not None else ""
    out += f"trailer\n<< /Size 99 {trailer} {prev} >>\nstartxref\n{at}\n%%EOF\n".encode()
    return bytes(out), at


def stream(data, more=""):
    return f"<< /Length {len(data)} {more} >>\nstream\n".encode() + data + b"\nendstream"


def one_page(content, font=b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /FirstChar 32 /Widths [250] >>", more=None, contents=None):
    base = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F 5 0 R >> /XObject << /X 6 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", 4: contents or stream(content), 5: font,
    }
    return classic(base | (more or {}))


def lines(data):
    doc = P.Document(data)
    out = []
    for page in doc.pages():
        text = ""
        last = None
        for s in P.page_spans(doc, page):
            text += ("" if last is None else "\n" if s.line != last else " " if s.gap else "") + s.text
            last = s.line
        out.append(text)
    return out


def test_operators_of_text():
    content = rb"""BT /F 10 Tf 14 TL 1 0 0 1 50 700 Tm (one \(nested (pair)\) \101) Tj T* [(ker) -40 (ned) -900 (apart)] TJ (next) ' 2 0 (last) " 0 -20 Td <48 69> Tj ET q 2 0 0 2 0 0 cm BT /F 5 Tf 10 20 Td (scaled) Tj ET Q"""
    doc = P.Document(one_page(content)[0])
    spans = P.page_spans(doc, doc.pages()[0])
    assert [s.text for s in spans] == ["one (nested (pair)) A", "kerned apart", "next", "last", "Hi", "scaled"]
    assert [s.line for s in spans] == [0, 1, 2, 3, 4, 5] and spans[-1].size == 10.0 and spans[-1].box[:2] == (20, 40)
    assert [s.box[1] for s in spans[:4]] == [700, 686, 672, 658]


def test_words_of_one_line_apart():
    content = b"BT /F 10 Tf 1 0 0 1 50 700 Tm (ab) Tj 1 0 0 1 51 700 Tm ET BT /F 10 Tf 1 0 0 1 120 700.5 Tm (cd) Tj 1 0 0 1 50 600 Tm (ef) Tj ET"
    assert lines(one_page(content)[0]) == ["ab cd\nef"]


def test_encodings_and_glyph_names():
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /X /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [65 /adieresis /germandbls /fi 200 /uni20AC /Ccedilla /nothing.alt] >> >>"
    assert lines(one_page(b"BT /F 9 Tf (ABC\xc8\xc9\xca\xe9) Tj ET", font)[0]) == ["äßfi€Ç�é"]
    assert P.glyph("u1F600") == "😀" and P.glyph("eacute") == "é" and P.glyph("zcaron") == "ž"


def test_maps_with_ranges_and_mixed_lengths():
    cmap = b"2 begincodespacerange <00> <7F> <8000> <FFFF> endcodespacerange 2 beginbfrange <8001> <8003> <0410> <8010> <8011> [<00660069> <D83DDE00>] endbfrange 1 beginbfchar <41> <0061> endbfchar"
    font = b"<< /Type /Font /Subtype /Type0 /BaseFont /X /DescendantFonts [<< /DW 600 /W [1 [500 500] 7 9 300] >>] /ToUnicode 7 0 R >>"
    assert lines(one_page(b"BT /F 9 Tf <41 8001 8003 8010 8011 41> Tj ET", font, {7: stream(cmap)})[0]) == ["aАВfi😀a"]


def test_forms_images_and_filters():
    form = {6: stream(b"BT /F 8 Tf 5 5 Td (inside) Tj ET", "/Type /XObject /Subtype /Form /Matrix [1 0 0 1 0 300]")}
    content = b"BT /F 9 Tf 0 400 Td (out) Tj ET BI /W 2 /H 2 ID \x00(\xff EI\x01 EI /X Do"
    for raw, name in ((zlib.compress(content), "/FlateDecode"), (base64.a85encode(content) + b"~>", "/ASCII85Decode"), (content.hex().encode() + b">", "/ASCIIHexDecode"), (base64.a85encode(zlib.compress(content)) + b"~>", "[/A85 /Fl]")):
        assert lines(one_page(b"", more=form, contents=stream(raw, f"/Filter {name}"))[0]) == ["out\ninside"]


def test_the_last_update_counts():
    data, at = one_page(b"BT /F 9 Tf (old) Tj ET", more={8: b"<< /Title (first) >>"})
    data, at = classic({4: stream(b"BT /F 9 Tf (new) Tj ET"), 8: b"<< /Title <FEFF00DC> >>"}, "/Root 1 0 R /Info 8 0 R", data, at)
    assert lines(data) == ["new"] and P.Document(data).info() == {"Title": "Ü"}
    cut = data[: data.rindex(b"xref\n8 1") if b"xref\n8 1" in data else data.rindex(b"trailer")]
    assert lines(cut + b"startxref\n5\n%%EOF") == ["new"]  # the references are lost, the objects aren't


def test_both_kinds_are_read_even_if_damaged():
    pages = [[(18.0, "Ein Titel"), (10.0, "größer 😀 漢字")], [], [(10.0, "zwei")]]
    for packed in (False, True):
        data = SP.pdf_bytes(pages, {"Title": "Ein Titel"}, packed)
        assert lines(data) == ["Ein Titel\ngrößer 😀 漢字", "", "zwei"]
        assert lines(b"junk\n" + data) == lines(data[: data.rindex(b"startxref")]) == lines(data)


def test_circles_and_nonsense_end():
    looped = classic({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [2 0 R 3 0 R] >>", 3: b"<< /Type /Page /Contents 4 0 R >>", 4: b"4 0 R"})[0]
    with pytest.raises(P.PdfError):
        lines(looped)
    for raw in (b"", b"%PDF-1.4", b"%PDF-1.7\n1 0 obj\n<< /Type", b"%PDF-1.7\n" + b"[" * 5000):
        with pytest.raises((P.PdfError, RecursionError, KeyError, TypeError)):
            lines(raw)
    with pytest.raises(P.PdfError, match="encrypted"):
        P.Document(classic({1: b"<< /Pages 2 0 R >>", 2: b"<< /Kids [] >>"}, "/Root 1 0 R /Encrypt 9 0 R")[0])


def test_rows_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.pdf").write_bytes(SP.pdf_bytes([[(18.0, "Title"), (12.0, "Intro"), (10.0, "body " * 9)], [(12.0, "Results of it"), (10.0, "more " * 9)]], {"Title": "Some paper", "CreationDate": "D:20190101"}, True))
    (tmp_path / "in" / "flat.pdf").write_bytes(SP.pdf_bytes([[(10.0, "only one size here"), (10.0, "and here")]], {}, False))
    (tmp_path / "bad.pdf").write_bytes(b"not one")
    (tmp_path / "half.pdf").write_bytes(one_page(b"BT /F 9 Tf (x) Tj ET", contents=stream(b"zz", "/Filter /FlateDecode"))[0])
    (tmp_path / "other.txt").write_bytes(b"%PDF-1.4")
    rows = SP.files(spark, tmp_path.as_uri()).selectExpr("regexp_extract(path, '([^/]*)$') AS name", "content")
    spans = SP.spans(rows).cache()
    assert {r.name: r.error for r in spans.filter("error is not null").collect()} == {"bad.pdf": "not a PDF", "half.pdf": "a stream that can't be read: Error -3 while decompressing data: incorrect header check"}
    texts = {r.name: r.text for r in SD.pdf_text(SP.page_texts(spans, "name"), "name").collect()}
    assert texts["a.pdf"] == "Title\nIntro\n" + "body " * 9 + "\n\f\nResults of it\n" + "more " * 9
    found = sorted(map(tuple, SP.sections(spans, "name").collect()))
    assert [(n, h, texts[n][at : at + len(h)]) for n, h, at in found] == [("a.pdf", "Intro", "Intro"), ("a.pdf", "Results of it", "Results of it")]
    said = {r.name: (r.pages, r.title, r.created, r.error is None) for r in SP.info(rows).collect()}
    assert said["a.pdf"] == (2, "Some paper", "D:20190101", True) and said["flat.pdf"] == (1, None, None, True) and said["bad.pdf"][3] is False
    assert SP.spans(spark.createDataFrame([(1, None)], "id long, content binary")).collect()[0].error == "no file"
    assert SP.spans(spark.createDataFrame([], "id long, content binary")).count() == 0


def test_a_font_is_read_once_for_all_pages(monkeypatch):
    made = []
    monkeypatch.setattr(P, "Font", lambda doc, fields, font=P.Font: made.append(1) or font(doc, fields))
    pages = [[(10.0, f"page {i} \u00e4\u4e2d")] for i in range(12)]
    for packed in (False, True):
        doc = P.Document(SP.pdf_bytes(pages, {}, packed))
        assert ["".join(s.text for s in P.page_spans(doc, p)) for p in doc.pages()] == [page[0][1] for page in pages]
    assert len(made) == 2


def test_places_of_headings_over_many_pages(spark):
    text = "some plain words of a page "
    pages = [[{"size": 12.0, "text": f"Heading {i}"}, {"size": 10.0, "text": text * (1 + i % 3)}] for i in range(300)]
    rows = spark.createDataFrame([(1, [[{"size": 18.0, "text": "Title"}], *pages], None, None, True)], "id long, pages array<array<struct<size:double,text:string>>>, title string, author string, packed boolean")
    found = SP.spans(SP.with_pdf(rows, "pages", "title", "author", "packed")).cache()
    whole = SP.PAGE_BREAK.join(r.text for r in SP.page_texts(found, "id").orderBy("page").collect())
    heads = SP.sections(found, "id")
    assert sorted((r.char_start, r.name) for r in heads.collect()) == [(whole.index(f"Heading {i}\n"), f"Heading {i}") for i in range(300)]
    assert "aggregate(slice(" not in heads._jdf.queryExecution().analyzed().toString()  # no sum over the pages before for each page
