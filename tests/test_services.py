"""Connectors against a server of this test with recorded answers."""

from __future__ import annotations

import io
import json
import tarfile
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from quillspark.sources import services as S

ENTRY = """<entry><id>http://x.org/abs/2401.{n:05d}v2</id><title> A
  title {n}</title><summary>said {n}</summary><published>2024-01-02T00:00:00Z</published>
  <author><name>A B</name></author><author><name>C  D</name></author><link title="pdf" href="http://x.org/pdf/{n}"/></entry>"""
BODY = bytes(range(256)) * 2000
TIMES: list[float] = []


class Handler(BaseHTTPRequestHandler):
    seen: list[str] = []
    failures: dict[str, int] = {}

    def log_message(self, *args):
        pass

    def say(self, code, body, **headers):
        self.send_response(code)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_POST(self):
        q = parse_qs(urlparse(self.path).query)
        body = self.rfile.read(int(self.headers["Content-Length"]))
        self.seen.append(self.path)
        if q["first"][0] == "9":
            self.say(400, b"")
            return
        pages = range(int(q["first"][0]), int(q["last"][0]) + 1)
        self.say(200, json.dumps({"blocks": [{"page": p, "block_type": t, "html": str(len(body)), "bbox": [0, 1, 2.5, 3]} for p in pages for t in "ab"]}).encode())

    def do_GET(self):
        where = urlparse(self.path)
        q = {k: v[0] for k, v in parse_qs(where.query).items()}
        self.seen.append(self.path)
        if self.failures.get(where.path, 0):
            self.failures[where.path] -= 1
            self.say(429, b"", Retry_After="0")
        elif where.path == "/atom":
            rows = range(int(q["start"]), min(7, int(q["start"]) + int(q["count"])))
            self.say(200, f'<feed xmlns="http://www.w3.org/2005/Atom">{"".join(ENTRY.format(n=n) for n in rows)}</feed>'.encode())
        elif where.path.startswith("/refs/"):
            at = int(q["offset"])
            data = [{"citedPaper": {"title": f"t{i}", "externalIds": {"ArXiv": str(i)}} if i % 3 else None} for i in range(at, min(10, at + 4))]
            self.say(404 if where.path.endswith("none") else 200, json.dumps({"data": data} | ({"next": at + 4} if at + 4 < 10 else {})).encode())
        elif where.path.startswith("/doi/"):
            self.say(404 if "none" in where.path else 200, json.dumps({"best_oa_location": {"url_for_pdf": "b"}, "oa_locations": [{"url_for_pdf": "a"}, {"url_for_pdf": None}, {"url_for_pdf": "b"}]}).encode())
        elif where.path.startswith("/file"):
            have = int((self.headers.get("Range") or "bytes=0-")[6:-1])
            n = sum(p == self.path for p in self.seen)
            body = BODY if "changed" not in where.path or n == 1 else BODY[::-1] + b"new"
            tag = None if "plain" in where.path else f'"{len(body)}"'
            on = have if have and (tag is None or self.headers.get("If-Range") == tag) else 0
            self.send_response(206 if on else 200)
            self.send_header("Content-Length", str(len(body) - on))
            if tag:
                self.send_header("ETag", tag)
            if on:
                self.send_header("Content-Range", f"bytes {on}-{len(body) - 1}/{len(body)}")
            self.end_headers()
            self.wfile.write(body[on:] if n > 1 else body[:100_000])  # the first transfer breaks
        elif where.path == "/paced":
            TIMES.append(time.monotonic())
            self.say(200, json.dumps({"n": q["v"]}).encode())
        else:
            self.say(404, b"")


@pytest.fixture(scope="module")
def base():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_atom_search_in_pages(spark, base):
    spark.dataSource.register(S.AtomSearch)
    Handler.failures["/atom"] = 1
    read = spark.read.format("atom_search").option("url", base + "/atom?q={query}&start={start}&count={count}").option("queries", "a b\nc").option("most", "7").option("count", "3").option("pause", "0")
    rows = read.load().collect()
    assert len(rows) == 14 and {r.id for r in rows} == {f"2401.{n:05d}" for n in range(7)}
    assert (rows[0].title, rows[0].authors, rows[0].year, rows[0].pdf_url) == ("A title 0", ["A B", "C D"], 2024, "http://x.org/pdf/0")
    assert read.option("most", "2").load().count() == 4


def test_paged_json_follows_the_offsets(spark, base):
    spark.dataSource.register(S.PagedJson)
    read = spark.read.format("paged_json").option("url", base + "/refs/{value}?offset={offset}").option("values", "p\nnone").option("rows", "data").option("item", "citedPaper").option("next", "next").option("pause", "0")
    rows = read.option("fields", json.dumps({"title": "title", "number": "externalIds.ArXiv", "gone": "a.b"})).load().collect()
    assert [(r.value, r.title, r.number, r.gone) for r in rows] == [("p", f"t{i}", str(i), None) for i in range(10) if i % 3]


def test_open_access_links(spark, base):
    spark.dataSource.register(S.OpenAccess)
    rows = spark.read.format("open_access").option("url", base + "/doi/{doi}").option("dois", "10.1/x\n10.1/none").option("pause", "0").load().collect()
    assert [tuple(r) for r in rows] == [("10.1/x", 0, "b"), ("10.1/x", 1, "a")]


def test_pauses_waits_and_errors_that_stay(base):
    slept, now = [], [0.0]
    client = S.Client(pause=1.1, waits=(1.0, 3.0), sleep=lambda s: (slept.append(round(s, 3)), now.__setitem__(0, now[0] + s)), clock=lambda: now[0])
    client.get(base + "/doi/1")
    client.get(base + "/doi/2")
    assert slept == [1.1]
    with pytest.raises(S.HTTPError):
        client.get(base + "/nothing")
    Handler.failures["/doi/3"] = 9
    before = len(slept)
    with pytest.raises(S.HTTPError):
        client.get(base + "/doi/3")
    assert len(slept) > before and S.retry_after("7") == 7 and S.retry_after("x") is None and S.retry_after("Thu, 01 Jan 1970 00:01:00 GMT", lambda: 10) == 50
    Handler.failures.clear()


def test_a_pace_holds_over_all_lanes(spark, base):
    spark.dataSource.register(S.PagedJson)
    values = "\n".join(map(str, range(30)))
    for lanes in (1, 8):
        TIMES.clear()
        read = spark.read.format("paged_json").option("url", base + "/paced?v={value}").option("values", values).option("fields", '{"n": "n"}').option("pause", "0.1").option("lanes", str(lanes)).load()
        assert read.rdd.getNumPartitions() == lanes and sorted(r.n for r in read.collect()) == sorted(map(str, range(30)))
        began = min(TIMES)
        assert len(TIMES) == 30 and max(sum(began + s <= t < began + s + 1 for t in TIMES) for s in range(4)) <= 10 + lanes
        assert max(TIMES) - began >= 2.0


def test_a_service_is_obeyed(base):
    slept = []
    client = S.Client(waits=(1.0,), sleep=slept.append)
    Handler.failures["/doi/slow"] = 1
    plain = Handler.say
    try:
        Handler.say = lambda self, code, body, **h: plain(self, code, body, **({"Retry_After": "600"} if code == 429 else h))
        client.get(base + "/doi/slow")
    finally:
        Handler.say = plain
    assert slept == [600.0]


def test_layout_batches(spark, base):
    from quillspark.sources import pdf as P

    data = [(name, P.pdf_bytes([[(10.0, f"page {i}")] for i in range(n)], {}, n % 2 == 0)) for name, n in (("a", 12), ("b", 3))] + [("bad", b"no pdf")]
    files = spark.createDataFrame(data, "name string, content binary")
    Handler.seen.clear()
    rows = S.layout_service(files, "name", base + "/layout?first={first}&last={last}", batch=5, lanes=2).collect()
    assert [(r.page, r.pos, r.block_type) for r in sorted(rows, key=lambda r: r.pos) if r.name == "a"] == [(i // 2, i, "ab"[i % 2]) for i in range(24)]
    assert len(Handler.seen) == 4 and {r.html for r in rows if r.name == "b"} == {str(len(data[1][1]))} and rows[0].bbox == [0, 1, 2.5, 3]
    Handler.seen.clear()
    rows = S.layout_service(files, "name", base + "/layout?first={first}&last={last}", batch=5, first=4, last=5).collect()
    assert sorted({r.page for r in rows}) == [4, 5] and sorted(p.split("?")[1] for p in Handler.seen) == ["first=4&last=4", "first=5&last=5"]
    rows = S.layout_service(files, "name", base + "/layout?first={first}&last={last}", batch=3).collect()
    assert [(r.name, r.page) for r in rows if r.error] == [("a", None)] and sum(r.error is None for r in rows) == 2 * 9 + 2 * 3


def test_downloads_and_archives(spark, base, tmp_path):
    Handler.seen.clear()
    wanted = spark.createDataFrame([("a.bin", base + "/file"), ("b.bin", base + "/missing"), ("c.bin", base + "/file/changed"), ("d.bin", base + "/file/plain")], "name string, url string")
    out = S.downloads(wanted, tmp_path.as_uri(), lanes=3).collect()
    assert {r.name: (r.bytes, r.error is None) for r in out} == {"a.bin": (len(BODY), True), "b.bin": (None, False), "c.bin": (len(BODY) + 3, True), "d.bin": (len(BODY), True)}
    assert [(tmp_path / f"{n}.bin").read_bytes() for n in "acd"] == [BODY, BODY[::-1] + b"new", BODY] and not list(tmp_path.glob("*.part*"))
    with pytest.raises(ValueError, match="file:///"):
        S.downloads(wanted, "hdfs://x/y")
    with tarfile.open(tmp_path / "s.tar", "w") as t:
        info = tarfile.TarInfo("x/main.tex")
        info.size = 3
        t.addfile(info, io.BytesIO(b"tex"))
    assert S.unpack(str(tmp_path / "s.tar"), str(tmp_path / "s")) == ["x/main.tex"]
    (tmp_path / "one").write_bytes(b"only")
    assert S.unpack(str(tmp_path / "one"), str(tmp_path / "o")) == ["main.tex"] and (tmp_path / "o" / "main.tex").read_bytes() == b"only"
