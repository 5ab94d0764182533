"""Connectors to services of papers as Spark data sources: Atom feeds, JSON APIs in pages, open-access links, downloads.

Searches, papers and DOIs are dealt to lanes, a partition each, of which there is one unless the option lanes asks for more: a
service's pace holds over all tasks, since a lane's requests are lanes times the pause apart and lanes begin one after the
other. Every request has a timeout and is tried again after the waits for answers that may pass (408, 425, 429, 5xx, broken
connections), or after as long as the service asks for (Retry-After). Nothing is kept between pages but the place of the next one.
"""

from __future__ import annotations

import json
import math
import os
import tarfile
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime
from http.client import HTTPException
from typing import Any
from urllib.error import HTTPError, URLError
from urllib.parse import quote
from urllib.request import Request, urlopen
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.sources import pdf as PDF
from quillspark.state import materialise

COL = F.col

AGENT = "quillspark"
PASSING = (408, 425, 429, 500, 502, 503, 504)
ATOM = "{http://www.w3.org/2005/Atom}"


def retry_after(value: str | None, now: Callable[[], float] = time.time) -> float | None:
    """Seconds that a Retry-After header asks for, given in seconds or as a date; null if it says nothing."""
    if not value:
        return None
    try:
        return max(0.0, float(value))
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - now())
    except (TypeError, ValueError):
        return None


@dataclass
class Client:
    """Requests with a timeout, pauses and retries."""

    pause: float = 0.0
    timeout: float = 30.0
    waits: tuple[float, ...] = (1.0, 3.0, 9.0)
    longest: float = math.inf
    headers: Mapping[str, str] = field(default_factory=dict)
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    last: float | None = None

    @classmethod
    def of_lane(cls, lane: int, lanes: int, pause: float, **more: Any) -> Client:  # noqa: ANN401
        """The client of one of several lanes, which together keep the pause."""
        client = cls(pause * lanes, **more)
        client.last = client.clock() - pause * (lanes - lane)
        return client

    def open(self, url: str, body: bytes | None = None, **headers: str) -> Any:  # noqa: ANN401
        for wait in [*self.waits, None]:
            if self.last is not None and (left := self.last + self.pause - self.clock()) > 0:
                self.sleep(left)
            self.last = self.clock()
            asked = None
            try:
                return urlopen(Request(url, body, {"User-Agent": AGENT, **self.headers, **headers}), timeout=self.timeout)  # noqa: S310
            except HTTPError as e:
                if e.code not in PASSING or wait is None:
                    raise
                asked = retry_after(e.headers.get("Retry-After"))
            except (URLError, HTTPException, ConnectionError, TimeoutError):
                if wait is None:
                    raise
            self.sleep(min(wait if asked is None else asked, self.longest))
        raise AssertionError

    def get(self, url: str) -> bytes:
        with self.open(url) as answer:
            return answer.read()


def plain_id(url: str) -> str:
    """A preprint's number without its address and version."""
    name = url.rsplit("/abs/", 1)[-1]
    head, mark, version = name.rpartition("v")
    return head if mark and head and version.isdigit() else name


def atom_rows(feed: bytes) -> list[dict[str, Any]]:
    """The entries of an Atom feed; entries that report an error are left out."""
    squeeze = lambda e, name: " ".join((e.findtext(ATOM + name) or "").split())
    out = []
    for e in ElementTree.fromstring(feed).iter(ATOM + "entry"):  # noqa: S314
        address = squeeze(e, "id")
        if "/api/errors" in address:
            continue
        year = squeeze(e, "published")[:4]
        pdf = next((x.get("href") for x in e.iter(ATOM + "link") if x.get("title") == "pdf" or x.get("type") == "application/pdf"), None)
        authors = [n for a in e.iter(ATOM + "author") if (n := " ".join((a.findtext(ATOM + "name") or "").split()))]
        out.append({"id": plain_id(address), "title": squeeze(e, "title"), "abstract": squeeze(e, "summary"), "authors": authors, "year": int(year) if year.isdigit() else None, "pdf_url": pdf})
    return out


def at(item: Any, path: str) -> Any:  # noqa: ANN401
    """The value at a dotted path of objects, null where it leads nowhere."""
    for name in path.split(".") if path else ():
        item = item.get(name) if isinstance(item, dict) else None
    return item


class _Lane(InputPartition):
    def __init__(self, number: int, values: list[str]) -> None:
        self.number, self.values = number, values


class _Reader(DataSourceReader):
    """Rows of each of the option values, which a source's rows() gives one after the other, dealt to as many lanes as the option asks for."""

    def __init__(self, values: list[str], names: list[str], rows: Callable[[Client, str], Iterator[dict[str, Any]]], pause: float, lanes: str | int = 1) -> None:
        self.values, self.names, self.rows, self.pause = values, names, rows, pause
        self.lanes = max(1, min(int(lanes), len(values)))

    def partitions(self) -> list[InputPartition]:
        return [_Lane(i, self.values[i :: self.lanes]) for i in range(self.lanes)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        client = Client.of_lane(partition.number, self.lanes, self.pause)
        for value in partition.values:
            for row in self.rows(client, value):
                yield tuple(row.get(n) for n in self.names)


class AtomSearch(DataSource):
    """Searches in a service that answers with Atom feeds.

    Options: url with {query}, {start} and {count}; queries, one a line; most (results a query), count (a page), pause, lanes.
    """

    @classmethod
    def name(cls) -> str:
        return "atom_search"

    def schema(self) -> str:
        return "id string, title string, abstract string, authors array<string>, year int, pdf_url string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        url, most, count = self.options["url"], int(self.options.get("most", 10)), int(self.options.get("count", 50))

        def rows(client: Client, query: str) -> Iterator[dict[str, Any]]:
            given = 0
            while given < most:
                page = atom_rows(client.get(url.format(query=quote(query), start=given, count=min(count, most - given))))
                yield from page[: most - given]
                given += len(page)
                if len(page) < min(count, most):
                    return

        return _Reader(self.options["queries"].split("\n"), schema.names, rows, float(self.options.get("pause", 3.0)), self.options.get("lanes", 1))


class PagedJson(DataSource):
    """Rows of a JSON API in pages: searches, citations, references, metadata.

    Options: url with {value} and {offset}; values, one a line; rows (path to the list; empty: the answer is the row), item (path in
    each of them), next (path to the next offset), fields (JSON: column to path), most (rows a value), pause, lanes.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return ", ".join(f"{n} string" for n in ["value", *json.loads(self.options["fields"])])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        o = dict(self.options)
        fields, most = json.loads(o["fields"]), int(o.get("most", 100))
        text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)

        def rows(client: Client, value: str) -> Iterator[dict[str, Any]]:
            offset, given = 0, 0
            while offset is not None and given < most:
                try:
                    answer = json.loads(client.get(o["url"].format(value=quote(value, safe=":/"), offset=offset)))
                except HTTPError as e:
                    if e.code == 404:  # the service doesn't know it
                        return
                    raise
                for entry in (at(answer, o["rows"]) or []) if o.get("rows") else [answer]:
                    item = at(entry, o.get("item", ""))
                    if item is not None and given < most:
                        given += 1
                        yield {"value": value} | {n: text(at(item, path)) for n, path in fields.items()}
                offset = at(answer, o["next"]) if o.get("next") else None

        return _Reader(o["values"].split("\n"), schema.names, rows, float(o.get("pause", 1.1)), o.get("lanes", 1))


class OpenAccess(DataSource):
    """Addresses of free PDFs by DOI, the best first. Options: url with {doi}; dois, one a line; pause, lanes."""

    @classmethod
    def name(cls) -> str:
        return "open_access"

    def schema(self) -> str:
        return "doi string, rank int, pdf_url string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        url = self.options["url"]

        def rows(client: Client, doi: str) -> Iterator[dict[str, Any]]:
            try:
                answer = json.loads(client.get(url.format(doi=quote(doi, safe="/"))))
            except HTTPError as e:
                if e.code in (404, 422):
                    return
                raise
            places = [at(answer, "best_oa_location"), *(at(answer, "oa_locations") or [])]
            for rank, link in enumerate(dict.fromkeys(u for p in places if (u := at(p, "url_for_pdf")))):
                yield {"doi": doi, "rank": rank, "pdf_url": link}

        return _Reader(self.options["dois"].split("\n"), schema.names, rows, float(self.options.get("pause", 0.1)), self.options.get("lanes", 1))


LAYOUT = "page int, pos long, block_id string, block_type string, html string, bbox array<double>, caption string"


def layout_service(files: DataFrame, key: str, url: str, batch: int = 5, first: int = 0, last: int | None = None, lanes: int = 1, pause: float = 0.0, content: str = "content") -> DataFrame:
    """(key, LAYOUT, error): blocks of PDF files (key, content) from a layout service, which is asked for batch pages at a time.

    url has {first} and {last}, pages from 0. Only batches with pages from first to last are asked for, of those pages alone. Files are
    read where they are, for their numbers of pages; (file, batch) rows are then dealt to lanes, which keep the service's pace. pos
    numbers a file's blocks over its batches; a batch that fails is one row with an error.
    """
    counted = PDF.info(files.select(key, content)).select(COL(key).alias("__of"), F.coalesce("pages", F.lit(0)).alias("__pages"))
    end = F.least(COL("__pages") - 1, F.lit(last)) if last is not None else COL("__pages") - 1
    starts = F.sequence(F.lit(first - first % batch), end, F.lit(batch))
    asked = counted.filter(end >= first).select("__of", F.explode(starts).alias("__at"), end.alias("__end"))
    asked = asked.select("__of", F.greatest("__at", F.lit(first)).alias("__first"), F.least(COL("__at") + batch - 1, "__end").alias("__last"))
    rows = files.select(key, content).join(asked, COL(key) == COL("__of")).select(key, "__first", "__last", content)
    rows = rows.withColumn("__lane", F.pmod(F.xxhash64(key, "__first"), F.lit(lanes)).cast("int")).repartition(lanes, "__lane").sortWithinPartitions("__lane", key, "__first")
    names = [x.split()[0] for x in LAYOUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clients: dict[int, Client] = {}
        for part in batches:
            for i in range(part.num_rows):
                of, begin, stop, raw, lane = (c[i].as_py() for c in part.columns)
                client = clients.setdefault(lane, Client.of_lane(lane, lanes, pause))
                error, found = None, []
                try:
                    with client.open(url.format(first=begin, last=stop), raw, **{"Content-Type": "application/pdf"}) as answer:
                        said = json.loads(answer.read())
                    found = said["blocks"] if isinstance(said, dict) else said
                except (OSError, HTTPException, ValueError, KeyError) as e:
                    error = str(e)
                out = [{key: of, "__first": begin, "pos": n, "error": None} | {c: b.get(c) for c in names if c != "pos"} for n, b in enumerate(found)] or [{key: of, "__first": begin, "error": error}] * (error is not None)
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)

    schema = T.StructType([files.schema[key], T.StructField("__first", T.IntegerType()), *T.StructType.fromDDL(LAYOUT).fields, T.StructField("error", T.StringType())])
    kinds = to_arrow_schema(schema)
    blocks = materialise(rows.mapInArrow(run, schema), "blocks")  # a batch is asked for once
    sizes = blocks.groupBy(key, "__first").agg(F.count("pos").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(key).orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(COL(key).alias("__of"), COL("__first").alias("__b"), before.alias("__before"))
    joined = blocks.join(starts, (COL(key) == COL("__of")) & (COL("__first") == COL("__b")))
    return joined.withColumn("pos", COL("pos") + COL("__before")).select(key, *names, "error")


def _seen(path: str) -> dict[str, Any]:
    try:
        with open(path) as f:
            return json.load(f)
    except (OSError, ValueError):
        return {}


def download(url: str, path: str, client: Client, tries: int = 4) -> int:
    """Fetch url into path and return its bytes; path appears once it is whole.

    A broken transfer goes on where it ended if the file is still the one that was begun: by its tag or date (If-Range), else by
    its whole size. If it is another one, or nobody can tell, it begins anew.
    """
    part, note = f"{path}.part", f"{path}.part.json"
    for left in range(tries - 1, -1, -1):
        have, known = os.path.getsize(part) if os.path.exists(part) else 0, _seen(note)
        mark, size = known.get("mark"), known.get("size")
        have = have if mark or size else 0
        try:
            with client.open(url, **({"Range": f"bytes={have}-"} | ({"If-Range": mark} if mark else {}) if have else {})) as answer:
                said = answer.headers
                on = have if have and answer.status == 206 else 0
                total = int((said.get("Content-Range") or "*/-1").rpartition("/")[2].replace("*", "-1")) if on else int(said.get("Content-Length", -1))
                if on and not mark and total != size:
                    os.remove(part)
                    raise ConnectionError(f"{url} has changed")
                if not on:
                    strong = said.get("ETag") if not (said.get("ETag") or "W/").startswith("W/") else None
                    with open(note, "w") as f:
                        json.dump({"mark": strong or said.get("Last-Modified"), "size": total if total >= 0 else None}, f)
                with open(part, "ab" if on else "wb") as out:
                    while piece := answer.read(1 << 16):
                        out.write(piece)
            whole = total if total >= 0 else size if on else None
            if whole is not None and os.path.getsize(part) < whole:
                raise ConnectionError(f"{url} ended early")
            break
        except HTTPError as e:
            if e.code != 416 or not have:
                raise
            if have == size:  # all of it is there
                break
            os.remove(part)
            if not left:
                raise
        except (HTTPException, ConnectionError, TimeoutError):
            if not left:
                raise
    os.replace(part, path)
    if os.path.exists(note):
        os.remove(note)
    return os.path.getsize(path)


def unpack(path: str, folder: str) -> list[str]:
    """The files of a source archive, unpacked into folder; one that isn't a tar file is kept as main.tex."""
    os.makedirs(folder, exist_ok=True)
    if not tarfile.is_tarfile(path):
        import gzip

        with open(path, "rb") as f:
            raw = f.read()
        with open(os.path.join(folder, "main.tex"), "wb") as out:
            out.write(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
        return ["main.tex"]
    with tarfile.open(path) as archive:
        archive.extractall(folder, filter="data")
        return sorted(m.name for m in archive.getmembers() if m.isfile())


def downloads(wanted: DataFrame, folder: str, pause: float = 0.0, lanes: int = 1) -> DataFrame:
    """(name, bytes, error) of the files wanted (name, url), fetched into folder in lanes.

    The files are written by the workers: on a cluster folder has to be a mount that all of them share, named as file:///...
    """
    if "://" not in folder and not wanted.sparkSession.sparkContext.master.startswith("local["):
        raise ValueError("on a cluster, name a folder that all workers share as file:///...")
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError("downloads go on where they ended, so they need a file system: file:///...")
    folder = folder.removeprefix("file://")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clients: dict[int, Client] = {}
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                try:
                    out.append((r.name, download(r.url, os.path.join(folder, r.name), clients.setdefault(r.lane, Client.of_lane(r.lane, lanes, pause))), None))
                except (OSError, HTTPException) as e:
                    out.append((r.name, None, str(e)))
            yield pd.DataFrame(out, columns=["name", "bytes", "error"]).astype({"bytes": "Int64"})

    lane = F.pmod(F.xxhash64("name"), F.lit(lanes)).cast("int")
    return wanted.select("name", "url", lane.alias("lane")).repartition(lanes, "lane").mapInPandas(run, "name string, bytes long, error string")
