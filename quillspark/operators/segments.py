"""A search index of segments: a change writes a segment of its own rows and a list of the keys that it replaces, nothing else.

A segment holds (term, key, tf) rows sorted by term, so that the readers skip what other terms have; the empty term has each
document's length. Keys that a change replaces or deletes are dead in all segments before it. Numbers of documents and words are
kept as sums. When there are several segments of about one size, they are merged into one without what is dead; an entry is written
again about once for each tier of sizes. All changes are transactions of a store, so a search sees one state.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.search import ranked
from quillspark.sources.commits import Store, Transaction

COL = F.col
SEGMENTS = "segment long, rows long, docs long, words long"


class SegmentedIndex:
    """rows_of: (term, key, tf) of documents, as search.simple_rows() and stemmed_rows() give them. tier: so many segments of one size are merged, each size being so many times the one before."""

    def __init__(self, store: Store, key: str, rows_of: Callable[[DataFrame], DataFrame], tier: int = 4) -> None:
        self.store, self.key, self.rows_of, self.tier = store, key, rows_of, tier

    @staticmethod
    def _table(segment: int) -> str:
        return f"segment-{segment:012d}"

    def _segments(self, manifest: dict) -> list:
        return self.store.at(manifest, "segments").orderBy("segment").collect() if "segments" in manifest["tables"] else []  # a row a segment

    def _live(self, manifest: dict, segments: list[int]) -> DataFrame | None:
        """(term, key, tf) of the segments without what is dead."""
        if not segments:
            return None
        parts = [self.store.at(manifest, self._table(s)).withColumn("segment", F.lit(s).cast("long")) for s in segments]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        dead = self.store.at(manifest, "dead").groupBy(COL("key").alias("of")).agg(F.max("before").alias("before"))
        return rows.join(dead, (COL(self.key) == COL("of")) & (COL("segment") < COL("before")), "left_anti").drop("segment")

    def postings(self, number: int | None = None) -> DataFrame:
        """(term, key, tf) of all documents, at a commit; the empty term has their lengths."""
        manifest = self.store.manifest(number)
        return self._live(manifest, [s.segment for s in self._segments(manifest)])

    def change(self, docs: DataFrame, gone: DataFrame | None = None) -> None:
        """Put documents in or in place of those of their keys, and take out the keys of gone."""
        self.store.transact(lambda tx: self._change(tx, docs, gone))
        while self.store.transact(self._merge):
            pass

    def _change(self, tx: Transaction, docs: DataFrame, gone: DataFrame | None) -> None:
        number, known = tx.base + 1, self._segments(tx.before)
        keys = docs.select(COL(self.key).alias("key"))
        keys = (keys if gone is None else keys.unionByName(gone.select(COL(self.key).alias("key")))).distinct()
        order = ["term", self.key]  # by both, as a common term has more rows than fit in one range
        tx.replace(self._table(number), self.rows_of(docs).repartitionByRange(*order).sortWithinPartitions(*order))
        tx.append("dead", keys.withColumn("before", F.lit(number).cast("long")))
        new = tx.written(self._table(number))
        lengths = F.when(COL("term") == "", COL("tf"))
        rows, docs_, words = new.agg(F.count("*"), F.count(lengths), F.coalesce(F.sum(lengths), F.lit(0))).first()
        told = []
        for s in known:  # what the keys had: only the lengths of the segment are read
            old = self._live(tx.before, [s.segment]).filter("term = ''").join(keys, COL(self.key) == COL("key"), "left_semi")
            n, length = old.agg(F.count("*"), F.coalesce(F.sum("tf"), F.lit(0))).first()
            told.append((s.segment, s.rows, s.docs - n, s.words - length))
        tx.replace("segments", self.store.spark.createDataFrame([*told, (number, rows, docs_, words)], SEGMENTS).coalesce(1))

    def _merge(self, tx: Transaction) -> bool:
        """Merge the segments of the smallest size that has enough of them."""
        known, sizes = self._segments(tx.before), {}
        for s in known:
            sizes.setdefault(int(math.log(max(s.rows, 1), self.tier)), []).append(s)
        full = [some for _, some in sorted(sizes.items()) if len(some) >= self.tier]
        if not full:
            return False
        tx.read("segments")
        number, old = tx.base + 1, {s.segment for s in full[0]}
        order = ["term", self.key]
        tx.replace(self._table(number), self._live(tx.before, sorted(old)).repartitionByRange(*order).sortWithinPartitions(*order))
        for s in old:
            tx.drop(self._table(s))
        left = [s for s in known if s.segment not in old]
        merged = (number, tx.written(self._table(number)).count(), sum(s.docs for s in full[0]), sum(s.words for s in full[0]))
        tx.replace("segments", self.store.spark.createDataFrame([*map(tuple, left), merged], SEGMENTS).coalesce(1))
        oldest = min(number, *(s.segment for s in left), number)
        tx.replace("dead", tx.read("dead").filter(COL("before") > oldest))
        return True

    def search(self, wanted: list[str], every: bool, k: int, skip: DataFrame | None = None) -> DataFrame:
        """The k best of the matching documents by BM25, ties by key."""
        manifest = self.store.manifest()
        known = self._segments(manifest)
        live = self._live(manifest, [s.segment for s in known])
        n = sum(s.docs for s in known)
        stats = self.store.spark.createDataFrame([(n, sum(s.words for s in known) / max(n, 1))], "n long, mean double")
        lengths = live.filter("term = ''").select(self.key, COL("tf").alias("length"))
        return ranked(live.filter("term <> ''"), lengths, self.key, wanted, every, k, skip, stats)
