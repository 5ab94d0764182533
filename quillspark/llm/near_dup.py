"""MinHash-style near-duplicates by SetSketch registers, verified on full shingle sets.

A text's set holds the hashes of its SHINGLE-word runs (ASCII lowered). Its sketch (Ertl 2021, SetSketch1) has registers
K = floor(1 - log_b x), truncated, of the smallest x that any element's Poisson points of rate A put into each register: with
base b near 1 they are mergeable by maximum and equal in two sketches about as often as the sets' Jaccard similarity.

1. Texts of one set (128-bit hash) are a class, its smallest doc_id stands for it.
2. Bands of the classes' registers are hashed to buckets. Bands are as many as keep the chance that a pair at the threshold
   shares no bucket under MISS.
3. Each text is compared with the one, of the smallest texts of its buckets, that it shares most bands with. Texts that
   hang together by the links found are a part.
4. Buckets of one part are done. In the others every text outside the bucket's largest part meets the texts of other parts, in
   tiles of at most TILE texts and TILE_BYTES. Only sketches meet first, a pair in the bucket of its first common band; then texts are shipped
   to the tiles where a pair of theirs is left. The likeliest pairs come first; what a tile has connected isn't compared any more, and a
   tile returns a forest of links, never all pairs.
5. To compare, counts of greater, smaller and equal registers give the likeliest similarity with both sizes known. Pairs
   under the threshold by more than MARGIN standard errors go; the others are verified on the full sets.
6. Components of the links are the groups; the smallest doc_id of each is kept.

Defined cases: a null or empty text, or one without words, has an empty set and no links; fewer than SHINGLE words are one
shingle, the whole sequence; repeated rows of a doc_id are one member; a row without doc_id is returned with null
component and kept; an empty table gives no rows. Only doc_id and text are read; further columns do no harm.

Scale: band rows and class joins are narrow equi-joins with pre-aggregated sides, written first, so both sides of a join
are plain shuffles that AQE can split. Sketches are computed once and stored. In step 3 a text is shipped about once, and
comparing streams sorted rows, a text and CHUNK partners a group at most. In step 4 a sketch is shipped once for each of its mixed
buckets and block of outsiders there, a text once for each such tile with a pair of its own that the sketches leave: texts of a chain, each alike the next
just under the threshold, are shipped a few times however long the chain is. A bucket of n texts with o outsiders takes n * o comparisons of sketches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.components import components
from quillspark.llm.frames import map_batches, materialise, tune
from quillspark.llm.words import batches, find_words, mix, rolled, slices, text_bytes
from quillspark.state import scoped

SHINGLE = 5
BASE, A, TOP = 1.001, 20.0, 65535
MISS = 1e-6
MARGIN = 6
CHUNK = 64
TILE, TILE_BYTES = 400, 4 << 20
SKETCH = "doc_id long, n_shingles long, h1 long, h2 long, registers binary, text string"
LINKS = "u long, v long"
TILED = "node long, bucket long, band int, pack long, part long, outside boolean, head boolean, i int, j int"
U = np.uint64
_MASK40 = U((1 << 40) - 1)


def plan_bands(threshold: float) -> tuple[int, int]:
    """(bands, registers a band)."""
    rows = 8 if threshold >= 0.85 else 6 if threshold >= 0.75 else 4
    return math.ceil(math.log(MISS) / math.log1p(-(threshold**rows))), rows


def shingle_sets(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of texts given by their words' hashes and rows: keys by text, and the n + 1 offsets."""
    keys = rolled(hashes, SHINGLE)
    whole = np.flatnonzero(row[: len(keys)] == row[SHINGLE - 1 :]) if len(keys) else np.zeros(0, np.int64)
    key, of = keys[whole], row[whole]
    counts = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts)])
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        extra = [rolled(hashes[first[i] : first[i + 1]], int(counts[i]))[0] ^ mix(np.array([counts[i]], U))[0] for i in short]
        key, of = np.concatenate([key, np.array(extra, U)]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        key, of = key[order], of[order]
    mixed = mix(key + of.astype(U) * U(0xD6E8FEB86659FD93))
    order = np.argsort(mixed)
    ranked = mixed[order]
    fresh = np.ones(len(key), bool)
    fresh[order[1:][ranked[1:] == ranked[:-1]]] = False
    key, of = key[fresh], of[fresh]
    return key, np.searchsorted(of, np.arange(n + 1))


def sketch(keys: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """Registers (texts by m) of non-empty and empty sets; an empty set's are 0."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    least = np.full((n, m), np.inf)
    todo, slack = np.flatnonzero(sizes > 0), 4.0
    while len(todo):
        limit = (math.log(m) + slack) / sizes[todo]
        size = sizes[todo]
        which = np.repeat(np.arange(len(todo)), size)
        key = keys[np.repeat(offsets[todo] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        x, t, block = np.zeros(len(key)), 0, 4
        flat = np.full(len(todo) * m, np.inf)
        while len(key):
            block = min(block, max(1, (1 << 19) // len(key)))
            step = (np.arange(t + 1, t + block + 1).astype(U)) * U(0x9E3779B97F4A7C15)
            draw = mix(key[:, None] + step)
            part = ((draw >> U(24)).astype(np.float64) + 0.5) * (1 / (1 << 40))
            points = x[:, None] + np.cumsum(-np.log(part), axis=1) * (1 / m)
            register = ((draw & U(0xFFFFFF)) * U(m) >> U(24)).astype(np.int64)
            use = points <= limit[which][:, None]
            np.minimum.at(flat, (which[:, None] * m + register)[use], points[use])
            x, t = points[:, -1], t + block
            live = x <= limit[which]
            key, x, which = key[live], x[live], which[live]
            block = block * 2 if t >= 8 else 4
        rows = flat.reshape(len(todo), m)
        full = np.isfinite(rows).all(1)
        least[todo[full]] = rows[full]
        todo, slack = todo[~full], slack * 2
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(least / A) / math.log(BASE))
    return np.clip(np.where(np.isfinite(least), level, 0), 0, TOP).astype(np.uint16)


def _sketches(docs: DataFrame, m: int) -> DataFrame:
    def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keys, bounds = [], [np.zeros(1, np.int64)]
        for a, b, words in batches(batch.column(1), lower=True):
            key, at = shingle_sets(words.hash, words.row, b - a)
            keys.append(key)
            bounds.append(at[1:] + bounds[-1][-1])
        key, at = np.concatenate(keys), np.concatenate(bounds)
        registers = sketch(key, at, m)
        total = [np.concatenate([np.zeros(1, U), np.cumsum(mix(key ^ U(c)))]) for c in (0x51, 0xA7)]
        h1, h2 = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in total)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(at)), pa.array(h1), pa.array(h2), pa.array([r.astype("<u2").tobytes() for r in registers], pa.binary()), batch.column(1)], names=[x.split()[0] for x in SKETCH.split(", ")]
        )

    return map_batches(docs.select("doc_id", "text"), each, SKETCH)


def estimate(greater: np.ndarray, smaller: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, m: int) -> np.ndarray:
    """Likeliest Jaccard similarity of pairs, from the counts of greater and smaller registers and the sets' sizes."""
    grid = np.linspace(0, 1, 101)
    u, v = (n_u / (n_u + n_v))[:, None], (n_v / (n_u + n_v))[:, None]
    most = np.minimum(u / v, v / u)
    j = np.minimum(grid[None, :], most)
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    same = np.maximum(1 - up - down, 1e-12)
    score = greater[:, None] * np.log(np.maximum(up, 1e-12)) + smaller[:, None] * np.log(np.maximum(down, 1e-12)) + (m - greater - smaller)[:, None] * np.log(same)
    return j[np.arange(len(j)), score.argmax(1)]


def _matrix(registers: pa.Array, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in registers), "<u2").reshape(len(registers), m)


def _similar(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, threshold: float, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of sketches (rows of left and right): which may reach the threshold by the estimate, and the estimates."""
    slack = MARGIN * math.sqrt(threshold * (1 - threshold) / m)
    fits = np.minimum(n_left, n_right) >= threshold * np.maximum(n_left, n_right)
    fits &= (left == right).sum(1) >= m * (threshold - slack) - 1
    likely = np.zeros(len(left))
    some = np.flatnonzero(fits)
    if len(some):
        greater, smaller = (left[some] > right[some]).sum(1), (left[some] < right[some]).sum(1)
        likely[some] = estimate(greater, smaller, n_left[some], n_right[some], m)
    return fits & (likely >= threshold - slack), likely


@dataclass
class _Head:
    """What partners are compared with: a sketch and, once asked for, the sorted keys of its full set."""

    n: int
    registers: bytes
    text: pa.Scalar
    keys: np.ndarray | None = None


def _sorted_sets(texts: pa.Array) -> list[np.ndarray]:
    data, offsets = text_bytes(texts)
    out = []
    for a, b in slices(offsets):
        part = offsets[a : b + 1]
        words = find_words(data[part[0] : part[-1]], part - part[0], lower=True)
        keys, at = shingle_sets(words.hash, words.row, b - a)
        out += [np.sort(keys[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return out


def _compare(batches: Iterator[pa.RecordBatch], threshold: float, m: int) -> Iterator[pa.RecordBatch]:
    """Links of rows (u, chunk, v, n_shingles, registers, text) that come by (u, chunk), u's own rows (v null) first.

    Only the sketches and sets of one u and of one batch are held.
    """
    now, heads = None, []
    for batch in batches:
        u, chunk, n = (batch.column(i).to_numpy() for i in (0, 1, 3))
        own = np.asarray(batch.column(2).is_null())
        v = batch.column(2).fill_null(0).to_numpy()
        registers, texts = batch.column(4), batch.column(5)
        pairs: list[tuple[int, _Head]] = []
        for i in range(len(u)):
            if (u[i], chunk[i]) != now:
                now, heads = (u[i], chunk[i]), []
            if own[i]:
                head = _Head(int(n[i]), registers[i].as_py(), texts[i])
                if all(h.registers != head.registers or h.text != head.text for h in heads):
                    heads.append(head)
            else:
                pairs += [(i, h) for h in heads]
        links = []
        for at in range(0, len(pairs), 2048):
            some = pairs[at : at + 2048]
            row = np.array([i for i, _ in some])
            left = np.frombuffer(b"".join(h.registers for _, h in some), "<u2").reshape(len(some), m)
            near, _ = _similar(left, _matrix(registers.take(pa.array(row)), m), np.array([h.n for _, h in some]), n[row], threshold, m)
            for k in range(0, int(near.sum()), 256):
                chosen = np.flatnonzero(near)[k : k + 256].tolist()
                fresh = list({id(h): h for h in (some[i][1] for i in chosen) if h.keys is None}.values())
                if fresh:
                    for h, keys in zip(fresh, _sorted_sets(pa.array([h.text.as_py() for h in fresh], pa.string())), strict=True):
                        h.keys = keys
                for i, keys in zip(chosen, _sorted_sets(texts.take(pa.array(row[chosen]))), strict=True):
                    full = some[i][1].keys
                    both = int((full[np.minimum(np.searchsorted(full, keys), len(full) - 1)] == keys).sum()) if len(full) else 0
                    if both and both >= threshold * (len(full) + len(keys) - both) - 1e-9:
                        links.append((u[row[i]], v[row[i]]))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["u", "v"])


def verified(candidates: DataFrame, pairs: DataFrame, threshold: float, m: int) -> DataFrame:
    """Those of the pairs (u, v) whose full sets reach the threshold, written.

    A text is shipped once for each pair as v, and as u once for CHUNK of its pairs, so a u of many pairs is many small groups.
    """
    counts = materialise(pairs.groupBy("u").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")), "counts")
    dealt = pairs.join(counts.hint("merge"), "u").select("u", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int").alias("chunk"), "v")
    dealt = materialise(dealt, "dealt")
    roles = dealt.select(F.col("v").alias("id"), "u", "chunk", "v").unionByName(dealt.select(F.col("u").alias("id"), "u", "chunk", F.lit(None).cast("long").alias("v")).distinct())
    rows = candidates.join(roles.hint("merge"), F.col("doc_id") == F.col("id")).select("u", "chunk", "v", "n_shingles", "registers", "text")
    rows = rows.repartition("u", "chunk").sortWithinPartitions("u", "chunk", F.asc_nulls_first("v"))
    return materialise(rows.mapInArrow(lambda batches: _compare(batches, threshold, m), LINKS).distinct(), "links")


def _roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, part) by pointer jumping over links (u, v) of which each v has one, u < v: equal parts are connected."""
    up = links.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("part"))
    for _ in range(2):
        up = materialise(up, "parents")
        above = up.select(F.col("node").alias("part"), F.col("part").alias("above"))
        up = up.join(above.hint("merge"), "part", "left").select("node", F.coalesce("above", "part").alias("part"))
    return materialise(nodes.join(up.hint("merge"), "node", "left").select("node", F.coalesce("part", "node").alias("part")), "parts")


def _tile_pairs(table: pa.Table, threshold: float, m: int, rows_a_band: int) -> np.ndarray:
    """(-likely, i, j) of the pairs of rows that may reach the threshold.

    Every head meets the others of its bucket that are of another part; two texts outside the largest part meet once. A pair that shares
    several buckets counts in that of its first common band.
    """
    ids, sizes, bucket, part, band = (table.column(c).to_numpy() for c in ("node", "n_shingles", "bucket", "part", "band"))
    outside, head = (table.column(c).to_numpy(zero_copy_only=False) for c in ("outside", "head"))
    registers = _matrix(table.column("registers").combine_chunks(), m)
    heads, others = np.flatnonzero(head), np.flatnonzero(~head)
    others = others[np.argsort(bucket[others], kind="stable")]
    first, last = (np.searchsorted(bucket[others], bucket[heads], side) for side in ("left", "right"))
    pairs: list[np.ndarray] = []
    for i, a, b in zip(heads.tolist(), first.tolist(), last.tolist(), strict=True):
        rows = others[a:b]
        rows = rows[(part[rows] != part[i]) & (~outside[rows] | (ids[rows] > ids[i]))]
        if len(rows):
            common = (registers[rows] == registers[i]).reshape(len(rows), -1, rows_a_band).all(2).argmax(1)
            rows = rows[common == band[i]]
        if len(rows):
            near, likely = _similar(np.broadcast_to(registers[i], (len(rows), m)), registers[rows], np.full(len(rows), sizes[i]), sizes[rows], threshold, m)
            if near.any():
                pairs.append(np.stack([-likely[near], np.full(int(near.sum()), i), rows[near]], 1))
    return np.concatenate(pairs) if pairs else np.zeros((0, 3))


def _tile_alive(table: pa.Table, threshold: float, m: int, rows_a_band: int) -> pa.Table:
    """The rows of a tile that are in a pair which may reach the threshold, without registers."""
    table = table.combine_chunks()
    pairs = _tile_pairs(table, threshold, m, rows_a_band)
    return table.take(pa.array(np.unique(pairs[:, 1:].astype(np.int64)))).select([x.split()[0] for x in TILED.split(", ")])


def _tile_links(table: pa.Table, threshold: float, m: int, rows_a_band: int) -> pa.Table:
    """A forest of verified links between parts, from a tile of rows; the likeliest pairs come first."""
    table = table.combine_chunks()
    pairs = _tile_pairs(table, threshold, m, rows_a_band)
    ids, part = (table.column(c).to_numpy() for c in ("node", "part"))
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = x = up.get(up[x], up[x])
        return x

    texts, sets, out = table.column("text").combine_chunks(), {}, []
    for _, i, j in pairs[np.lexsort(pairs.T[::-1])].tolist():
        i, j = int(i), int(j)
        x, y = root(int(part[i])), root(int(part[j]))
        if x == y:
            continue
        for k in (i, j):
            if k not in sets:
                sets[k] = frozenset(_sorted_sets(texts.slice(k, 1))[0].tolist())
        both = len(sets[i] & sets[j])
        if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
            up[max(x, y)] = min(x, y)
            out.append((ids[i], ids[j]))
    u, v = zip(*out, strict=True) if out else ((), ())
    return pa.table({"u": pa.array(list(u), pa.int64()), "v": pa.array(list(v), pa.int64())})


def _tiles(met: DataFrame, parts: DataFrame) -> DataFrame | None:
    """TILED rows for what the first comparisons left: the buckets with more than one part; None if there are none.

    Every text outside a bucket's largest part meets all texts of the bucket: the outsiders go in blocks, all texts in others, and
    each block meets each other in a tile of at most about TILE texts and TILE_BYTES. Small buckets share tiles.
    """
    own = materialise(met.withColumnRenamed("doc_id", "node").join(parts.hint("merge"), "node").select("node", "bucket", "band", "bytes", "part"), "own")
    kinds = own.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("bucket")
    mixed = materialise(own.join(materialise(kinds, "kinds").hint("merge"), "bucket"), "mixed")
    counts = mixed.groupBy("bucket", "part").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    sizes = materialise(counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "bytes", "part")).alias("most")), "sizes")
    total = sizes.agg(F.sum("n"), F.sum("bytes")).first()
    if not total[0]:
        return None
    packs = max(1, -(-int(total[0]) // (TILE // 2)), -(-int(total[1]) // (TILE_BYTES // 2)))
    alone = (F.col("n") > TILE / 4) | (F.col("bytes") > TILE_BYTES / 4)
    blocks = lambda n, size: F.when(alone, F.greatest(F.ceil(n / (TILE / 2)), F.ceil(size / (TILE_BYTES / 2)), F.lit(1))).otherwise(1).cast("int")
    sizes = sizes.select(
        "bucket", F.col("most.part").alias("largest"), blocks(F.col("n"), F.col("bytes")).alias("wide"), blocks(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes")).alias("high"),
        F.when(alone, F.col("bucket")).otherwise(-1 - F.pmod(F.xxhash64("bucket"), F.lit(packs))).alias("pack"),
    )
    rows = mixed.join(materialise(sizes, "blocks").hint("merge"), "bucket").withColumn("outside", F.col("part") != F.col("largest"))
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    one = lambda name: F.pmod(F.xxhash64("node", F.lit(name)), F.col(name)).cast("int")
    both = [F.col(c) for c in ("node", "bucket", "band", "pack", "part", "outside")]
    heads = rows.filter("outside").select(*both, F.lit(True).alias("head"), one("high").alias("i"), every("wide").alias("j"))
    others = rows.select(*both, F.lit(False).alias("head"), every("high").alias("i"), one("wide").alias("j"))
    return heads.unionByName(others)


def compared_in_buckets(met: DataFrame, candidates: DataFrame, parts: DataFrame, threshold: float, m: int, rows_a_band: int) -> DataFrame | None:
    """Verified links between parts, written: sketches meet first, and texts are shipped only to tiles where a pair of theirs is left."""
    tiles = _tiles(met, parts)
    if tiles is None:
        return None
    names = [x.split()[0] for x in TILED.split(", ")]
    sketched = candidates.select(F.col("doc_id").alias("node"), "n_shingles", "registers")
    alive = sketched.join(tiles.hint("merge"), "node").groupBy("pack", "i", "j").applyInArrow(lambda t: _tile_alive(t, threshold, m, rows_a_band), TILED)
    alive = materialise(alive.select(*names).distinct(), "alive")  # texts of one doc_id that differ are rows of their own
    full = candidates.withColumnRenamed("doc_id", "node").join(alive.hint("merge"), "node")
    return materialise(full.groupBy("pack", "i", "j").applyInArrow(lambda t: _tile_links(t, threshold, m, rows_a_band), LINKS), "links")


@scoped
def group_documents(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    tune(docs.sparkSession)
    bands, rows = plan_bands(threshold)
    m = bands * rows
    sketched = materialise(_sketches(docs, m), "sketches")
    some = sketched.filter("n_shingles > 0 and doc_id is not null")
    classes = materialise(some.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    members = materialise(sketched.select("doc_id", "n_shingles", "h1", "h2").join(classes, ["h1", "h2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).alias("rep")), "members")
    reps = members.filter("doc_id = rep").select("doc_id").distinct()
    key = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substr("registers", i * (2 * rows) + 1, F.lit(2 * rows))))
    alone = some.select("doc_id", "registers", F.octet_length("text").cast("long").alias("bytes")).join(reps.hint("merge"), "doc_id", "left_semi")
    banded = materialise(alone.select("doc_id", "bytes", F.posexplode(key).alias("band", "bucket")), "bands")
    buckets = materialise(banded.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("bucket", "least"), "buckets")
    met = materialise(banded.join(buckets.hint("merge"), "bucket"), "met")
    edges = met.filter("doc_id > least").groupBy(F.col("doc_id").alias("v"), F.col("least").alias("u")).agg(F.count("*").alias("bands"))
    best = materialise(edges.groupBy("v").agg(F.max_by("u", F.struct("bands", -F.col("u"))).alias("u")), "best")  # the bucket head that a text shares most bands with
    nodes = materialise(met.select(F.col("doc_id").alias("node")).distinct(), "nodes")
    candidates = materialise(some.select("doc_id", "n_shingles", "registers", "text").join(nodes.hint("merge"), F.col("doc_id") == F.col("node"), "left_semi"), "candidates")
    links = verified(candidates, best, threshold, m)
    more = compared_in_buckets(met, candidates, _roots(nodes, links), threshold, m, rows)
    groups = components(links if more is None else links.unionByName(more), "u", "v").withColumnRenamed("node", "rep")
    joined = members.join(groups, "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs without those that aren't the smallest doc_id of their group."""
    gone = group_documents(docs, threshold).filter(~F.col("kept")).select(F.col("doc_id").alias("__id"))
    return docs.join(gone.hint("merge"), F.col("doc_id") == F.col("__id"), "left_anti")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
e AS (SELECT DISTINCT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.v FROM r JOIN l ON l.u = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(b) AS component_id, n.doc_id = min(b) AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
