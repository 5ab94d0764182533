"""Byte-level BPE by numpy matrices: encode texts to token ids and back.

A text splits by the tokenizer's pattern, here found with arrays of character classes; each match is encoded apart. New
matches of a slice go into padded matrices by length bucket. In each round every row finds the ranks of its neighbouring pairs in a hash table, merges its leftmost
pair of minimum rank, and closes the gap; rows without a mergeable pair leave the matrix. Matches of over LONG bytes are
merged with a heap over a linked list in the same order, since a round for each merge would take quadratic time.
Encoded matches are remembered up to REMEMBER of them (and REMEMBER_BYTES of long ones) in each worker; then the memory starts anew.

Defined cases: a null or empty text has no tokens and decodes to nothing; every byte is a token, so any text encodes;
repeated rows give repeated results; an empty table gives no rows. Only doc_id and text are read; further columns do
no harm.

Scale: no shuffle; whole texts, slice by slice. The vocabulary is read once and sent as a broadcast bounded by its file.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillspark.llm.frames import tune
from quillspark.llm.words import Sums, mix, slices, text_bytes

LONG = 256
#: Longer pieces are known by their bytes, shorter ones by a hash and their first 8 bytes; what they decode to is compared.
EXACT = 64
REMEMBER, REMEMBER_BYTES = 250_000, 8 << 20
BUCKETS = (4, 6, 8, 10, 12, 16, 24, 32, 64, 128, LONG)
NONE = np.int32(1 << 30)
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS = "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: The only pattern split_pieces() knows: contractions, then runs of letters, numbers, others, each with a space before
#: it, then white space, whose last character stays for what follows. Fixed: it must equal the tokenizer's.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTER, NUMBER, SPACE, OTHER = range(4)
U = np.uint64
FREE = U(0xFFFFFFFFFFFFFFFF)
_MULTIPLIER = U(0x9E3779B97F4A7C15)


def _classes() -> np.ndarray:
    """The class of every code point, as the regex module has it."""
    out = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, expression in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(expression, everything):
            a, b = ord(everything[m.start()]), ord(everything[m.end() - 1])
            out[a : b + 1] = kind
    return out


def split_pieces(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte positions at which the pattern's matches begin; a match ends where the next begins or its text ends."""
    if not len(data):
        return np.zeros(0, np.int64)
    place = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[place].astype(np.int32)
    for low, keep, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        some = np.flatnonzero((code >= low) & (code < {0xC0: 0xE0, 0xE0: 0xF0, 0xF0: 0x100}[low]) & (data[place] == code))
        value = code[some] & keep
        for i in range(1, more + 1):
            value = (value << 6) | (data[place[some] + i] & 0x3F)
        code[some] = value
    kind, n = classes[code], len(place)
    head = np.zeros(n + 1, bool)
    head[np.searchsorted(place, offsets)] = True
    fresh = head[:-1].copy()
    fresh[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    blank_before = np.zeros(n, bool)
    blank_before[1:] = (code[:-1] == 32) & ~head[1:-1]
    start = fresh & ~(~space & blank_before)
    start[:-1] |= space[:-1] & ~space[1:] & ~head[1:-1]
    for i in np.flatnonzero((code == 39) & start).tolist():
        tail = "".join(chr(c) for c in code[i + 1 : i + 3])
        k = 1 if tail[:1] in ("s", "t", "m", "d") else 2 if tail in ("re", "ve", "ll") else 0
        if k and not head[i + 1 : i + 1 + k].any():
            start[i + 1] = False
            if i + 1 + k < n:
                start[i + 1 + k] = True
    return place[start]


class Bpe:
    """A vocabulary (lines of base64 token and rank) for texts split by PATTERN."""

    def __init__(self, vocabulary: bytes) -> None:
        self.ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in vocabulary.splitlines() if x)}
        self.classes = _classes()
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.token_sizes = np.array([len(t) for t in self.tokens], np.int64)
        self._hash_pairs()
        self.forget()

    def forget(self) -> None:
        """Empty the memory of pieces: a hash table of their keys, and their ids end to end."""
        self.count, self.filled, self.memory_bits = 0, 0, 18
        self.memory = np.full(1 << self.memory_bits, -1, np.int32)
        self.keys_of, self.heads_of = np.zeros(1 << 16, U), np.zeros(1 << 16, U)
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.int32)
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0

    def _hash_pairs(self) -> None:
        """Open addressing over all pairs of tokens whose bytes together are a token."""
        get = self.ranks.get
        pairs = [(a << 32 | b, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (a := get(t[:i])) is not None and (b := get(t[i:])) is not None]
        keys, ranks = np.array([k for k, _ in pairs], U), np.array([r for _, r in pairs], np.int32)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, FREE)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == FREE
            _, winners = np.unique(slot[left[free]], return_index=True)
            put = left[free][winners]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], ranks[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> U(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each merged pair, NONE where the pair isn't a token."""
        keys = (left.astype(U) << U(32)) | right.astype(U)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found != FREE))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != FREE)]
        return out

    def _merge_matrix(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the rows of a padded matrix until none has a mergeable pair."""
        done_ids, done_sizes = ids.copy(), sizes.copy()
        rows, width = np.arange(len(ids)), ids.shape[1]
        column = np.arange(width)
        ranks = np.full((len(ids), width), NONE, np.int32)
        valid = column[:-1] < (sizes - 1)[:, None]
        r, c = np.nonzero(valid)
        ranks[r, c] = self.pair_ranks(ids[r, c], ids[r, c + 1])
        while len(rows):
            at = ranks.argmin(1)
            each = np.arange(len(rows))
            best = ranks[each, at]
            over = best == NONE
            if over.any():
                done_ids[rows[over]], done_sizes[rows[over]] = ids[over], sizes[over]
                keep = ~over
                rows, ids, sizes, ranks, at, best = rows[keep], ids[keep], sizes[keep], ranks[keep], at[keep], best[keep]
                each = np.arange(len(rows))
                if not len(rows):
                    break
            ids[each, at] = best
            behind = column[None, :-1] > at[:, None]
            ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(behind, ranks[:, 1:], ranks[:, :-1])
            sizes = sizes - 1
            ranks[each, np.maximum(sizes - 1, 0)] = NONE
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.pair_ranks(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < sizes - 1)
            ranks[right, at[right]] = self.pair_ranks(ids[right, at[right]], ids[right, at[right] + 1])
        return done_ids, done_sizes

    def _merge_long(self, raw: np.ndarray) -> np.ndarray:
        """The same merges with a heap of (rank, place)."""
        ids: list[int] = self.byte_ids[raw].tolist()
        n, tokens, get = len(ids), self.tokens, self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := get(tokens[ids[i]] + tokens[ids[j]])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([x for x in ids if x >= 0], np.int32)

    def _merged(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces end to end, and how many each has."""
        sizes = end - start
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low = 0
        for high in BUCKETS:
            some = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            for at in range(0, len(some), 8192):
                part = some[at : at + 8192]
                column = np.arange(high)
                inside = column < sizes[part][:, None]
                matrix = self.byte_ids[data[np.where(inside, start[part][:, None] + column, 0)]]
                ids, n = self._merge_matrix(matrix, sizes[part].astype(np.int32))
                parts.append((part, n, ids[column < n[:, None]]))
        for i in np.flatnonzero(sizes > LONG):
            ids = self._merge_long(data[start[i] : end[i]])
            parts.append((np.array([i]), np.array([len(ids)]), ids))
        index, n, flat = (np.concatenate([p[i] for p in parts]) for i in range(3))
        counts = np.zeros(len(start), np.int64)
        counts[index] = n
        first = np.zeros(len(start), np.int64)
        first[index] = np.cumsum(n) - n
        ends = np.cumsum(counts)
        return flat[np.repeat(first - (ends - counts), counts) + np.arange(len(flat))], counts

    def _find(self, keys: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Where the memory has the pieces of these keys and first bytes, -1 where it hasn't."""
        shift, last = U(64 - self.memory_bits), (1 << self.memory_bits) - 1
        slot = (keys >> shift).astype(np.int64)
        at = self.memory[slot]
        wrong = np.flatnonzero((at >= 0) & ((self.keys_of[at] != keys) | (self.heads_of[at] != heads)))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & last
            at[wrong] = next_ = self.memory[slot[wrong]]
            wrong = wrong[(next_ >= 0) & ((self.keys_of[next_] != keys[wrong]) | (self.heads_of[next_] != heads[wrong]))]
        return at

    def _enter(self, at: np.ndarray) -> None:
        """Put the pieces of these numbers, all different, into the hash table."""
        shift, last = U(64 - self.memory_bits), (1 << self.memory_bits) - 1
        slot = (self.keys_of[at] >> shift).astype(np.int64)
        while len(at):
            free = self.memory[slot] < 0
            self.memory[slot[free]] = at[free]
            left = self.memory[slot] != at
            at, slot = at[left], (slot[left] + 1) & last

    def _remember(self, keys: np.ndarray, heads: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        a, b = self.count, self.count + len(keys)
        while b > len(self.keys_of):
            for name in ("keys_of", "heads_of", "starts", "sizes"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.keys_of[a:b], self.heads_of[a:b], self.sizes[a:b] = keys, heads, counts
        self.starts[a:b] = self.filled + np.cumsum(counts) - counts
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.count, self.filled = b, self.filled + len(ids)
        if b * 2 > len(self.memory):
            self.memory_bits = int(b * 4).bit_length()
            self.memory = np.full(1 << self.memory_bits, -1, np.int32)
            a = 0
        self._enter(np.arange(a, b, dtype=np.int32))

    def _find_long(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> int:
        """Where the memory has this piece, known by its bytes."""
        raw = data[start[0] : end[0]].tobytes()
        if raw not in self.long:
            self.long[raw] = self.count
            self.long_bytes += len(raw)
            name = hashlib.sha256(raw).digest()
            self._remember(np.frombuffer(name[:8], U), np.frombuffer(name[8:16], U), *self._merged(data, start, end))
        return self.long[raw]

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Ids of the texts end to end, the n + 1 offsets of the texts in them, and the bytes that the ids decode to.

        The memory knows most pieces by hashes alone. So the ids are decoded, and unless each piece gives its own bytes again, all
        pieces are merged anew without the memory.
        """
        start = split_pieces(data, offsets, self.classes)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), b""
        end = np.append(start[1:], len(data))
        ids, counts = self._known(data, start, end)
        ends, raw = np.cumsum(counts), data.tobytes()
        decoded = self.decode(ids)
        if decoded != raw or (np.add.reduceat(self.token_sizes[ids], ends - counts) != end - start).any():
            ids, counts = self._merged(data, start, end)
            ends, decoded = np.cumsum(counts), self.decode(ids)
        return ids, np.concatenate([[0], ends])[np.searchsorted(start, offsets)], decoded

    def _known(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces end to end, and how many each has, from the memory, into which new pieces go."""
        size = end - start
        keys = mix(Sums.of_bytes(data).hash(start, end) + size.astype(U))
        heads = np.zeros(len(start), U)
        for i in range(8):
            heads |= np.where(size > i, data[np.minimum(start + i, len(data) - 1)], 0).astype(U) << U(8 * i)
        if self.count > REMEMBER or self.long_bytes > REMEMBER_BYTES:
            self.forget()
        at = self._find(keys, heads)
        for i in np.flatnonzero(size > EXACT).tolist():
            at[i] = self._find_long(data, start[i : i + 1], end[i : i + 1])
        new = np.flatnonzero(at < 0)
        if len(new):
            _, one = np.unique(keys[new], return_index=True)
            one = new[one]
            self._remember(keys[one], heads[one], *self._merged(data, start[one], end[one]))
            at[new] = self._find(keys[new], heads[new])
            lost = new[at[new] < 0]  # the same key, other first bytes
            for i in lost.tolist():
                if (found := self._find(keys[i : i + 1], heads[i : i + 1]))[0] < 0:
                    self._remember(keys[i : i + 1], heads[i : i + 1], *self._merged(data, start[i : i + 1], end[i : i + 1]))
                    found = self._find(keys[i : i + 1], heads[i : i + 1])
                at[i] = found[0]
        counts = self.sizes[at].astype(np.int64)
        ends = np.cumsum(counts)
        where = np.repeat(self.starts[at] - (ends - counts), counts) + np.arange(int(ends[-1]))
        return self.ids[where], counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_bytes(*text_bytes(pa.array(texts, pa.string())))[:2]

    def decode(self, ids: np.ndarray) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids.tolist()])


_cache: dict[str, Bpe] = {}


def worker_bpe(vocabulary: bytes) -> Bpe:
    """The worker's own encoder; it stays while the worker does."""
    key = hashlib.sha256(vocabulary).hexdigest()
    if key not in _cache:
        _cache.clear()
        _cache[key] = Bpe(vocabulary)
    return _cache[key]


def _mapped(docs: DataFrame, path: str, pattern: str, schema: str, each) -> DataFrame:  # noqa: ANN001
    if pattern != PATTERN:
        raise ValueError("split_pieces() knows PATTERN only")
    spark = docs.sparkSession
    tune(spark)
    with open(path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    names = [x.split()[0] for x in schema.split(", ")]  # no type here holds a comma and a space

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(sent.value)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets):
                part = offsets[a : b + 1]
                ids, bounds, decoded = bpe.encode_bytes(data[part[0] : part[-1]], part - part[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *each(ids, bounds, decoded, part - part[0])], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _digests(ids: np.ndarray, offsets: np.ndarray, decoded: bytes, places: np.ndarray) -> list[pa.Array]:
    """Counts, and digests of ids and of decoded bytes; places: where each text's bytes begin, as each piece decodes to its own."""
    raw, own = ids.astype("<u4").tobytes(), memoryview(decoded)
    digests = lambda data, at: pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())
    return [pa.array(np.diff(offsets)), digests(memoryview(raw), offsets * 4), digests(own, places)]


def encode_documents(docs: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id, ids (the token ids of each whole text), and the columns of digest()."""
    return _mapped(docs, path, pattern, IDS, lambda ids, offsets, decoded, places: [pa.ListArray.from_arrays(offsets.astype(np.int32), ids), *_digests(ids, offsets, decoded, places)])


def digest(docs: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, and decoded again from the ids."""
    return _mapped(docs, path, pattern, DIGEST, _digests)
