"""Token counts as a byte-level BPE tokenizer gives them, from a file of ranks: words by a pattern, then merges by rank.

A file has a line for each token: its bytes in base64 and its rank. The file is read once on the driver and travels with the
function; a worker parses it once. Special tokens aren't known: their strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words remembered by a worker, in bytes of words; the memory is emptied when it is full.
MEMORY = 8 << 20


@lru_cache(maxsize=4)
def _ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line.strip())}


def merged(word: bytes, ranks: dict[bytes, int]) -> int:
    """How many tokens are left of a word's bytes when the pair of the lowest rank, the leftmost of equal ones, is merged until none is.

    Pairs wait in a heap; the parts are a linked list, so a word of n bytes takes n log n steps.
    """
    n = len(word)
    if n < 2 or word in ranks:
        return min(n, 1)
    end, before, ahead = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, size = heapq.heappop(heap)
        j = ahead[i] if end[i] else -1
        if j < 0 or end[j] - i != size:  # one of the two has been merged meanwhile
            continue
        end[i], ahead[i], end[j] = end[j], ahead[j], 0
        if ahead[i] >= 0:
            before[ahead[i]] = i
        left -= 1
        for a, b in ((before[i], i), (i, ahead[i])):
            if a >= 0 and b >= 0 and (r := ranks.get(word[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b] - a))
    return left


class TokenCounter:
    """Counts tokens of texts: counter(text). pattern: what a word is, in the syntax of the regex module."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.raw = f.read()
        self.pattern = pattern
        self._start()

    def _start(self) -> None:
        self.ranks, self.words = _ranks(self.raw), regex.compile(self.pattern)
        self._known: dict[str, int] = {}
        self._held = 0

    def __getstate__(self) -> tuple[bytes, str]:
        return self.raw, self.pattern

    def __setstate__(self, state: tuple[bytes, str]) -> None:
        self.raw, self.pattern = state
        self._start()

    def __call__(self, text: str) -> int:
        total = 0
        for word in self.words.findall(text):
            n = self._known.get(word)
            if n is None:
                if self._held > MEMORY:
                    self._known.clear()
                    self._held = 0
                n = self._known[word] = merged(word.encode(), self.ranks)
                self._held += len(word) + 64
            total += n
        return total

    def column(self, text: Column | str) -> Column:
        """The number of tokens of a text; null of null."""
        return F.pandas_udf(lambda texts: pd.Series([None if t is None else self(t) for t in texts], dtype="Int64"), "long")(text)
