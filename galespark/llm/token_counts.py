"""Token counts by byte-pair merging, without emitting identifiers.

A text is cut into chunks at white space (a chunk keeps one space before it),
a chunk into pre-tokens by the vocabulary's pattern, and a pre-token's bytes are
merged over a linked list: a heap gives the adjacent pair of lowest rank, the
leftmost first, until no pair has a rank. The count is symbols minus merges.
Chunks repeat, so each task keeps a bounded memory of chunk counts; what falls
out of it is counted again.

Defined results: null counts as the empty text, which has no tokens; special
strings inside a text are one token each, as in the library; repeated rows give
repeated results; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMORY = 250_000  # chunks remembered in each of two generations
SPACE = r"\t-\r \x85\xa0  -     　"  # white space as Unicode defines it


class Merges:
    """Counts tokens of pre-tokens by rank-ordered merges of bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = _shown_bytes()
        code = {c: b for b, c in shown.items()}
        self.rank = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(code[a] << 32 | code[b], (r, code.setdefault(a + b, len(code))))
        self.special = [t["content"] for t in spec["added_tokens"]]

    def count(self, word: bytes) -> int:
        n = len(word)
        symbol, after, before = list(word), list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank.get
        heap = [(r[0], i) for i in range(n - 1) if (r := rank(symbol[i] << 32 | symbol[i + 1]))]
        heapq.heapify(heap)
        left = n
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j >= n:
                continue
            now = rank(symbol[i] << 32 | symbol[j])
            if now is None or now[0] != r:
                continue  # the pair has changed since
            symbol[i], symbol[j] = now[1], -1
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if new := rank(symbol[i] << 32 | symbol[k]):
                    heapq.heappush(heap, (new[0], i))
            if (h := before[i]) >= 0 and (new := rank(symbol[h] << 32 | symbol[i])):
                heapq.heappush(heap, (new[0], h))
        return left


def _shown_bytes() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: printable
    Latin-1 stands for itself, the rest for code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    shown = {b: chr(b) for b in plain}
    return shown | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


class Memory(dict):
    """Chunk -> value with two generations, so that it stays bounded."""

    def __init__(self, make, limit: int = MEMORY):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        return self.put(key, self.make(key) if value is None else value)

    def put(self, key, value):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Counter:
    def __init__(self, path: str, pattern: str):
        merges = Merges(path)
        word = regex.compile(pattern)
        self.chunk = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.special = re.compile("|".join(map(re.escape, merges.special))) if merges.special else None
        self.known = Memory(lambda c: sum(merges.count(w.encode()) for w in word.findall(c)))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        parts, extra = [text], 0
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            extra = len(parts) - 1
        return extra + sum(sum(map(self.known.__getitem__, self.chunk.findall(p))) for p in parts)


@functools.lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    """One per Python worker: its memory lives as long as the worker."""
    return Counter(path, pattern)


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern)
        for b in batches:
            n = pa.array([count(t.as_py()) for t in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], names=["doc_id", "n_bytes", "n_tokens"])

    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    rows = docs.select(F.col("doc_id").cast("bigint"), size, F.col("text").cast("string"))
    out = rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
