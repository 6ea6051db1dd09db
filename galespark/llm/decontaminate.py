"""Benchmark passages in training texts, by an FM-index of each training shard.

The benchmark's texts are cut to windows of ``WINDOW`` consecutive words; a
shorter text is one window. Windows are read from their last word, so that all
windows with a common ending share its search. The words of training texts,
numbered by the benchmark's vocabulary, form shards of at most ``SHARD`` words;
a text longer than a shard goes on in the next one with an overlap. Over each
shard an FM-index is built: backward search by wavelet ranks gives the windows
that occur, sampled suffix positions give where, and what they cover is merged
to spans.

The benchmark is the stated query set: its windows are broadcast in blocks of
about ``BLOCK`` words, after counting. With more than one block the spans and
items found are carried through one pass per block, with a written table in
between. Documents are never shuffled.

Defined results: words are ASCII letters and digits and everything beyond ASCII,
A-Z lower-cased; texts without a word (null, empty) have none and are never
hit; an item without a word has no window; items under one identifier are one;
an item with a null identifier marks words, but is not listed; repeated rows
give repeated results; null identifiers of documents stay null; empty tables
give an empty result or no hits; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galespark.llm import fm_index
from galespark.session import cut

WINDOW = 10
SHARD = 1 << 20  # words
BLOCK = 1 << 18  # words of the benchmark broadcast together
PIECE = 1000  # windows of an item in one row
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SPANS = "array<struct<start: bigint, end: bigint>>"
FOUND = f"doc_id bigint, n_words bigint, spans {SPANS}, items array<string>"


@dataclass
class Endings:
    """Windows of one length as a tree of their endings, and the items of each window."""

    length: int
    parents: list[np.ndarray]  # per depth: node one word shorter
    symbols: list[np.ndarray]  # the word before it
    first: np.ndarray  # window i belongs to items[first[i]:first[i + 1]]
    items: np.ndarray

    @classmethod
    def of(cls, windows: np.ndarray, items: np.ndarray) -> Endings:
        length = windows.shape[1]
        node, parents, symbols = np.zeros(len(windows), np.int64), [], []
        for depth in range(length):
            code, node = np.unique(node << 32 | windows[:, length - 1 - depth], return_inverse=True)
            parents.append(code >> 32)
            symbols.append(code & 0xFFFFFFFF)
        pair = np.unique(np.column_stack([node, items]), axis=0)
        named = pair[pair[:, 1] >= 0]
        return cls(length, parents, symbols, np.searchsorted(named[:, 0], np.arange(len(parents[-1]) + 1)), named[:, 1])

    def search(self, index: fm_index.Index) -> tuple[np.ndarray, np.ndarray]:
        """Windows that occur, and where."""
        low, high = np.zeros(1, np.int64), np.full(1, index.n)
        for parent, symbol in zip(self.parents, self.symbols):
            live = np.flatnonzero(high[parent] > low[parent])
            at = parent[live]
            below, above = low[at], high[at]
            low, high = np.zeros((2, len(parent)), np.int64)
            low[live], high[live] = index.step(symbol[live], below, above)
        number = high - low
        window = np.repeat(np.arange(len(low)), number)
        rows = np.repeat(low - np.append(0, np.cumsum(number)[:-1]), number) + np.arange(number.sum())
        return window, index.locate(rows)


@dataclass
class Phrases:
    names: list[str]  # items, sorted as strings
    numbers: dict[bytes, int]  # vocabulary, from 1
    endings: list[Endings]

    @classmethod
    def of(cls, items: list[str | None], pieces: list[list[str]]) -> Phrases:
        names = sorted({i for i in items if i is not None})
        place = {name: i for i, name in enumerate(names)} | {None: -1}
        numbers = {w.encode(): i for i, w in enumerate(sorted({w for p in pieces for w in p}), 1)}
        windows: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for item, piece in zip(items, pieces):
            ids = np.array([numbers[w.encode()] for w in piece], np.int64)
            k = min(WINDOW, len(ids))
            view = np.lib.stride_tricks.sliding_window_view(ids, k)
            windows.setdefault(k, []).append((view, np.full(len(view), place[item])))
        return cls(names, numbers, [Endings.of(*map(np.concatenate, zip(*windows[k]))) for k in sorted(windows)])


def numbered(raw: bytes, numbers: dict[bytes, int]) -> np.ndarray:
    words = raw.translate(FOLD).split()
    return np.fromiter(map(numbers.get, words, repeat(0)), np.int64, len(words))


def segments(n: int, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of a shard's length, cut at ends of texts, or inside a text with an overlap."""
    at = 0
    while at < n:
        stop = n
        if n - at > SHARD:
            whole = ends[np.searchsorted(ends, at + SHARD, "right") - 1]
            stop = int(whole) if whole > at else at + SHARD
        yield at, stop
        at = stop if stop == n or stop in ends else stop - WINDOW + 1


def search(texts: list[np.ndarray], phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(text, start, end) of the merged spans, and distinct (text, item), both sorted."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    begin = ends - sizes
    line = np.zeros(int(ends[-1]), np.int64)
    for b, t in zip(begin, texts):
        line[b : b + len(t)] = t
    cover = np.zeros(len(line) + 1, np.int64)
    pairs = [np.zeros((0, 2), np.int64)]
    for low, high in segments(len(line), ends):
        part = line[low:high]
        if not part.any():
            continue
        index = fm_index.Index(part if part[-1] == 0 else np.append(part, 0), len(phrases.numbers))
        for e in phrases.endings:
            window, at = e.search(index)
            at += low
            np.add.at(cover, at, 1)
            np.add.at(cover, at + e.length, -1)
            text = np.searchsorted(ends, at, "right")
            seen = np.unique(text * len(e.parents[-1]) + window)
            text, window = np.divmod(seen, len(e.parents[-1]))
            number = np.diff(e.first)[window]
            place = np.repeat(e.first[window] - np.append(0, np.cumsum(number)[:-1]), number) + np.arange(number.sum())
            pairs.append(np.column_stack([np.repeat(text, number), e.items[place]]))
    covered = np.append(0, np.cumsum(cover[:-1]) > 0).astype(np.int8)
    edge = np.diff(covered, append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text = np.searchsorted(ends, start, "right")
    return np.column_stack([text, start - begin[text], end - begin[text]]), np.unique(np.concatenate(pairs), axis=0)


def benchmark_pieces(benchmark: DataFrame) -> DataFrame:
    """item_id and words; a long item in several rows that share no window."""
    folded = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    words = F.array_remove(F.split(folded, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words.alias("words")).filter("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(1)), F.lit(PIECE))
    rows = rows.select("item_id", "words", F.explode(starts).alias("at"))
    return rows.select("item_id", "at", F.slice("words", F.col("at"), F.lit(PIECE + WINDOW - 1)).alias("words")).distinct()


def blocks_of(benchmark: DataFrame) -> Iterator[Phrases]:
    """The windows in blocks whose number follows from a count of words."""
    pieces = cut(benchmark_pieces(benchmark))
    total = pieces.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    number = -(-total // BLOCK)
    block = F.pmod(F.xxhash64("words"), F.lit(max(1, number)))
    for i in range(number):
        rows = pieces.filter(block == i).select("item_id", "words").toArrow()  # about BLOCK words
        if rows.num_rows:
            yield Phrases.of(rows["item_id"].to_pylist(), rows["words"].to_pylist())


def parts(raw: pa.Array, numbers: dict[bytes, int]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Consecutive texts as numbers, about a shard at a time."""
    first, held, size = 0, [], 0
    for i in range(len(raw)):
        ids = numbered(raw[i].as_py() or b"", numbers)
        if held and size + len(ids) + 1 > SHARD:
            yield first, held
            first, held, size = i, [], 0
        held.append(ids)
        size += len(ids) + 1
    if held:
        yield first, held


def merged(old: list[list[tuple[int, int]]], new: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    out = []
    for a, b in zip(old, new):
        spans: list[tuple[int, int]] = []
        for s, e in sorted(a + b):
            if spans and s <= spans[-1][1]:
                spans[-1] = spans[-1][0], max(e, spans[-1][1])
            else:
                spans.append((s, e))
        out.append(spans)
    return out


def lists(owner: np.ndarray, values: list, number: int) -> list[list]:
    at = np.searchsorted(owner, np.arange(number + 1))
    return [values[at[i] : at[i + 1]] for i in range(number)]


def one_pass(rows: DataFrame, phrases: Phrases, last: bool) -> DataFrame:
    """Adds the spans and items of one block to those of ``rows(doc_id, text, spans, items)``."""
    shared = rows.sparkSession.sparkContext.broadcast(phrases)  # about BLOCK words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for b in batches:
            for first, texts in parts(b.column(1), phrases.numbers):
                found, pairs = search(texts, phrases)
                here = b.slice(first, len(texts))
                spans = lists(found[:, 0], list(zip(found[:, 1].tolist(), found[:, 2].tolist())), len(texts))
                items = lists(pairs[:, 0], [phrases.names[i] for i in pairs[:, 1]], len(texts))
                if b.num_columns > 2:
                    old = [[(s["start"], s["end"]) for s in x] for x in here.column(2).to_pylist()]
                    spans = merged(old, spans)
                    items = [sorted({*x, *y}) for x, y in zip(here.column(3).to_pylist(), items)]
                marks = [[{"start": s, "end": e} for s, e in x] for x in spans]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                columns = [here.column(0), sizes if last else here.column(1), pa.array(marks, kind), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "c", "d"])

    return rows.mapInArrow(run, FOUND if last else FOUND.replace("n_words bigint", "text binary"))


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, number of words, merged spans of hit words (from 0, end exclusive),
    and the items whose windows occur, sorted as strings."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").cast("binary").alias("text"))
    blocks = blocks_of(benchmark)
    now = next(blocks, Phrases([], {}, []))
    for after in blocks:
        rows = cut(one_pass(rows, now, False))
        now = after
    return one_pass(rows, now, True)
