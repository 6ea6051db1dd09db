"""Maximal periodic runs of words in whole texts, by block convolution.

A run is a stretch of consecutive words with smallest period q and at least
max(12, 2q) words that keeps period q on neither side. Its words equal the ones
q further on over a stretch of at least max(q, 12 - q) words, so at the dyadic
scale B with 2B - 1 up to that number an aligned block of B words lies in it.
At every scale each block is therefore looked for in the window of the
distances of that scale: the sums of squared differences at all distances come
from one exact number-theoretic transform per block and window, and a zero is
an occurrence. A sum is known modulo a prime, so an occurrence is confirmed
word by word; nothing equal is ever missed. Occurrences of neighbouring blocks
at one distance are chained, and a chain is extended to both sides, each by
less than a block.

Blocks with a word that does not come again within the scale's distances have
no zero, so they are not transformed. An occurrence inside a known run whose
period divides the distance extends to that same run and is not followed.
Distances beyond the longest transform are searched with its blocks in several
windows. Whole texts are joined to batches of ``BATCH`` words; a longer text is
a batch of its own.

Defined results: words are separated by space and the characters 9 to 13; null
and empty texts have no word, no run and an empty collapsed text; repeated rows
give repeated results; null identifiers stay null; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galespark.llm import ntt

LEAST = 12  # words in a run
BATCH = 1 << 18  # words searched together
SLICE = 1 << 16  # numbers in one transform's matrix
SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def searches(longest: int) -> Iterator[tuple[int, int, int]]:
    """(block, least distance, greatest distance) up to half the longest text.

    At block B a run of period q is sure to hold an aligned block together with
    its copy where max(q, 12 - q) >= 2B - 1."""
    limit = longest // 2
    block = 2
    if limit >= 6:
        yield 2, 6, 6
    low = {4: 1}
    while True:
        block *= 2
        last = 2 * block > ntt.ORDER // 2
        end = limit if last else min(limit, 4 * block - 2)
        for d in range(low.get(block, 2 * block - 1), end + 1, block):
            yield block, d, min(end, d + block - 1)
        if end == limit:
            return


def following(ids: np.ndarray) -> np.ndarray:
    """Distance from every word to its next occurrence."""
    n = len(ids)
    bits = max(1, n.bit_length())
    order = np.sort(ids << bits | np.arange(n)) & ((1 << bits) - 1)
    gap = np.full(n, n, np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gap


def occurrences(residues: np.ndarray, starts: np.ndarray, n: int, block: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks at ``starts`` and distances with a zero sum of squared differences."""
    width = block + high - low
    blocks = np.lib.stride_tricks.sliding_window_view(residues, block)
    windows = np.lib.stride_tricks.sliding_window_view(residues, width)
    at, by = [], []
    step = max(1, SLICE // (2 * block))
    for i in range(0, len(starts), step):
        s = starts[i : i + step]
        row, place = np.nonzero(np.abs(ntt.mismatch(blocks[s], windows[s + low])) < 0.5)
        at.append(s[row])
        by.append(place + low)
    s, d = np.concatenate(at), np.concatenate(by)
    inside = s + d + block <= n
    return s[inside], d[inside]


def known(s: np.ndarray, d: np.ndarray, block: int, runs: np.ndarray) -> np.ndarray:
    """Occurrences inside one of ``runs`` (start, end, period) whose period divides the distance."""
    out = np.zeros(len(s), bool)
    if not len(s):
        return out
    runs = runs[runs[:, 1] - runs[:, 0] >= d.min() + block]
    for q in np.unique(runs[:, 2]):
        mine = runs[runs[:, 2] == q]  # of one period: starts and ends rise together
        mine = mine[np.argsort(mine[:, 0])]
        i = np.flatnonzero(d % q == 0)
        last = np.searchsorted(mine[:, 0], s[i], "right") - 1
        out[i] |= (last >= 0) & (mine[last, 1] >= s[i] + d[i] + block)
    return out


def equal_blocks(ids: np.ndarray, s: np.ndarray, d: np.ndarray, block: int) -> np.ndarray:
    out = np.empty(len(s), bool)
    span, step = np.arange(block), max(1, 4 * SLICE // block)
    for i in range(0, len(s), step):
        a = s[i : i + step, None] + span
        out[i : i + step] = (ids[a] == ids[a + d[i : i + step, None]]).all(axis=1)
    return out


def stretch(ids: np.ndarray, edge: np.ndarray, d: np.ndarray, block: int, way: int) -> np.ndarray:
    """How many words beyond ``edge`` equal the ones ``d`` further on; less than a block."""
    out = np.empty(len(edge), np.int64)
    span, step, n = np.arange(block) * way, max(1, 4 * SLICE // block), len(ids) - 1
    for i in range(0, len(edge), step):
        a = edge[i : i + step, None] + span
        b = np.minimum(a + d[i : i + step, None], n)
        out[i : i + step] = (ids[np.clip(a, 0, n)] == ids[b]).argmin(axis=1)
    return out


def extended(ids: np.ndarray, s: np.ndarray, d: np.ndarray, block: int) -> np.ndarray:
    """(start, end, distance) of the maximal stretches through confirmed occurrences."""
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    first = np.ones(len(s), bool)
    first[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1] + block)
    last = np.append(first[1:], True)
    left, right, d = s[first], s[last] + block, d[first]
    left = left - stretch(ids, left - 1, d, block, -1)
    right = right + stretch(ids, right, d, block, 1)
    keep = (right - left >= d) & (right - left + d >= LEAST)
    return np.column_stack([left, right + d, d])[keep]


def batch_runs(ids: np.ndarray, residues: np.ndarray, longest: int) -> np.ndarray:
    """(start, end, period) of all runs, by start and end.

    ``ids`` begins and ends with, and separates texts by, numbers found nowhere
    else; equal words of one text have equal ids, those of two texts do not."""
    gap, n = following(ids), len(ids)
    padded = np.concatenate([residues, np.zeros(2 * longest + 8)])
    found = np.zeros((0, 3), np.int64)
    for block, low, high in searches(longest):
        count = n // block
        again = gap[: count * block].reshape(count, block).max(axis=1) <= high
        starts = np.flatnonzero(again) * block
        starts = starts[starts + low + block <= n]
        if not len(starts):
            continue
        s, d = occurrences(padded, starts, n, block, low, high)
        new = ~known(s, d, block, found)
        s, d = s[new], d[new]
        new = equal_blocks(ids, s, d, block)
        if new.any():
            found = np.concatenate([found, extended(ids, s[new], d[new], block)])
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)  # of the multiples of a period the smallest is the period
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[first]


def search(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of word lists: number of each list's runs, rows (start, length,
    period) by list and start, and a mark for each word outside all repeats."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = 1 + np.arange(len(texts)) + np.append(0, np.cumsum(sizes)[:-1])  # a separator before each text
    n = int(sizes.sum()) + len(texts) + 1
    word = np.zeros(n, np.int64)
    own = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(own)) + own + 1
    word[place] = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, len(own))
    separator = np.ones(n, bool)
    separator[place] = False
    text = np.cumsum(separator) - 1
    ids = text * (len(number) + 1) + word
    ids[separator] = text[separator] * (len(number) + 1) + len(number)
    residues = ntt.centred((ids + text * 7919 % ntt.PRIME).astype(float) % ntt.PRIME)  # texts shifted against each other
    longest = int(sizes.max(initial=0))
    runs = batch_runs(ids, residues, longest) if longest >= LEAST else np.zeros((0, 3), np.int64)
    owner = text[runs[:, 0]]
    drop = np.zeros(n + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 1], -1)
    kept = np.cumsum(drop)[place] == 0
    rows = np.column_stack([runs[:, 0] - begin[owner], runs[:, 1] - runs[:, 0], runs[:, 2]])
    return np.bincount(owner, minlength=len(texts)), rows, kept


def parts(raw: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Consecutive texts as word lists, about ``BATCH`` words at a time."""
    first, held, size = 0, [], 0
    for i in range(len(raw)):
        words = (raw[i].as_py() or b"").split()
        if held and size + len(words) > BATCH:
            yield first, held
            first, held, size = i, [], 0
        held.append(words)
        size += len(words)
    if held:
        yield first, held


def find(docs: DataFrame) -> DataFrame:
    """doc_id, number of words, runs by start and period, and the text without
    repeats: its words but those in any run after the run's first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in parts(b.column(1)):
                counts, rows, kept = search(texts)
                ends = np.append(0, np.cumsum([len(t) for t in texts]))
                collapsed = [b" ".join(compress(t, kept[ends[i] : ends[i + 1]])) for i, t in enumerate(texts)]
                runs = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], names=["start", "length", "period"])
                columns = [
                    b.column(0).slice(first, len(texts)),
                    pa.array(np.diff(ends)),
                    pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), runs),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").cast("binary"))
    return rows.mapInArrow(run, SCHEMA)


def repeat_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts get a periodic tail: with h
    the CRC of the identifier and g = h // 10, texts with h % 10 = 0 repeat from
    word a = g % n on their next 1 + (n - a) // (3 + g % 8) words to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")
    words = F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+"), "")
    n = F.greatest(F.size("words"), F.lit(1))
    a = F.col("g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("g") % 8))
    tail = F.flatten(F.array_repeat(F.slice("words", (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    longer = F.array_join(F.concat(F.slice("words", F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int"))), " ")
    rows = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    return rows.select("doc_id", F.when(F.size("words") > 0, longer).otherwise(F.col("text")).alias("text"))
