"""Best-fit packing of tokenised documents into sequences of fixed length.

Documents become token pieces. Full pieces are sequences at once. The others
are packed best-fit, largest first, inside each partition; bins that are nearly
full are sequences, the rest go as single items into the next round, with fewer
partitions each time, until one small partition is left. A task never packs
more than ``CHUNK`` items together, so its memory does not grow with the input;
where that many bins stay underfull and rounds stop helping, they go out as
they are.

Defined results: null and empty texts are one piece with the separator alone;
repeated rows are packed each; a null identifier stays null; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galespark.llm.token_counts import SPACE
from galespark.session import cut

LENGTH, SEPARATOR = 2048, 0
REMEMBERED = 100_000_000  # bytes of remembered chunks in a Python worker, about
ENTRY = 220  # of them for an entry beside its characters
TEXT = 2_000_000  # characters encoded together
TOGETHER = 4096  # chunks in one call of the library
WORD_END = "</w>"  # mark of a word's last token
# texts of plain characters: ASCII and European letters that stay one letter in lower case
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
# bytes of plain texts: 0 white space, 1 letters with all beyond ASCII, 2 digits, 3 others
KIND = np.array([0 if c in b" \t\n\r" else 1 if c > 127 or chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(256)], np.uint8)
DOUBTFUL = np.array([c > 126 or (c < 32 and KIND[c] > 0) for c in range(256)])  # bytes that plain texts do not have but in pairs
PAIRS = np.zeros((256, 256), bool)  # plain letters of two bytes
PAIRS[tuple(np.array([list(c.encode()) for c in map(chr, range(128, 0x180)) if re.match(f"[{LETTERS}]", c)]).T)] = True
SLACK = 8  # a bin with no more room than this is nearly full
CHUNK, FAN_IN = 50_000, 8


class Encoder:
    """Identifiers of texts by a vocabulary that drops white space and case.

    Texts of plain characters are cut, in lower case, into the words that the
    vocabulary's own rule gives; others into chunks between white space, which
    are independent too. A word or chunk is encoded once and remembered; words
    go to the library without its rules for words, which they have gone
    through. What is remembered is bounded by its size."""

    def __init__(self, path: str, limit: int = REMEMBERED):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.ready = Tokenizer(self.library.model)  # for what went through the rules
        self.ready.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.chunk = re.compile(f"[^{SPACE}]+")
        self.limit = limit
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith(WORD_END)]] = True
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.size, self.ids, self.lengths = 0, [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]

    def _encode(self, chunks: list[str], words: bool) -> tuple[np.ndarray, np.ndarray]:
        """Many chunks as one text, which spares the library's cost per call.
        The last token of a word is marked as such; other chunks are told apart
        by the tokens' offsets."""
        text = " ".join(chunks)
        if words:
            ids = np.array(self.ready.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(chunks):
                return ids, np.diff(last, prepend=-1)
        got = self.library.encode(text, add_special_tokens=False)
        starts = np.cumsum([0, *(len(c) + 1 for c in chunks)])
        return np.array(got.ids, "<u4"), np.diff(np.searchsorted(np.array([a for a, _ in got.offsets], np.int64), starts))

    def _learn(self, chunks: list[str], words: bool) -> None:
        for at in range(0, len(chunks), TOGETHER):
            part = chunks[at : at + TOGETHER]
            ids, lengths = self._encode(part, words)
            self.ids.append(ids)
            self.lengths.append(lengths)
            self.rows.update(zip(part, range(len(self.rows), len(self.rows) + len(part))))
            self.size += sum(map(len, part)) + ENTRY * len(part) + ids.nbytes

    def _plain(self, texts: pa.StringArray) -> np.ndarray:
        """Which texts consist of plain characters and hold no special token."""
        raw, at = content(texts)
        odd = np.flatnonzero(DOUBTFUL[raw])
        around = np.concatenate([[0], raw, [0]])
        odd = odd[~(PAIRS[around[odd], raw[odd]] | PAIRS[raw[odd], around[odd + 2]])]
        plain = np.ones(len(texts), bool)
        plain[np.searchsorted(at, odd, side="right") - 1] = False
        small = raw.tobytes().lower()
        for s in self.special:
            if s.lower().encode() in small:
                plain &= ~pc.match_substring(texts, s, ignore_case=True).to_numpy(zero_copy_only=False)
        return plain

    def _rows(self, chunks: list[str], words: bool) -> np.ndarray:
        """Where the chunks are remembered, new ones after they are learnt."""
        row = np.fromiter(map(self.rows.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(row < 0).tolist()
        if new:
            self._learn(list(dict.fromkeys(chunks[i] for i in new)), words)
            row[new] = [self.rows[chunks[i]] for i in new]
        return row

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' identifiers in one array, and how many each text has."""
        if self.size > self.limit:
            self.forget()
        texts = pc.fill_null(texts, "")
        plain, sizes = self._plain(texts), np.zeros(len(texts), np.int64)
        found, sizes[plain] = words(pc.utf8_lower(texts.filter(pa.array(plain))))
        found = found.dictionary_encode()
        row = self._rows(found.dictionary.to_numpy(zero_copy_only=False).tolist(), True)[found.indices.to_numpy()]
        if not plain.all():
            lists = [self.chunk.findall(t) for t in texts.filter(pa.array(~plain)).to_pylist()]
            sizes[~plain] = [len(x) for x in lists]
            word, of_words = np.repeat(plain, sizes), row
            row = np.empty(len(word), np.int64)
            row[word], row[~word] = of_words, self._rows(list(chain.from_iterable(lists)), False)
        self.ids, self.lengths = [np.concatenate(self.ids)], [np.concatenate(self.lengths)]
        lengths = self.lengths[0]
        start = np.cumsum(lengths) - lengths
        taken = lengths[row]
        ends = np.append(0, np.cumsum(taken))
        ids = self.ids[0][np.repeat(start[row] - ends[:-1], taken) + np.arange(ends[-1])]
        return ids, np.diff(ends[np.append(0, np.cumsum(sizes))])


def content(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, none of them null, and where each text begins and the last ends."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The words of plain texts in lower case, and how many each text has. As in
    the vocabulary's rule words are an apostrophe with s, t, re, ve, m, ll or d;
    letters; single digits; runs of others."""
    raw, at = content(texts)
    kind = KIND[raw]
    begin = kind == 2
    begin[1:] |= kind[1:] != kind[:-1]
    begin[at[:-1][at[:-1] < at[1:]]] = True
    begin &= kind > 0
    mark = np.flatnonzero(begin & (raw == ord("'")))
    end = at[np.searchsorted(at, mark, side="right")]
    one, two = np.append(raw, [0, 0])[mark + 1], np.append(raw, [0, 0])[mark + 2]
    pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    letters = np.where(np.isin(one, list(b"stmd")), 1, np.where(pair, 2, 0))
    on = (letters > 0) & (mark + letters < end)
    begin[mark[on] + 1] = False
    after = (mark + letters + 1)[on]
    after = after[after < len(raw)]
    begin[after[kind[after] == 1]] = True
    start = np.flatnonzero(begin)
    black = kind > 0
    bounds = np.append(0, np.cumsum(black))[np.append(start, len(raw))].astype(np.int32)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(raw[black])), np.diff(np.searchsorted(start, at))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def slices(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Consecutive texts of some ``TEXT`` characters together."""
    first, size = 0, 0
    for i, n in enumerate(lengths):
        if i > first and size + n > TEXT:
            yield first, i
            first, size = i, 0
        size += n
    if len(lengths) > first:
        yield first, len(lengths)


def pieces(docs: DataFrame, path: str, length: int = LENGTH, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, on demand, the identifiers (little-endian 32 bit)."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + ids]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([SEPARATOR], "<u4").tobytes()
        for whole in batches:
            for a, b in slices(pc.fill_null(pc.utf8_length(whole.column(1)), 0).to_pylist()):
                here = whole.slice(a, b - a)
                found, sizes = encode(here.column(1))
                rows = []
                for doc_id, text in zip(here.column(0).to_pylist(), np.split(found, np.cumsum(sizes)[:-1])):
                    raw = text.tobytes() + end
                    for i in range(0, len(raw), 4 * length):
                        part = raw[i : i + 4 * length]
                        rows.append((doc_id, i // (4 * length), i // 4, len(part) // 4, zlib.crc32(part), part))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        encode.forget()  # the worker lives on, for other stages

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing; bins by remaining room, found through a bit set of rooms."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = some >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                some ^= 1 << left
        else:
            left, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left -= size
        room[left].append(b)
        some |= 1 << left
    return bins


def _round(capacity: int, slack: int):
    def pack(used: np.ndarray, members: list, sizes: list) -> pa.RecordBatch:
        bins = best_fit(used, capacity)
        filled = np.array([int(used[b].sum()) for b in bins], np.int32)
        inside = [np.concatenate([members[i] for i in b]) for b in bins]
        lengths = [np.concatenate([sizes[i] for i in b]) for b in bins]
        return pa.RecordBatch.from_arrays([
            pa.array(filled), pa.array(filled >= capacity - slack), pa.array(inside, pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int32())),
        ], names=["used", "full", "members", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, members, sizes = [], [], []
        for b in batches:
            used += b.column(0).to_pylist()
            members += [np.array(x, np.int64) for x in b.column(1).to_pylist()]
            sizes += [np.array(x, np.int32) for x in b.column(2).to_pylist()]
            while len(used) >= CHUNK:
                yield pack(np.array(used[:CHUNK]), members[:CHUNK], sizes[:CHUNK])
                used, members, sizes = used[CHUNK:], members[CHUNK:], sizes[CHUNK:]
        if used:
            yield pack(np.array(used), members, sizes)

    return run


def pack(rows: DataFrame, length: int = LENGTH, slack: int = SLACK, fan_in: int = FAN_IN) -> DataFrame:
    """``rows`` of :func:`pieces` with ``sequence_id`` and ``offset``."""
    rows = cut(rows.withColumn("pid", F.monotonically_increasing_id()))
    schema = "used int, full boolean, members array<bigint>, sizes array<int>"
    full = F.col("length") >= length
    items = rows.filter(~full).select(
        F.col("length").cast("int").alias("used"), F.array("pid").alias("members"), F.array(F.col("length").cast("int")).alias("sizes")
    )
    parts, before, done = max(1, items.rdd.getNumPartitions()), None, []
    while True:
        bins = cut(items.mapInArrow(_round(length, slack), schema))
        left = bins.filter("not full").count()
        # settled: one task saw all that was left, or many bins stay that no round improves
        last = left == 0 or parts == 1 or (before is not None and left > 0.99 * before and left > CHUNK)
        done.append(bins if last else bins.filter("full"))
        if last:
            break
        before = left
        parts = max(1, parts // fan_in, -(-left // CHUNK) if left > CHUNK else 1)
        items = bins.filter("not full").select("used", "members", "sizes").repartition(parts)
    bins = done[0]
    for more in done[1:]:
        bins = bins.unionByName(more)
    starts = F.expr("transform(sizes, (s, i) -> cast(aggregate(slice(sizes, 1, i), 0, (a, x) -> a + x) as bigint))")
    placed = bins.select(F.col("members")[0].alias("sequence_id"), F.explode(F.arrays_zip(F.col("members").alias("pid"), starts.alias("offset"))).alias("x"))
    placed = placed.select("sequence_id", "x.pid", "x.offset")
    loose = rows.filter(~full).join(placed, "pid").drop("pid")
    ready = rows.filter(full).withColumns({"sequence_id": F.col("pid"), "offset": F.lit(0).cast("bigint")}).drop("pid")
    return loose.unionByName(ready)
