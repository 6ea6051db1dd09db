"""Bigram language model in Elias-Fano tries, trained and queried in shards.

All pairs of words that occur at least ``MIN_COUNT`` times in the training
texts (all of them) are kept, with absolute discounting; the discounted and all
other mass of a context goes to the unigram distribution. So
P(w | p) = max(c(p,w) - D, 0) / c(p) + rest(p) P(w).

The ``VOCABULARY`` most frequent words (a whole class of equal counts is left
out rather than split), begin and end get numbers, and pairs of them go into
tries. That bounds what is broadcast, not the model: a pair with any other word
is found by the hashes of its words in tables sorted beside the tries, and what
is known of such a word lies in the shard of its hash, so scores do not depend
on which words have numbers. Only a ``size`` that the caller names limits the
model to as many words; the others then share their mass evenly and are in no pair.

Neither counts nor tries are ever whole in one place. Each task folds the pairs
of its texts into sorted, compressed blocks per shard; shards are hashes of the
pair, so frequent words spread. A shard becomes one trie and a table of its
other pairs; texts are scored by sending blocks of (pair, text) to the shards. Pairs so frequent that their
shard would stand out are broadcast (at most ``1 / HOT_SHARE``), as are the
vocabulary's counts; both bounds are fixed. Counts and masses of rarer words
stay in the shards.

Defined results: null and empty texts are the end token alone; repeated rows
are scored (and learned) each; an empty table gives an empty result; with
nothing to learn from N and V are 0; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galespark.llm.elias_fano import WORD, Trie, quantised, restored, write_trie
from galespark.session import cut

VOCABULARY = 1 << 20
DISCOUNT, MIN_COUNT = 0.75, 1
HOT_SHARE = 1e-5
SHARD_BYTES = 8 << 20  # of text
FOLD_TOKENS = 1_200_000  # tokens folded into blocks at a time


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) >> np.uint64(1)).astype(np.int64)


def packed(values: np.ndarray, sorted_: bool = False) -> bytes:
    """Differences if sorted, then byte planes, compressed."""
    v = np.diff(values, prepend=values.dtype.type(0)) if sorted_ else values
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(len(v), v.dtype.itemsize).T)
    return zstandard.compress(planes.tobytes(), 1)


def unpacked(raw: bytes, kind, sorted_: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    v = np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(v, dtype=kind) if sorted_ else v


@dataclass
class Vocabulary:
    hashes: np.ndarray  # sorted; the place is the word's number
    counts: np.ndarray  # of the words, then of begin and end
    tokens: int  # N
    types: int  # V
    shards: int
    limited: bool = False  # to the numbered words
    rare: bool = True  # whether there are words without number
    rest: np.ndarray | None = None  # quantised mass left to the unigrams, by context
    hot: tuple[np.ndarray, np.ndarray] | None = None  # frequent pairs and their probabilities

    @property
    def begin(self) -> int:
        return len(self.hashes)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 - hash for words without."""
        if not len(self.hashes):
            return -1 - hashes
        h, at = np.unique(hashes, return_inverse=True)
        i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[i] == h, i, -1 - h)[at]

    def number(self, word: bytes) -> int:
        return int(self.numbers(hashes_of([word]))[0])

    def unigrams(self) -> tuple[np.ndarray, float]:
        """Probabilities of numbered words and of any other word: where the model is not limited, of one never seen."""
        other_mass = self.tokens - self.counts[:-2].sum() - self.counts[-1] + 1
        other = other_mass / (self.tokens + 1) / max(1, self.types - len(self.hashes)) if self.limited else 1 / (self.tokens + 1)
        return np.where(self.counts > 0, self.counts / (self.tokens + 1), other), other

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.tokens + self.types + 1))

    def shard(self, pair: np.ndarray) -> np.ndarray:
        return ((pair * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(self.shards)).astype(np.min_scalar_type(self.shards))


def pair_hash(p: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of pairs of numbers, negative ones (hashes) among them."""
    x = p.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(32)) + w.astype(np.uint64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _stream(batches: Iterator[pa.RecordBatch], voc: Vocabulary) -> Iterator[tuple[list, list, np.ndarray, np.ndarray]]:
    """(first columns, words per text, numbers of all words) in folds of bounded size."""
    uid, ids, sizes, hashes, total = [], [], [], [], 0
    waiting: list[bytes] = []

    def hash_all():
        hashes.append(hashes_of(waiting))
        waiting.clear()

    def fold():
        hash_all()
        return uid, ids, np.array(sizes, np.int64), voc.numbers(np.concatenate(hashes))

    for b in batches:
        for u, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            words = words_of(t.as_py())
            uid.append(u)
            ids.append(i)
            sizes.append(len(words))
            waiting += words
            total += len(words)
            if len(waiting) >= 100_000:
                hash_all()
            if total >= FOLD_TOKENS or len(uid) >= 60_000:
                yield fold()
                uid, ids, sizes, hashes, total = [], [], [], [], 0
    if uid:
        yield fold()


def _pairs(sizes: np.ndarray, numbers: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, words and text places of all bigrams, begin and end included."""
    n = len(sizes)
    text = np.repeat(np.arange(n), sizes)
    stops = np.cumsum(sizes)
    words = np.insert(numbers, stops, begin + 1)
    contexts = np.insert(numbers, stops - sizes, begin)
    return contexts, words, np.insert(text, stops, np.arange(n))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    waiting: list[bytes] = []

    def hash_all():
        held.append(hashes_of(waiting))
        waiting.clear()

    def flush():
        h, c = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c.astype(np.int64))], names=["h", "c"])

    for b in batches:
        for t in b.column(0):
            waiting += words_of(t.as_py())
            if len(waiting) >= 100_000:
                hash_all()
                if sum(map(len, held)) >= 2 * FOLD_TOKENS:
                    yield flush()
    hash_all()
    yield flush()


def learn_vocabulary(train: DataFrame, numbered: int = VOCABULARY, limited: bool = False) -> tuple[Vocabulary, DataFrame]:
    """The ``numbered`` most frequent words, and the table (h, c) of the others' counts."""
    counts = cut(train.select("text").mapInArrow(_count_words, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")))
    facts = train.agg(F.count(F.lit(1)).alias("texts"), F.sum(F.octet_length("text")).alias("bytes")).first()
    step = F.floor(F.log2("c") * 8)  # classes of counts, some hundred at most
    classes = sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect(), reverse=True)
    room, least = numbered, None
    for k in classes:
        room -= k.n
        if room < 0:
            break
        least = k.step
    rows = counts.filter(step >= least) if least is not None else counts.limit(0)
    got = rows.toArrow().sort_by("h")
    tokens, types = sum(k.c for k in classes) + facts.texts, sum(k.n for k in classes) + (facts.texts > 0)
    voc = Vocabulary(
        got["h"].to_numpy(), np.r_[got["c"].to_numpy(), facts.texts, facts.texts].astype(np.int64), tokens, types,
        max(8, -(-(facts.bytes or 0) // SHARD_BYTES)), limited, len(got) < sum(k.n for k in classes),
    )
    rare = counts.filter(~(step >= least)) if least is not None else counts
    return voc, rare


def _by_shard(keys: np.ndarray, shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each shard that has any, the places of its keys, in their order."""
    order = np.argsort(keys)
    order = order[np.argsort(shard[order], kind="stable")]  # small whole numbers: by digits
    ends = np.r_[0, np.cumsum(np.bincount(shard, minlength=shards))]
    for s in np.flatnonzero(np.diff(ends)):
        yield int(s), order[ends[s] : ends[s + 1]]


FREQUENT, OTHERS = 0, 1


def _fold_pairs(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc: Vocabulary = shared.value
        names = ["shard", "kind", "p", "w", "n"]

        def row(s, kind, p, w, n):
            return pa.RecordBatch.from_arrays([
                pa.array([s], pa.int32()), pa.array([kind], pa.int32()), pa.array([p], pa.binary()), pa.array([w], pa.binary()),
                pa.array([packed(n.astype(np.uint32))], pa.binary()),
            ], names=names)

        for _, _, sizes, numbers in _stream(batches, voc):
            p, w, _ = _pairs(sizes, numbers, voc.begin)
            on = (p >= 0) & (w >= 0)
            pair, n = np.unique(p[on].astype(np.uint64) << np.uint64(WORD) | w[on].astype(np.uint64), return_counts=True)
            for s, x in _by_shard(pair, voc.shard(pair), voc.shards):
                yield row(s, FREQUENT, packed(pair[x], True), None, n[x])
            if not voc.limited and not on.all():
                p, w = p[~on], w[~on]
                pair, at, n = np.unique(pair_hash(p, w), return_index=True, return_counts=True)
                p, w = p[at], w[at]
                for s, x in _by_shard(pair, voc.shard(pair), voc.shards):
                    yield row(s, OTHERS, packed(p[x]), packed(w[x]), n[x])

    return run


def _keep_pairs(least: int):
    def summed(key, n):
        """Counts of each key, and where it stands first."""
        key, first, at = np.unique(key, return_index=True, return_inverse=True)
        return key, first, np.bincount(at, n)

    def joined(column, kind, sorted_=False):
        return np.concatenate([np.zeros(0, kind), *(unpacked(x.as_py(), kind, sorted_) for x in column)])

    def run(group: pa.Table) -> pa.Table:
        parts = [group.filter(pa.array(group["kind"].to_numpy() == k)) for k in (FREQUENT, OTHERS)]
        pair, _, n = summed(joined(parts[0]["p"], np.uint64, True), joined(parts[0]["n"], np.uint32).astype(np.float64))
        pair, n = pair[n >= least], n[n >= least]
        p, w = (joined(parts[1][c], np.int64) for c in ("p", "w"))
        _, first, m = summed(pair_hash(p, w), joined(parts[1]["n"], np.uint32).astype(np.float64))
        p, w, m = p[first][m >= least], w[first][m >= least], m[m >= least]
        contexts, at = np.unique(np.r_[(pair >> np.uint64(WORD)).astype(np.int64), p], return_inverse=True)
        mass = np.bincount(at, np.r_[n, m] - DISCOUNT) if len(at) else np.zeros(0)
        values = {
            "pairs": packed(pair, True), "n": packed(n.astype(np.uint32)), "other_p": packed(p), "other_w": packed(w), "other_n": packed(m.astype(np.uint32)),
        }
        return pa.table({"shard": pa.array([group["shard"][0].as_py()], pa.int32())} | {k: pa.array([v], pa.binary()) for k, v in values.items()} | {
            "contexts": pa.array([contexts], pa.list_(pa.int64())), "mass": pa.array([mass], pa.list_(pa.float64())),
        })

    return run


def _build(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc: Vocabulary = shared.value
        for b in batches:
            for s, pairs, n in zip(*(c.to_pylist() for c in b.columns)):
                pair = unpacked(pairs, np.uint64, True)
                context = (pair >> np.uint64(WORD)).astype(np.int64)
                word = pair & np.uint64((1 << WORD) - 1)
                p = (unpacked(n, np.uint32) - DISCOUNT) / voc.counts[context]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), pa.array([0], pa.int32()), pa.array([write_trie(context, word, p)])], names=["shard", "kind", "data"]
                )

    return run


def _frequent(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = shared.value.tokens * HOT_SHARE
        for b in batches:
            for pairs, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                pair, n = unpacked(pairs, np.uint64, True), unpacked(n, np.uint32)
                hot = n >= max(least, MIN_COUNT)
                yield pa.RecordBatch.from_arrays([pa.array(pair[hot].astype(np.int64)), pa.array(n[hot].astype(np.int64))], names=["pair", "n"])

    return run


def _rare_block(group: pa.Table) -> pa.Table:
    """Counts of a shard's rare words and what they leave to the unigrams, sorted by hash."""
    order = np.argsort(group["h"].to_numpy())
    h, c, mass = group["h"].to_numpy()[order].astype(np.uint64), group["c"].to_numpy()[order].astype(np.uint32), group["mass"].to_numpy()[order]
    data = framed(packed(h, True), packed(c), packed(quantised(np.maximum(1 - mass / c, 1e-9))))
    return pa.table({"shard": pa.array([group["shard"][0].as_py()], pa.int32()), "kind": pa.array([1], pa.int32()), "data": pa.array([data], pa.binary())})


def framed(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unframed(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def _other_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the pairs with a word without number."""
    for b in batches:
        for s, *raw in zip(*(c.to_pylist() for c in b.columns)):
            p, w, n = (unpacked(x, k).astype(np.int64) for x, k in zip(raw, (np.int64, np.int64, np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), s, np.int32)), pa.array(p), pa.array(w), pa.array(n)], names=["shard", "p", "w", "n"])


def _other_block(shared):
    """What seeing each other pair of a shard adds to the logarithm, sorted by the pairs' hash."""

    def run(group: pa.Table) -> pa.Table:
        voc: Vocabulary = shared.value
        p, w, n, cp, mass, cw = (group[c].to_numpy() for c in ("p", "w", "n", "cp", "mass", "cw"))
        rest = quantised(np.maximum(1 - mass / cp, 1e-9))
        context = np.where(p >= 0, p, 0)
        rest, cp = np.where(p >= 0, voc.rest[context], rest), np.where(p >= 0, voc.counts[context], cp)
        cw = np.where(w >= 0, voc.counts[np.where(w >= 0, w, 0)], cw)
        add = np.log10(1 + restored(quantised((n - DISCOUNT) / cp)) / (restored(rest) * cw / (voc.tokens + 1)))
        pair = pair_hash(p, w)
        order = np.argsort(pair)
        data = framed(packed(pair[order], True), packed(add[order].astype(np.float32)))
        return pa.table({"shard": pa.array([group["shard"][0].as_py()], pa.int32()), "kind": pa.array([2], pa.int32()), "data": pa.array([data], pa.binary())})

    return run


MODEL = "shard int, kind int, data binary"


def _others(kept: DataFrame, rare: DataFrame, voc: Vocabulary, shared) -> DataFrame:
    """Blocks of the words without number and of the pairs that they are in.

    Such a word's count is below those of all numbered words, which bounds the
    pairs that meet at it in the joins; a numbered word needs no join."""
    if voc.limited:
        words, blocks = rare.withColumn("mass", F.lit(0.0)), None
    else:
        # unpacked again by each reader: a table of the rows would take several times the disk
        pairs = kept.select("shard", "other_p", "other_w", "other_n").mapInArrow(_other_pairs, "shard int, p bigint, w bigint, n bigint")
        mass = pairs.filter("p < 0").groupBy((-1 - F.col("p")).alias("h")).agg(F.sum(F.col("n") - DISCOUNT).alias("mass"))
        words = cut(rare.join(mass, "h", "left").select("h", "c", F.coalesce("mass", F.lit(0.0)).alias("mass")))
        context = words.select((-1 - F.col("h")).alias("p"), F.col("c").alias("cp"), "mass")
        word = words.select((-1 - F.col("h")).alias("w"), F.col("c").alias("cw"))
        one = F.lit(1).cast("bigint")
        left = pairs.filter("p < 0").join(context, "p").unionByName(pairs.filter("p >= 0").withColumns({"cp": one, "mass": F.lit(0.0)}))
        both = left.filter("w < 0").join(word, "w").unionByName(left.filter("w >= 0").withColumn("cw", one))
        blocks = both.repartition(voc.shards, "shard").groupBy("shard").applyInArrow(_other_block(shared), MODEL)
    by_shard = words.select(F.pmod("h", F.lit(voc.shards)).cast("int").alias("shard"), "h", "c", "mass")
    words = by_shard.repartition(voc.shards, "shard").groupBy("shard").applyInArrow(_rare_block, MODEL)
    return words if blocks is None else words.unionByName(blocks)


def learn(train: DataFrame, size: int | None = None, least: int = MIN_COUNT, numbered: int = VOCABULARY) -> tuple[Vocabulary, DataFrame]:
    """The broadcast part of the model and the table of its shards (shard, kind,
    data). ``numbered`` words are broadcast; ``size`` limits the model to as many."""
    spark = train.sparkSession
    train = train.select(F.lit(0).cast("bigint").alias("uid"), F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    voc, rare = learn_vocabulary(train, numbered if size is None else min(size, VOCABULARY), size is not None)
    shared = spark.sparkContext.broadcast(voc)
    blocks = train.mapInArrow(_fold_pairs(shared), "shard int, kind int, p binary, w binary, n binary")
    kept = cut(
        blocks.repartition(voc.shards, "shard").groupBy("shard")
        .applyInArrow(_keep_pairs(least), "shard int, pairs binary, n binary, other_p binary, other_w binary, other_n binary, contexts array<bigint>, mass array<double>")
    )
    mass = (
        kept.select(F.explode(F.arrays_zip("contexts", "mass")).alias("x")).filter("x.contexts >= 0")
        .groupBy("x.contexts").agg(F.sum("x.mass").alias("mass")).toArrow()
    )  # a row per numbered word at most
    rest = np.ones(len(voc.counts))
    at = mass["contexts"].to_numpy()
    rest[at] = 1 - mass["mass"].to_numpy() / voc.counts[at]
    voc.rest = quantised(np.maximum(rest, 1e-9))
    few = kept.select("shard", "pairs", "n").mapInArrow(_frequent(shared), "pair bigint, n bigint").toArrow().sort_by("pair")  # at most 1 / HOT_SHARE
    pair = few["pair"].to_numpy().astype(np.uint64)
    voc.hot = pair, restored(quantised((few["n"].to_numpy() - DISCOUNT) / np.maximum(1, voc.counts[(pair >> np.uint64(WORD)).astype(np.int64)])))
    shared = spark.sparkContext.broadcast(voc)
    tries = kept.select("shard", "pairs", "n").mapInArrow(_build(shared), MODEL)
    return voc, cut(tries.unionByName(_others(kept, rare, voc, shared)) if voc.rare else tries)


TEXTS, PAIRS, RARE, OTHER_PAIRS = 0, 1, 2, 3


def _questions(shared):
    """Per fold: what is known at once about each text, and blocks of what the shards must answer."""
    fields = [("shard", pa.int32()), ("kind", pa.int32()), ("first", pa.int64()), ("a", pa.binary()), ("b", pa.binary())]

    def row(*values):
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, (_, k) in zip(values, fields)], names=[f for f, _ in fields])

    def spread(keys, shard, text, kind, first, shards):
        for s, x in _by_shard(keys, shard, shards):
            yield row(s, kind, first, packed(keys[x], True), packed(text[x].astype(np.uint16)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc: Vocabulary = shared.value
        unigram, other = voc.unigrams()
        log_uni, log_rest = np.log10(unigram), np.log10(restored(voc.rest))
        log_base, none_base = voc.base(voc.counts), voc.base(np.zeros(1))[0]
        # of a word without number the shards know more, where there are any
        log_other = np.log10(other) if voc.limited or not voc.rare else 0.0
        hot_pair, hot_p = voc.hot
        for uid, ids, sizes, numbers in _stream(batches, voc):
            p, w, text = _pairs(sizes, numbers, voc.begin)
            n, first = len(sizes), uid[0]
            known_w, known_p = w >= 0, p >= 0
            score = np.where(known_w, log_uni[np.where(known_w, w, 0)], log_other) + np.where(known_p, log_rest[np.where(known_p, p, 0)], 0)
            base = np.where(known_w, log_base[np.where(known_w, w, 0)], 0 if voc.rare else none_base)
            seen = known_w & (voc.counts[np.where(known_w, w, 0)] > 0)
            both = known_w & known_p
            pair, at = p[both].astype(np.uint64) << np.uint64(WORD) | w[both].astype(np.uint64), text[both]
            if len(hot_pair):
                i = np.minimum(np.searchsorted(hot_pair, pair), len(hot_pair) - 1)
                hot = hot_pair[i] == pair
                add = np.log10(1 + hot_p[i[hot]] / 10 ** score[both][hot])
                extra = np.bincount(at[hot], add, n)
                pair, at = pair[~hot], at[~hot]
            else:
                extra = 0
            sums = np.stack([np.bincount(text, minlength=n), np.bincount(text, seen, n), np.bincount(text, base, n), np.bincount(text, score, n) + extra])
            none = np.array([i is None for i in ids])
            own = np.array([i or 0 for i in ids], np.int64)
            yield row(first % voc.shards, TEXTS, first, sums.astype("<f8").tobytes(), own.tobytes() + none.tobytes())
            yield from spread(pair, voc.shard(pair), at, PAIRS, first, voc.shards)
            if voc.rare:
                h = (-1 - w[~known_w]).astype(np.uint64)
                yield from spread(h, (h % np.uint64(voc.shards)).astype(np.min_scalar_type(voc.shards)), text[~known_w], RARE, first, voc.shards)
                if not voc.limited:
                    pair = pair_hash(p[~both], w[~both])
                    yield from spread(pair, voc.shard(pair), text[~both], OTHER_PAIRS, first, voc.shards)

    return run


def _answers(shared):
    """Of a shard's blocks and its part of the model: for each block the places
    of its texts that get something, and what. Blocks stay blocks, so their
    number does not grow with texts times shards."""

    def run(blocks: pa.Table, model: pa.Table) -> pa.Table:
        voc: Vocabulary = shared.value
        unigram, _ = voc.unigrams()
        trie, rare, others = None, None, None
        for kind, data in zip(model["kind"].to_pylist(), model["data"].to_pylist()):
            if kind == 0:
                trie = Trie(data)
            elif kind == 1:
                h, c, rest = unframed(data)
                rare = unpacked(h, np.uint64, True), unpacked(c, np.uint32), unpacked(rest, np.uint16)
            else:
                pairs, adds = unframed(data)
                others = unpacked(pairs, np.uint64, True), unpacked(adds, np.float32)
        out = []
        for kind, first, a, b in zip(*(blocks[c].to_pylist() for c in ("kind", "first", "a", "b"))):
            if kind == TEXTS:
                out.append((first, kind, a, b))
                continue
            key, text = unpacked(a, np.uint64, True), unpacked(b, np.uint16).astype(np.int64)
            n = int(text.max()) + 1
            if kind == PAIRS:
                if trie is None:
                    continue
                context, word = (key >> np.uint64(WORD)).astype(np.int64), (key & np.uint64((1 << WORD) - 1)).astype(np.int64)
                p = trie.lookup(context, word)
                on = p > 0
                add = np.log10(1 + p[on] / (restored(voc.rest[context[on]]) * unigram[word[on]]))
                t = np.flatnonzero(np.bincount(text[on], minlength=n))
                values = np.bincount(text[on], add, n)[t].astype(np.float32)
            elif kind == OTHER_PAIRS:
                if others is None or not len(others[0]):
                    continue
                i = np.minimum(np.searchsorted(others[0], key), len(others[0]) - 1)
                on = others[0][i] == key
                t = np.flatnonzero(np.bincount(text[on], minlength=n))
                values = np.bincount(text[on], others[1][i[on]], n)[t].astype(np.float32)
            else:
                count, rest = np.zeros(len(key), np.int64), np.zeros(len(key), np.uint16)
                if rare is not None and len(rare[0]):
                    i = np.minimum(np.searchsorted(rare[0], key), len(rare[0]) - 1)
                    on = rare[0][i] == key
                    count, rest = np.where(on, rare[1][i], 0), np.where(on, rare[2][i], 0)
                t = np.flatnonzero(np.bincount(text, minlength=n))
                # as a word, and as the context of the word that follows
                own = np.zeros(len(key)) if voc.limited else np.log10(np.maximum(count, 1) / (voc.tokens + 1)) + np.log10(restored(rest))
                values = np.concatenate([np.bincount(text, count > 0, n)[t], np.bincount(text, voc.base(count), n)[t], np.bincount(text, own, n)[t]])
            out.append((first, kind, packed(t.astype(np.uint16)), packed(values)))
        columns = list(zip(*out)) or [()] * 4
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("first", "kind", "a", "b"), columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))})

    return run


def _sums(group: pa.Table) -> pa.Table:
    """The texts of one fold with everything that the shards said about them."""
    rows = sorted(zip(*(group[c].to_pylist() for c in ("kind", "a", "b"))))
    _, a, b = rows[0]  # the texts themselves
    sums = np.frombuffer(a, "<f8").reshape(4, -1).copy()
    n = sums.shape[1]
    for kind, a, b in rows[1:]:
        t = unpacked(a, np.uint16)
        if kind == RARE:
            sums[1:, t] += unpacked(b, np.float64).reshape(3, -1)
        else:
            sums[3, t] += unpacked(b, np.float32)
    b = rows[0][2]
    own, none = np.frombuffer(b, np.int64, n), np.frombuffer(b, bool, n, 8 * n)
    return pa.table({
        "doc_id": pa.array(own, pa.int64(), mask=none), "n": pa.array(sums[0].astype(np.int64)), "known": pa.array(sums[1].astype(np.int64)),
        "base": pa.array(sums[2]), "score": pa.array(sums[3]),
    })


def score(docs: DataFrame, voc: Vocabulary, model: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(voc)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    blocks = rows.mapInArrow(_questions(shared), "shard int, kind int, first bigint, a binary, b binary")
    got = (
        blocks.repartition(voc.shards, "shard").groupBy("shard").cogroup(model.repartition(voc.shards, "shard").groupBy("shard"))
        .applyInArrow(_answers(shared), "first bigint, kind int, a binary, b binary")
    )
    sums = got.groupBy("first").applyInArrow(_sums, "doc_id bigint, n bigint, known bigint, base double, score double")
    return sums.select(
        "doc_id", F.col("n").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(voc.tokens).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )
