"""SimHash near-duplicates with a hierarchical index in Gray order.

Fingerprints: 64 majority bits over the XXH64 of all 4-word shingles. Equal
fingerprints fold into one before any search. Two fingerprints within d bits
agree on one of d + 1 bit blocks, so the top nodes of the index are shared
masked patterns (mask, bits): a fingerprint belongs to d + 1 of them. A node
with more than ``MAX_NODE`` fingerprints is replaced by its d + 1 children,
each fixing one block of the bits still free, until all are small; nothing is
capped. Inside a node fingerprints are sorted by Gray rank, runs of 16 form the
next level, and every level keeps only the pattern bits that its parents had
not fixed. A search adds up differences on the way down, drops whole groups
beyond d, and takes whole groups whose free bits cannot exceed d. Each task
returns a spanning forest of the links it found, never all pairs.

Defined results: null and empty texts have fingerprint zero and link like any
other; fewer than four words are one shingle; repeated rows share a component;
a null identifier never names a component unless it has no other; an empty
table gives an empty result; further columns are ignored (``near_duplicates``)
or kept, whatever their names (``keep_one``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from galespark.llm.components import components
from galespark.llm.names import free, quoted, widened
from galespark.session import cut

SHINGLE, SEED, DISTANCE, MAX_NODE, FAN = 4, 42, 4, 4096, 16
BROADCAST_ROWS = 200_000
BATCH = 65_536  # fingerprints searched at a time
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and \x09-\x0D \x20 only
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = max(1, len(words) - k + 1)
    ends = end[k - 1 :] if len(words) >= k else end[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 32_768):  # bounded memory for very long texts
        pairs = zip(start[at : min(n, at + 32_768)].tolist(), ends[at : at + 32_768].tolist())
        h = np.array([digest(joined[i:j], SEED) for i, j in pairs], ">u8")
        ones += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _levels(code: np.ndarray, bucket: np.ndarray) -> list[tuple]:
    """Index levels from the leaves up, as (first leaf, end leaf, pattern, fixed, first child, end child)."""
    n = len(code)
    place = np.arange(n)
    new = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    place -= np.repeat(new, np.diff(np.r_[new, n]))
    levels = [(np.arange(n), np.arange(1, n + 1), code, np.full(n, ONES), np.arange(n), np.arange(1, n + 1))]
    span = 1
    while True:
        span *= FAN
        starts = np.flatnonzero(place % span == 0)
        ends = np.r_[starts[1:], n]
        both, either = np.bitwise_and.reduceat(code, starts), np.bitwise_or.reduceat(code, starts)
        below = levels[-1][0]
        levels.append((starts, ends, both, both | ~either, np.searchsorted(below, starts), np.searchsorted(below, ends)))
        if len(starts) == len(new):
            return levels


def links(code: np.ndarray, bucket: np.ndarray, distance: int = DISTANCE, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (sorted input) whose unions give every link of at most ``distance`` bits inside a bucket."""
    levels = _levels(code, bucket)
    top = levels[-1]
    root = np.searchsorted(top[0], np.arange(len(code)), side="right") - 1
    out_a, out_b = [], []
    for at in range(0, len(code), chunk):
        q = np.arange(at, min(at + chunk, len(code)))
        node, acc, known = root[q], np.zeros(len(q), np.int64), np.zeros(len(q), np.uint64)
        for depth in range(len(levels) - 1, -1, -1):
            first, end, pattern, fixed, kid, kid_end = levels[depth]
            rest = fixed[node] & ~known  # bits that this level fixes and those above did not
            acc = acc + np.bitwise_count((code[q] ^ pattern[node]) & rest)
            on = (acc <= distance) & (end[node] > q + 1)
            q, node, acc = q[on], node[on], acc[on]
            whole = acc + np.bitwise_count(~fixed[node]) <= distance
            if whole.any():  # everything below is linked to q and to each other
                a, g = q[whole], node[whole]
                lead = np.maximum(first[g], a + 1)
                out_a.append(a)
                out_b.append(lead)
                g = np.unique(g)
                size = end[g] - first[g]
                out_b.append(np.repeat(first[g], size))
                out_a.append(np.repeat(first[g] - np.cumsum(size) + size, size) + np.arange(size.sum()))
                q, node, acc = q[~whole], node[~whole], acc[~whole]
            if depth == 0 or not len(q):
                break
            known = fixed[node]
            width = kid_end[node] - kid[node]
            pick = np.repeat(np.arange(len(q)), width)
            node = np.repeat(kid[node] - np.cumsum(width) + width, width) + np.arange(width.sum())
            q, acc, known = q[pick], acc[pick], known[pick]
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, np.int64),) * 2


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place reachable from each place."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            return label


def _search(mask: np.ndarray, bits: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    code = fp.view(np.uint64)
    order = np.lexsort((gray_rank(code), bits, mask))
    mask, bits, code = mask[order], bits[order], code[order]
    bucket = np.cumsum(np.r_[0, (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])])
    label = forest(len(code), *links(code, bucket))
    far = np.flatnonzero(label != np.arange(len(code)))
    ends = [pa.array(code[x].view(np.int64)) for x in (far, label[far])]
    return pa.RecordBatch.from_arrays(ends, names=["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Search sorted rows (mask, bits, fp); a bucket is never cut between two searches."""
    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        held = [np.r_[h, c.to_numpy(zero_copy_only=False)] for h, c in zip(held, batch.columns)]
        if len(held[0]) >= BATCH:
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            cut_at = len(last) - int(last.sum())
            if cut_at:
                yield _search(*(h[:cut_at] for h in held))
                held = [h[cut_at:] for h in held]
    if len(held[0]):
        yield _search(*held)


def _blocks(free: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` nearly equal blocks of the free bits."""
    return [sum(1 << b for b in free[len(free) * i // parts : len(free) * (i + 1) // parts]) for i in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def link_edges(codes: DataFrame, distance: int = DISTANCE, max_node: int = MAX_NODE) -> DataFrame:
    """Spanning edges (a, b) of all links between the distinct ``codes(fp)``."""
    spark = codes.sparkSession
    edges, masks = [], [0]
    if max_node < 1 << distance:
        raise ValueError("nodes with no more than `distance` free bits are taken whole and cannot be split")
    rows = codes.select("fp")
    while True:
        kids = [
            (_signed(m), _signed(m | block))
            for m in masks for block in _blocks([b for b in range(64) if not m >> b & 1], distance + 1) if block
        ]
        if masks == [0]:
            wider = rows.withColumn("deeper", F.explode(F.array(*(F.lit(k) for _, k in kids))))
        else:
            fixed = spark.createDataFrame(kids, "mask bigint, deeper bigint")  # a row per mask and block, not per node
            wider = rows.join(F.broadcast(fixed), "mask")
        rows = wider.select(
            F.col("deeper").alias("mask"), F.col("fp").bitwiseAND(F.col("deeper")).alias("bits"), "fp"
        ).distinct()
        large = cut(rows.groupBy("mask", "bits").count().filter(F.col("count") > max_node).select("mask", "bits"))
        n = large.count()
        hint = F.broadcast(large) if n <= BROADCAST_ROWS else large
        small = rows.join(hint, ["mask", "bits"], "left_anti") if n else rows
        parts = small.repartition("mask", "bits").sortWithinPartitions("mask", "bits")
        edges.append(cut(parts.select("mask", "bits", "fp").mapInArrow(_linked, "a bigint, b bigint")))
        if not n:
            break
        rows = cut(rows.join(hint, ["mask", "bits"], "left_semi").select("fp", "mask"))
        masks = [r.mask % (1 << 64) for r in large.select("mask").distinct().collect()]
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, max_node: int = MAX_NODE) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id."""
    prints = cut(fingerprints(docs))
    codes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    label = components(link_edges(codes.select("fp"), distance, max_node))
    rooted = codes.join(label.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = cut(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")))
    of_code = cut(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"))
    return prints.join(of_code, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of linked fingerprints, all columns: the one with
    the smallest identifier (a row without one only where none has), of rows
    that share it the first in the order they were written down in."""
    fp, at = free(docs.columns, "fp", "at")
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = np.array([fingerprint(t.as_py()) for t in b.column(text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code, pa.int64())], names=[f"c{i}" for i in range(b.num_columns + 1)])

    rows = cut(widened(docs, run, [StructField(fp, LongType())]).withColumn(at, F.monotonically_increasing_id()))  # written, so places are fixed
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id").cast("bigint"), F.col(at))
    codes = cut(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(place).alias("least")))
    label = components(link_edges(codes.select("fp")))
    rooted = codes.join(label.withColumnRenamed("id", "fp"), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"))
    stay = rooted.agg(F.min("least").alias("least")).select(F.col(f"least.{at}").alias(at))
    drop = cut(rows.select(at).join(stay, at, "left_anti"))
    hint = F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop
    return rows.join(hint, at, "left_anti").select(*quoted(docs))
