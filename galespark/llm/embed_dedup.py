"""Near-duplicates of embeddings by random-hyperplane hashing.

Equal vectors fold into one class first. Every class is hashed into several
tables by the signs of its products with random hyperplanes; classes that meet
in a bucket are compared exactly, in double precision, block by block. A pair
that meets in several tables counts in the first one only, and a bucket returns
link counts and a spanning forest instead of pairs. A bucket with more than
``BLOCK`` classes is cut into blocks and every pair of blocks is a group of its
own, so no group is ever larger than two blocks and none is capped.

The number of hyperplanes grows with the logarithm of the number of classes, so
that buckets keep their size, and the number of tables follows from it: a pair
at the threshold is missed with probability ``MISS`` at most, closer pairs far
less often.

Defined results: null, empty and zero vectors and those with null or non-finite
components link with nothing; vectors of different length never link; repeated
rows count as vectors of their own; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galespark.llm.components import components
from galespark.llm.simhash import forest
from galespark.session import cut

THRESHOLD, MISS, SEED = 0.9, 1e-3, 17
BLOCK, FILL = 2048, 256  # classes in a block; classes wanted in a bucket
BROADCAST_ROWS = 200_000


def plan_tables(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(hyperplanes per table, tables) for n classes."""
    bits = min(30, max(8, math.ceil(math.log2(max(n, 1) / FILL))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


@functools.lru_cache(maxsize=4)
def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, bits]).standard_normal((dim, bits * tables))


def _hash(bits: int, tables: int):
    """(id, weight, embedding) -> a row per table: table, bucket, dim, id, weight, all buckets, vector."""
    powers = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                vectors = [np.asarray(v.as_py(), np.float64) for v in b.column(2)]
                sig = np.empty((len(vectors), tables), np.int32)
                for dim in {len(v) for v in vectors}:
                    rows = [i for i, v in enumerate(vectors) if len(v) == dim]
                    sign = np.stack([vectors[i] for i in rows]) @ _planes(dim, bits, tables) > 0
                    sig[rows] = (sign.reshape(-1, tables, bits) * powers).sum(axis=2)
                n = len(vectors)
                each = pa.array(np.tile(np.arange(n), tables))
                names = ["tab", "bucket", "dim", "id", "weight", "sig", "vec"]
                single = [v.astype(np.float32) for v in vectors]
                packed = [(s if (s == v).all() else v).tobytes() for s, v in zip(single, vectors)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.arange(tables, dtype=np.int32), n)), pa.array(sig.T.ravel()),
                    pa.array([len(v) for v in vectors], pa.int32()).take(each), b.column(0).take(each), b.column(1).take(each),
                    pa.array([x.tobytes() for x in sig], pa.binary()).take(each), pa.array(packed, pa.binary()).take(each),
                ], names=names)

    return run


def _vector(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * dim else np.float64).astype(np.float64)


def _compare(group: pa.Table, threshold: float) -> pa.RecordBatch | None:
    """Links inside a block, or between the two blocks of a pair."""
    tab, dim = group["tab"][0].as_py(), group["dim"][0].as_py()
    ids, weight, block = (group[c].to_numpy() for c in ("id", "weight", "block"))
    x = np.stack([_vector(v.as_py(), dim) for v in group["vec"]])
    sig = np.stack([np.frombuffer(s.as_py(), np.int32) for s in group["sig"]])[:, :tab]
    norm = np.sqrt((x * x).sum(axis=1))
    low, high = group["low"][0].as_py(), group["high"][0].as_py()
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for at in range(0, len(left), 128):
        l = left[at : at + 128]
        near = x[l] @ x[right].T / (norm[l][:, None] * norm[right][None, :]) >= threshold
        if low == high:
            near &= l[:, None] < right[None, :]
        a, b = np.nonzero(near)
        if not len(a):
            continue
        a, b = l[a], right[b]
        label = forest(len(ids), np.r_[a, np.arange(len(ids))], np.r_[b, label])
        first = np.ones(len(a), bool)
        for t in range(tab):  # met before in an earlier table
            first &= sig[a, t] != sig[b, t]
        a, b = a[first], b[first]
        links += np.bincount(a, weight[b], len(ids)).astype(np.int64) + np.bincount(b, weight[a], len(ids)).astype(np.int64)
    on = np.flatnonzero((links > 0) | (label != np.arange(len(ids))))
    if not len(on):
        return None
    return pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(ids[label[on]]), pa.array(links[on])], names=["a", "b", "links"])


def _search(threshold: float):
    keys = ["tab", "bucket", "dim", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)])
            k = np.stack([held[c].to_numpy() for c in keys])
            starts = np.flatnonzero(np.r_[True, (k[:, 1:] != k[:, :-1]).any(axis=0)]) if len(held) else []
            for i, j in zip(starts[:-1], starts[1:]):
                if j - i > 1 and (out := _compare(held.slice(i, j - i), threshold)):
                    yield out
            held = held.slice(starts[-1]) if len(starts) else None
        if held is not None and len(held) > 1 and (out := _compare(held, threshold)):
            yield out

    return run


def usable(v) -> F.Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("bigint"), "embedding")
    good = rows.filter(usable(F.col("embedding")))
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("weight"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    bits, tables = plan_tables(classes.count(), threshold)
    hashed = classes.select("id", "weight", "embedding").mapInArrow(
        _hash(bits, tables), "tab int, bucket int, dim int, id bigint, weight bigint, sig binary, vec binary"
    )
    keys = ["tab", "bucket", "dim"]
    large = cut(
        hashed.groupBy(*keys).count().filter(F.col("count") > block)
        .select(*keys, F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    )
    hint = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    blocked = hashed.join(hint, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    blocked = blocked.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        *keys, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "weight", "sig", "vec"
    )
    order = [*keys, "low", "high"]
    found = cut(blocked.repartition(*order).sortWithinPartitions(*order).mapInArrow(_search(threshold), "a bigint, b bigint, links bigint"))
    links = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    label = components(found.select("a", "b"))
    rooted = classes.select("id", "least_id").join(label, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = cut(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")))
    facts = cut(
        classes.join(rooted.select("id", "root"), "id").join(named, "root").join(links, "id", "left")
        .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    )
    out = good.join(facts, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable(F.col("embedding"))).select("vec_id", F.lit(0).cast("bigint"), F.col("vec_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
