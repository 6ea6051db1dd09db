"""Connected components: forests in the map tasks, then one task or contraction.

A task folds the links it sees to a spanning forest, which has fewer links than
vertices however many links came in. Where few enough are left (counted), one
task finishes them; otherwise the graph is contracted: every vertex hooks onto
the neighbour of least rank, ranks being hashes, so that long chains of rising
identifiers fall apart into many short hooks, and links are rewritten and folded
again. Expected rounds grow with the logarithm of the largest component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galespark.session import cut

ONE_TASK = 1 << 20  # links that one task may finish


def least_of_each(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest vertex of the component of each of ``n`` vertices."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:  # every label points at or below itself
            up = label[label]
            if (up == label).all():
                break
            label = up


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of links that keep all components together, without a cycle."""
    chosen, label, left = [], np.arange(n), np.arange(len(a))
    while True:
        la, lb = label[a[left]], label[b[left]]
        left, la, lb = (x[la != lb] for x in (left, la, lb))
        if not len(left):
            return np.concatenate([np.zeros(0, np.int64), *chosen])
        # each component hooks onto one smaller neighbour, by the first link that leads there
        high, low = np.maximum(la, lb), np.minimum(la, lb)
        order = np.lexsort((low, high))
        first = order[np.append(True, high[order][1:] != high[order][:-1])]
        chosen.append(left[first])
        label = least_of_each(n, np.concatenate([np.arange(n), high[first]]), np.concatenate([label, low[first]]))


def places(values: pa.Array, column: pa.ChunkedArray) -> np.ndarray:
    """Where each entry stands among ``values``; -1 where it does not."""
    return pc.index_in(column, values).fill_null(-1).to_numpy().astype(np.int64)


def distinct(*columns: pa.ChunkedArray) -> pa.Array:
    """The values of some columns, each once, in rising order."""
    values = pc.unique(pa.chunked_array([c for col in columns for c in col.chunks], columns[0].type))
    return values.take(pc.array_sort_indices(values))


def _numbered(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    values = distinct(*columns)
    return values, [places(values, c) for c in columns]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0

    def fold() -> pa.RecordBatch | None:
        table = pa.Table.from_batches(held)
        values, (a, b) = _numbered(table["src"], table["dst"])
        kept = table.take(pa.array(spanning_forest(len(values), a, b))).combine_chunks()
        return kept.to_batches()[0] if kept.num_rows else None

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= ONE_TASK:
            kept = fold()
            held, size = ([kept], kept.num_rows) if kept is not None else ([], 0)
            if size > ONE_TASK // 2:  # a forest of that many vertices goes out as it is
                yield kept
                held, size = [], 0
    if held and (kept := fold()) is not None:
        yield kept


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        values, (a, b) = _numbered(table["src"], table["dst"])
        root = least_of_each(len(values), a, b)
        yield pa.RecordBatch.from_arrays([values, values.take(pa.array(root))], names=["id", "up"])


def forest(edges: DataFrame) -> DataFrame:
    """Fewer links with the same components: each task's spanning forest. Other columns stay."""
    return edges.filter("src <> dst").mapInArrow(_forest, edges.schema)


def components(vertices: DataFrame, edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(id, label): label is the smallest id of the weakly connected component."""
    left = cut(forest(edges.select("src", "dst")))
    kind = vertices.schema["id"].dataType.simpleString()
    place = vertices.select("id").distinct().withColumn("up", F.col("id"))
    while True:
        n = left.count()
        if n <= one_task:
            last = left.repartition(1).mapInArrow(_finish, f"id {kind}, up {kind}") if n else None
            break
        both = left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("rank"), F.col(c).alias("id"))
        hook = both.groupBy("src").agg(F.least(rank("src"), F.min(rank("dst"))).alias("m"))
        hook = cut(hook.select(F.col("src").alias("id"), F.col("m.id").alias("up")))
        place = cut(_moved(place, "up", hook))
        left = cut(forest(_moved(_moved(left, "src", hook), "dst", hook)))
    if last is not None:
        place = _moved(place, "up", last)
    place = cut(place)
    least = place.groupBy("up").agg(F.min("id").alias("label"))
    return place.join(least, "up").select("id", "label")


def _moved(df: DataFrame, column: str, hook: DataFrame) -> DataFrame:
    """``column`` followed one step up, where there is one."""
    to = hook.select(F.col("id").alias(column), F.col("up").alias("__up"))
    return df.join(to, column, "left").withColumn(column, F.coalesce("__up", column)).drop("__up").select(*df.columns)
