"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galespark.session import cut


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of bigint vertices -> ``(id, root)`` for every vertex of an
    edge; ``root`` is the smallest vertex of its component.

    In each round every vertex hooks onto its least neighbour (or itself), each
    hook is followed four steps up, and edges are rewritten by the result. A
    map x -> f(x) <= x inside a component keeps connectivity and leaves its
    smallest vertex alone, so the rounds end with one vertex per component.
    Minima fold in the map tasks; joins have plain tables on both sides, so the
    adaptive planner splits a vertex with very many neighbours.
    """
    ends = edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).filter("a <> b")
    left = cut(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("up")))
        for _ in range(2):
            higher = hook.select(F.col("id").alias("up"), F.col("up").alias("top"))
            hook = cut(hook.join(higher, "up").select("id", F.col("top").alias("up")))
        labels = (
            hook.select("id", F.col("up").alias("root")) if labels is None
            else cut(labels.join(hook.select(F.col("id").alias("root"), "up"), "root", "left").select("id", F.coalesce("up", "root").alias("root")))
        )
        low, high = (hook.select(F.col("id").alias(c), F.col("up").alias(f"{c}_up")) for c in "ab")
        moved = left.join(low, "a").join(high, "b").filter("a_up <> b_up")
        left = cut(moved.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct())
    return labels if labels is not None else left.select(F.col("a").alias("id"), F.col("b").alias("root"))
