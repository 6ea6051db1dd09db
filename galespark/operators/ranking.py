"""Exact ranks and quantiles per group without a task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galespark.session import cut

ROW_BITS = 33


def ranked(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with their 0-based ``rank`` in the group and the group's size ``n``.

    Range partitions hold the rows in order, however large one group is. Each
    row knows its place in its partition; the few (group, partition) counts
    give the offset where the group goes on in the next partition."""
    spot = F.monotonically_increasing_id()
    rows = cut(
        # the hash splits equal values of a group between range partitions
        df.withColumn("tie", F.xxhash64(*df.columns, F.rand(7)))
        .repartitionByRange(*keys, *order, "tie").sortWithinPartitions(*keys, *order, "tie").drop("tie")
        .withColumns({"part": F.shiftright(spot, ROW_BITS), "place": spot.bitwiseAND(F.lit((1 << ROW_BITS) - 1))})
    )
    pieces = rows.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("here"), F.min("place").alias("first_place"))
    w = Window.partitionBy(*keys)
    before = F.sum("here").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumns({"before": F.coalesce(before, F.lit(0)), "n": F.sum("here").over(w)})
    out = rows.join(pieces.drop("here"), [*keys, "part"])
    return out.withColumn("rank", F.col("before") + F.col("place") - F.col("first_place")).drop(
        "part", "place", "before", "first_place"
    )


def quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation between neighbours."""
    r = ranked(df.filter(F.col(value).isNotNull()).select(*keys, value), keys, [value])
    aggs = []
    for name, q in at.items():
        pos = F.lit(q) * (F.col("n") - 1)
        low = F.floor(pos)
        share = F.when(F.col("rank") == low, F.lit(1.0) - (pos - low)).when(F.col("rank") == low + 1, pos - low)
        aggs.append(F.sum(F.col(value) * share).alias(name))
    return r.groupBy(*keys).agg(*aggs)
