"""Order-aware helpers for long sequences.

A sequence such as a satellite's path may hold a third of all rows, so no
window spans it whole. Rows fall into chunks of the order value; what must
cross a chunk's edge travels through one small row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(df: DataFrame, keys: list[str], order: str, columns: list[str], chunk: int) -> DataFrame:
    """Add ``prev``: the columns of the row before, NULL for the first row.

    The last row of each chunk is copied into the next chunk that exists and
    leaves again once its neighbour has read it."""
    payload = F.struct(order, *columns)
    rows = df.withColumn("chunk", F.floor(F.col(order) / chunk))
    edges = rows.groupBy(*keys, "chunk").agg(F.max_by(payload, order).alias("edge"))
    following = F.lead("chunk").over(Window.partitionBy(*keys).orderBy("chunk"))
    halo = edges.withColumn("chunk", following).filter(F.col("chunk").isNotNull())
    halo = halo.select(*keys, "chunk", F.col(f"edge.{order}").alias(order), "edge", F.lit(True).alias("is_halo"))
    both = rows.withColumns({"edge": payload, "is_halo": F.lit(False)}).unionByName(halo, allowMissingColumns=True)
    before = F.lag("edge").over(Window.partitionBy(*keys, "chunk").orderBy(order))
    return both.withColumn("prev", before).filter(~F.col("is_halo")).drop("is_halo", "edge", "chunk")


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str, chunk: int) -> DataFrame:
    """Cumulative sum in order, current row included."""
    rows = df.withColumn("chunk", F.floor(F.col(order) / chunk))
    totals = rows.groupBy(*keys, "chunk").agg(F.sum(value).alias("total"))
    before = F.sum("total").over(Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*keys, "chunk", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = F.sum(value).over(Window.partitionBy(*keys, "chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("inside", inside).join(offsets, [*keys, "chunk"]).withColumn(
        out, F.col("inside") + F.col("offset")
    ).drop("inside", "offset", "chunk")


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, out: str = "island") -> DataFrame:
    """Number stretches of rows; ``starts`` marks the first row of each. For
    groups that are small by nature, such as the minutes of one pass."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
