"""Links between nearby points of one forecast step and of the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galespark.functions import geo

RUN = ["model_name", "init_time"]
SAME_STEP_DEG = 5.0
NEXT_STEP_DEG = 3.0
STEP_HOURS = 6


def nodes(points: DataFrame, order: str = "event_id") -> DataFrame:
    """One node per (run, step, position); of several points the last in
    ingest order stays. ``max_by`` folds repeats before the shuffle, and the
    order value of the winner serves as the node's id."""
    key = [*RUN, "time_step", "lat", "lon"]
    rest = [c for c in points.columns if c not in key]
    last = points.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return last.select(F.col(f"r.{order}").alias("node_id"), *key, *[f"r.{c}" for c in rest if c != order])


EDGE = 1e-6  # degrees by which a box is widened against rounding at the border of a cell


def _cells(deg: Column, offset: float, period: float, radius: float) -> tuple[Column, Column]:
    """Cell of a coordinate on a circle of ``period`` degrees, and the one or two
    cells that a box round it meets: a cell is as wide as a box at least."""
    if int(period // radius) < 3:
        raise ValueError("radius too large for the bucketed join")
    n = max(1, int(period // (2 * (radius + 2 * EDGE))))
    cell = lambda x: F.pmod(F.floor((x + offset) / (period / n)), F.lit(n))
    return cell(deg), F.array_distinct(F.array(cell(deg - (radius + EDGE)), cell(deg + (radius + EDGE))))


def within_box(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float) -> Column:
    return (geo.lat_gap(lat1, lat2) <= radius) & (geo.lon_gap(lon1, lon2) <= radius)


def box_join(left: DataFrame, right: DataFrame, on: list[str], radius: float) -> DataFrame:
    """Pairs (src, dst) of ``node_id`` whose positions lie within a box.

    An equi-join on the common keys and the cell: the left side looks into
    the cells that its box meets, four at most. Both coordinates are circular
    (latitude by a half turn), so the poles and the antimeridian need no special
    case. Nodes are distinct positions, which bounds what one cell can hold."""
    lat_cell, lat_cells = _cells(F.col("lat"), 90.0, 180.0, radius)
    lon_cell, lon_cells = _cells(F.col("lon"), 180.0, 360.0, radius)
    probe = (
        left.select(F.col("node_id").alias("src"), *on, F.col("lat").alias("lat1"), F.col("lon").alias("lon1"),
                    lat_cells.alias("us"), lon_cells.alias("vs"))
        .withColumn("u", F.explode("us")).withColumn("v", F.explode("vs")).drop("us", "vs")
    )
    build = right.select(F.col("node_id").alias("dst"), *on, "lat", "lon", lat_cell.alias("u"), lon_cell.alias("v"))
    hits = probe.join(build, [*on, "u", "v"])
    return hits.filter(within_box(F.col("lat1"), F.col("lon1"), F.col("lat"), F.col("lon"), radius))


def same_step(nodes_df: DataFrame, radius: float = SAME_STEP_DEG) -> DataFrame:
    """Undirected links of one step, each once, smaller id first."""
    pairs = box_join(nodes_df, nodes_df, [*RUN, "time_step"], radius)
    return pairs.filter(F.col("src") < F.col("dst")).select(*RUN, "time_step", "src", "dst")


def adjacent_steps(nodes_df: DataFrame, hours: int = STEP_HOURS) -> DataFrame:
    """Steps whose next existing step in the run comes exactly ``hours`` later."""
    steps = nodes_df.select(*RUN, "time_step").distinct()
    nxt = F.lead("time_step").over(Window.partitionBy(*RUN).orderBy("time_step"))
    return steps.withColumn("next_step", nxt).filter(F.col("next_step") - F.col("time_step") == hours)


def next_step(nodes_df: DataFrame, radius: float = NEXT_STEP_DEG, hours: int = STEP_HOURS) -> DataFrame:
    """Directed links to the step that follows."""
    steps = adjacent_steps(nodes_df, hours).select(*RUN, "time_step")
    early = nodes_df.join(steps, [*RUN, "time_step"], "left_semi").withColumn("time_step", F.col("time_step") + hours)
    return box_join(early, nodes_df, [*RUN, "time_step"], radius).select(
        *RUN, (F.col("time_step") - hours).alias("time_step"), "src", "dst"
    )


def radius_bins(nodes_df: DataFrame, radii: list[float]) -> DataFrame:
    """Same-step pairs with the list of radii whose box they meet."""
    pairs = box_join(nodes_df, nodes_df, [*RUN, "time_step"], max(radii)).filter(F.col("src") < F.col("dst"))
    gap = F.greatest(geo.lat_gap(F.col("lat1"), F.col("lat")), geo.lon_gap(F.col("lon1"), F.col("lon")))
    met = F.filter(F.array(*[F.lit(float(r)) for r in sorted(radii)]), lambda r: gap <= r)
    return pairs.select(*RUN, "time_step", "src", "dst", met.alias("radii"))
