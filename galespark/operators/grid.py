"""Disturbance detection on gridded fields.

A field is laid out as strips: one row per grid latitude holding its values
as arrays along longitude. Cells shuffle once, by field; neighbours along a
latitude are array positions and neighbours across are the next rows. A
candidate's box is a few strips, each cut to length where it is read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galespark.functions import geo
from galespark.functions.geo import EARTH_RADIUS_M
from galespark.session import broadcast_if_small, cut
from galespark.sources.dims import basin_of

RUN = ["model_name", "init_time", "time_step"]
CELL = [*RUN, "x", "y"]
RAYS = 576


@dataclass(frozen=True)
class Grid:
    """Regular grid: size, first latitude, spacing in degrees (signed by row)."""

    rows: int
    cols: int
    lat0: float
    dlat: float
    dlon: float

    def cells(self, degrees: float) -> int:
        return int(round(degrees / abs(self.dlon)))


def derived(cells: DataFrame) -> DataFrame:
    """Thickness of each cell and the wind speeds of the levels that it has."""
    speed = lambda level: F.sqrt(F.col(f"u{level}") * F.col(f"u{level}") + F.col(f"v{level}") * F.col(f"v{level}"))
    levels = [x for x in ("", "925", "10") if f"u{x}" in cells.columns]
    return cells.withColumns({"thickness": F.col("gh250") - F.col("gh850")} | {f"wind{x}": speed(x) for x in levels})


def strips(cells: DataFrame, fields: list[str]) -> DataFrame:
    """One row per field and latitude. The strip is as long as the grid is
    wide, a fixed number, and all strips of a field stay in one partition."""
    rows = cells.repartition(*RUN).groupBy(*RUN, "x").agg(
        F.sort_array(F.collect_list(F.struct("y", *fields))).alias("r"), F.first("lat").alias("lat")
    )
    return rows.select(*RUN, "x", "lat", *[F.col(f"r.{f}").alias(f) for f in fields])


def _across(column: str, shift: int) -> Column:
    """Strip ``shift`` rows on, wrapping from the last row to the first."""
    w = Window.partitionBy(*RUN).orderBy("x")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    beyond = F.first(column) if shift > 0 else F.last(column)
    return F.coalesce(F.lag(column, -shift).over(w), beyond.over(every))


def local_minima(field: DataFrame, value: str = "mslp", edges: bool = True) -> DataFrame:
    """Cells equal to the lowest of their 3x3 neighbourhood, ties all kept.
    Neighbours wrap at the edges; ``edges=False`` leaves edge cells out."""
    f = field.withColumns({"above": _across(value, -1), "below": _across(value, 1), "n": F.size(value)})
    column_low = F.transform(value, lambda v, i: F.least(v, F.get("above", i), F.get("below", i)))
    f = f.withColumn("low", column_low)
    is_low = lambda y: F.get(value, y) <= F.least(
        F.get("low", F.pmod(y - 1, F.col("n"))), F.get("low", y), F.get("low", F.pmod(y + 1, F.col("n")))
    )
    ys = F.filter(F.sequence(F.lit(0), F.col("n") - 1), is_low)
    if not edges:
        w = Window.partitionBy(*RUN)
        f = f.withColumn("last_x", F.max("x").over(w)).filter((F.col("x") > 0) & (F.col("x") < F.col("last_x")))
        ys = F.filter(ys, lambda y: (y > 0) & (y < F.col("n") - 1))
    out = f.select(*RUN, "x", "lat", "lon", value, F.explode(ys).alias("y"))
    return out.select(*CELL, "lat", F.get("lon", F.col("y")).alias("lon"), F.get(value, F.col("y")).alias(value))


def _cut_strip(values: str, y: Column, r: Column) -> Column:
    """2r+1 values round position y; plain slice inside, modulo at the ends."""
    n = F.size(values)
    inside = (y >= r) & (y + r < n)
    wrapped = F.transform(F.sequence(-r, r), lambda k: F.get(values, F.pmod(y + k, n)))
    return F.when(inside, F.slice(values, y - r + 1, r * 2 + 1)).otherwise(wrapped)


def boxes(candidates: DataFrame, field: DataFrame, values: list[str], radius: int | str, rows: int) -> DataFrame:
    """Candidates joined to the strips of their box: 2r+1 rows each, every
    strip cut to the box. ``radius`` in cells may be a column."""
    r = F.lit(radius) if isinstance(radius, int) else F.col(radius)
    probe = candidates.withColumn("r", r.cast("int")).withColumn("dx", F.explode(F.sequence(-F.col("r"), F.col("r"))))
    probe = probe.withColumn("sx", F.pmod(F.col("x") + F.col("dx"), F.lit(rows)))
    near = field.select(*RUN, F.col("x").alias("sx"), *[F.col(v).alias(f"s_{v}") for v in values])
    # cells shrink so well in a shuffle that a broadcast of them looks cheaper than it is
    hit = probe.join(near.hint("merge"), [*RUN, "sx"])
    return hit.withColumns({f"s_{v}": _cut_strip(f"s_{v}", F.col("y"), F.col("r")) for v in values})


def box_extreme(
    candidates: DataFrame, field: DataFrame, value: str, out: str, radius: int | str, rows: int, by_hemisphere: bool = False
) -> DataFrame:
    """Largest value in a box round each candidate; with ``by_hemisphere`` the
    smallest south of the equator. Strips reduce to one number before they are
    grouped, so nothing is collected."""
    b = boxes(candidates.select(*CELL, "lat", *([radius] if isinstance(radius, str) else [])), field, [value], radius, rows)
    best = b.groupBy(*CELL).agg(
        F.max(F.array_max(f"s_{value}")).alias("hi"), F.min(F.array_min(f"s_{value}")).alias("lo"), F.first("lat").alias("lat_")
    )
    pick = F.when(F.col("lat_") < 0, F.col("lo")).otherwise(F.col("hi")) if by_hemisphere else F.col("hi")
    return candidates.join(best.select(*CELL, pick.alias(out)).hint("merge"), CELL, "left")


def box_values(candidates: DataFrame, field: DataFrame, value: str, radius: int, rows: int) -> DataFrame:
    """Candidates with their box as one flat array of (2r+1)^2 values."""
    b = boxes(candidates.select(*CELL), field, [value], radius, rows)
    rows_in_order = F.sort_array(F.collect_list(F.struct("dx", F.col(f"s_{value}").alias("v"))))
    flat = b.groupBy(*CELL).agg(F.flatten(rows_in_order["v"]).alias("box"))
    return candidates.join(flat.hint("merge"), CELL)


# ---------------------------------------------------------------- isobars


def _rise(boxes_: np.ndarray) -> np.ndarray:
    """Smallest rise over the centre that any path from it to a cell must cross.

    ``boxes_`` is (n, s, s). Paths grow along whole rows and columns: one pass
    goes down, up, right and left, each row handing its answer on to the next,
    so a path takes as many passes as it turns back, not as many as it has
    cells. Boxes that a pass does not change are done and left out of the next."""
    n, s, _ = boxes_.shape
    c = s // 2
    above = np.ascontiguousarray((boxes_ - boxes_[:, c, c][:, None, None]).transpose(1, 2, 0))  # boxes last
    rise = np.full((s, s, n), np.inf)
    rise[c, c] = 0.0
    out = np.empty((n, s, s))
    left = np.arange(n)
    down, up = range(1, s), range(s - 2, -1, -1)
    while len(left):
        before = rise.copy()
        for steps, back in ((down, -1), (up, 1)):
            for k in steps:
                np.minimum(rise[k], np.maximum(above[k], rise[k + back]), out=rise[k])
            for k in steps:
                np.minimum(rise[:, k], np.maximum(above[:, k], rise[:, k + back]), out=rise[:, k])
        on = (rise != before).any(axis=(0, 1))
        if not on.all():
            out[left[~on]] = rise[:, :, ~on].transpose(2, 0, 1)
            left, rise, above = left[on], rise[:, :, on], above[:, :, on]
    return out


def _barrier(rise: np.ndarray, ring: int) -> np.ndarray:
    """Lowest rise on the square ring ``ring`` cells in from the boundary."""
    a, b = ring, rise.shape[1] - 1 - ring
    sides = [rise[:, a, a : b + 1], rise[:, b, a : b + 1], rise[:, a : b + 1, a], rise[:, a : b + 1, b]]
    return np.min(np.concatenate(sides, axis=1), axis=1)


def _stack(box: pd.Series) -> np.ndarray:
    flat = np.stack(box.to_numpy())
    side = int(round(flat.shape[1] ** 0.5))
    return flat.reshape(len(flat), side, side).astype("float64")


@F.pandas_udf(T.DoubleType())
def barrier_to_edge(box: pd.Series) -> pd.Series:
    """Rise needed to leave the box: closed at t means this is t or more."""
    return pd.Series(_barrier(_rise(_stack(box)), 0))


@F.pandas_udf(T.DoubleType())
def barrier_to_inner_ring(box: pd.Series) -> pd.Series:
    """The same up to the ring next to the boundary."""
    return pd.Series(_barrier(_rise(_stack(box)), 1))


def closed_isobar(candidates: DataFrame, field: DataFrame, grid: Grid, threshold: float = 2.0, degrees: float = 5.0,
                  touching: bool = False, value: str = "mslp") -> DataFrame:
    """Candidates with a closed contour ``threshold`` above their centre inside
    the box: no path of lower cells reaches the boundary, or, with
    ``touching``, comes next to it."""
    b = box_values(candidates, field, value, grid.cells(degrees), grid.rows)
    barrier = (barrier_to_inner_ring if touching else barrier_to_edge)(F.col("box"))
    return b.withColumn("barrier", barrier).filter(F.col("barrier") >= threshold).drop("box", "barrier")


ROCI_TYPE = (
    T.StructType()
    .add("closed_isobar_delta", T.IntegerType())
    .add("roci", T.DoubleType())
    .add("roci_grid_units", T.DoubleType())
    .add("mass_x", T.IntegerType())
    .add("mass_y", T.IntegerType())
)


def _ray_offsets(radius: int) -> np.ndarray:
    """Cell offsets (step, ray, 2) visited along each ray from the box centre."""
    angle = 2 * np.pi / RAYS * np.arange(RAYS)
    unit = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    steps = np.concatenate([np.full((1, RAYS, 2), float(radius)), np.repeat(unit[None], 2 * radius + 2, axis=0)])
    return np.cumsum(steps, axis=0)[1:]


def _leg_lengths(fill: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps each ray stays inside the filled area and the last cell reached."""
    side = fill.shape[1]
    cells = points.astype(int)
    inside = ((points > -1) & (cells >= 0) & (cells < side)).all(axis=2)
    safe = np.clip(cells, 0, side - 1)
    on = fill[:, safe[..., 0], safe[..., 1]] & inside[None]
    legs = np.cumprod(on, axis=1).sum(axis=1)
    centre = np.full((1, RAYS, 2), side // 2)
    path = np.concatenate([centre, cells])
    return legs, path[legs, np.arange(RAYS)[None, :]]


def roci_function(grid: Grid, radius: int):
    """Arrow function: box and cell -> outermost closed isobar and its radius."""
    points = _ray_offsets(radius)

    @F.pandas_udf(ROCI_TYPE)
    def outermost(box: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        parts = [_outermost(_stack(box[i : i + 256]), x.to_numpy()[i : i + 256], y.to_numpy()[i : i + 256], grid, points)
                 for i in range(0, len(box), 256)]
        return pd.concat(parts, ignore_index=True)

    return outermost


def _outermost(box: np.ndarray, x: np.ndarray, y: np.ndarray, grid: Grid, points: np.ndarray) -> pd.DataFrame:
    rise = _rise(box)
    c = box.shape[1] // 2
    delta = np.floor(_barrier(rise, 1))
    core = rise < 1.0
    weight = core.sum(axis=(1, 2))
    axis = np.arange(box.shape[1])
    mean_x = (core.sum(axis=2) * axis).sum(axis=1) / weight
    mean_y = (core.sum(axis=1) * axis).sum(axis=1) / weight
    mass_x = (x + np.round(mean_x).astype(int) - c) % grid.rows
    mass_y = (y + np.round(mean_y).astype(int) - c) % grid.cols
    legs, ends = _leg_lengths(rise < delta[:, None, None], points)
    end_x = (mass_x[:, None] + ends[..., 0] - c) % grid.rows
    end_y = (mass_y[:, None] + ends[..., 1] - c) % grid.cols
    lat1 = np.radians(grid.lat0 + grid.dlat * mass_x)[:, None]
    lat2 = np.radians(grid.lat0 + grid.dlat * end_x)
    dlon = np.radians((end_y - mass_y[:, None]) * grid.dlon)
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin(dlon / 2) ** 2
    metres = 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))
    out = pd.DataFrame(
        {"closed_isobar_delta": pd.array(delta.astype(int), dtype="Int32"), "roci": metres.mean(axis=1),
         "roci_grid_units": legs.mean(axis=1), "mass_x": mass_x.astype("int32"), "mass_y": mass_y.astype("int32")}
    )
    # nothing is closed at the first threshold: no radius
    out.loc[delta < 2, ["closed_isobar_delta", "roci", "roci_grid_units"]] = None
    return out


def radius_of_closed_isobar(candidates: DataFrame, field: DataFrame, grid: Grid, degrees: float = 15.0, value: str = "mslp") -> DataFrame:
    """Outermost whole-number closed isobar, mean radius along rays, centre of
    the innermost filled area."""
    r = grid.cells(degrees)
    b = box_values(candidates, field, value, r, grid.rows)
    out = b.withColumn("o", roci_function(grid, r)("box", "x", "y")).drop("box")
    return out.select(*[c for c in out.columns if c != "o"], "o.*")


# ---------------------------------------------------------------- fields and rules


def vorticity(field: DataFrame, grid: Grid, u: str = "u", v: str = "v") -> DataFrame:
    """Relative vorticity strips: dv/dx - du/dy, centred inside and one-sided
    of second order at the edges, with the spacing of each row."""
    w = Window.partitionBy(*RUN).orderBy("x")
    f = field.withColumns({f"u{k}": F.lag(u, -k).over(w) for k in (-2, -1, 1, 2)})
    dy = F.lit(EARTH_RADIUS_M * np.radians(abs(grid.dlat)))
    dx = F.lit(EARTH_RADIUS_M * np.radians(abs(grid.dlon))) * F.cos(F.radians("lat"))
    # one row on is one step in the sign of dlat
    sign = F.lit(1.0 if grid.dlat > 0 else -1.0)
    one_sided = lambda a, b, c: F.zip_with(F.zip_with(a, b, lambda p, q: p * -3 + q * 4), c, lambda s, r: s - r)
    du = (
        F.when(F.col("u-1").isNull(), one_sided(u, F.col("u1"), F.col("u2")))
        .when(F.col("u1").isNull(), F.transform(one_sided(u, F.col("u-1"), F.col("u-2")), lambda d: -d))
        .otherwise(F.zip_with("u1", "u-1", lambda b, a: b - a))
    )
    n = F.size(v)
    g = lambda i: F.get(v, i)
    dv = F.transform(
        v,
        lambda c, i: F.when(i == 0, c * -3 + g(i + 1) * 4 - g(i + 2))
        .when(i == n - 1, c * 3 - g(i - 1) * 4 + g(F.greatest(i - 2, F.lit(0))))
        .otherwise(g(F.least(i + 1, n - 1)) - g(F.greatest(i - 1, F.lit(0)))),
    )
    curl = F.zip_with(dv, du, lambda a, b: a / (dx * 2) - b * sign / (dy * 2))
    ok = F.cos(F.radians("lat")) > 1e-9
    return f.withColumn("vort", F.when(ok, curl)).drop("u-2", "u-1", "u1", "u2")


def assign_basin(candidates: DataFrame) -> DataFrame:
    """Basin of each candidate; candidates outside every basin drop out."""
    return candidates.withColumn("basin", basin_of(F.col("lat"), F.col("lon"))).filter(F.col("basin").isNotNull())


def threshold_flags(candidates: DataFrame, limits: DataFrame) -> DataFrame:
    """Criteria map by the thresholds of model and basin, NULL where there are
    none; the vorticity limit is in 1e-5/s and turns its sign south of the equator."""
    c = candidates.join(broadcast_if_small(limits.withColumn("known", F.lit(True)), 1000), ["model_name", "basin"], "left")
    sign = F.when(F.col("lat") < 0, -1.0).otherwise(1.0)
    met = {
        "vmax925": F.col("vmax925") >= F.col("ws"),
        "rv850max": F.col("rv850max") * sign >= F.col("rv") * 1e-5,
        "gp250_850_thickness": F.col("gp250_850_thickness") >= F.col("thkn"),
    }
    pairs = F.create_map(*[e for k, b in met.items() for e in (F.lit(k), F.coalesce(b, F.lit(False)))])
    c = c.withColumn("criteria", pairs)
    whole = F.forall(F.map_values("criteria"), lambda b: b)
    every = F.map_concat("criteria", F.create_map(F.lit("all"), whole))
    return c.withColumn("criteria", F.when(F.col("known"), every)).drop("ws", "rv", "thkn", "known")


def detect(cells: DataFrame, grid: Grid, limits: DataFrame) -> DataFrame:
    """Disturbances of every field, cheap tests first.

    ``cells`` carries mslp, gh250, gh850 and the winds u, v at 850 hPa, u925,
    v925 and u10, v10, and the vorticity vort850 where the files have it."""
    if gone := {"mslp", "gh250", "gh850", "u", "v", "u925", "v925", "u10", "v10"} - set(cells.columns):
        raise ValueError(f"fields missing from the grid: {', '.join(sorted(gone))}")
    given = ["vort850"] if "vort850" in cells.columns else []
    # strips are written once; each stage reads back only the columns it needs
    field = cut(strips(derived(cells), ["lon", "mslp", "u", "v", "thickness", "wind925", "wind10", *given]))
    found = cut(closed_isobar(assign_basin(local_minima(field)), field, grid))
    spin = field.withColumnRenamed("vort850", "vort") if given else vorticity(field, grid)
    found = box_extreme(found, spin, "vort", "rv850max", grid.cells(2), grid.rows, by_hemisphere=True)
    found = box_extreme(found, field, "thickness", "gp250_850_thickness", grid.cells(2), grid.rows)
    found = box_extreme(found, field, "wind925", "vmax925", grid.cells(5), grid.rows)
    # candidates of a model or basin without thresholds have no criteria to meet
    found = threshold_flags(found, limits).filter(F.coalesce(F.col("criteria")["all"], F.lit(False)))
    found = radius_of_closed_isobar(found, field, grid)
    found = found.withColumn("r10", F.bround("roci_grid_units").cast("int"))
    return box_extreme(found, field, "wind10", "vmax10m_in_roci", "r10", grid.rows).drop("r10")
