"""Regions from a table of polygons: the first that covers a point.

A layer is cut into a tree of cells: tiles of ``TILE`` degrees, each split by
``SPLIT`` as long as an edge runs through it, ``LEVELS`` deep. A leaf lists the
regions that cover or cut it. Edges are rows all the way, no ring is held as a
whole; only the edges round a leaf meet there, in pieces of about ``PIECE``: of
edges wholly to the east a ray's crossings depend on the latitude alone, and
where such edges follow one another only the ends of their chain matter.

Points find their leaf by an equi-join on the cell. Only where a leaf is cut
they are compared with its edges, in one task for a block of points: points and
edges are halved together until few pairs are left, so that a point meets the
edges round it and not all of its leaf.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galespark.session import broadcast_if_small, cut

TILE, SPLIT, LEVELS = 10.0, 4, 3
LEAVES = 100_000  # leaves, or cells of regions, that may be broadcast
PIECE, BLOCK = 2048, 1 << 17  # edges in a row of a leaf, points in a task
PAIRS = 1 << 18  # points times edges that are compared without a further cut
APART = 1e-6  # degrees between a cell and edges that count as wholly east of it
ENDS = ("x1", "y1", "x2", "y2")
EDGE = (*ENDS, "x0", "x3")


def edges_of(ring: Column) -> Column:
    """Edges of a ring of (lon, lat); its last point leads back to the first.
    ``x0`` and ``x3`` are where the edge before starts and the next one ends."""
    size = F.size(ring)
    turned = lambda k: F.concat(F.slice(ring, F.lit(k + 1), F.greatest(size - k, F.lit(0))), F.slice(ring, F.lit(1), F.lit(k)))
    back = F.concat(F.slice(ring, F.greatest(size, F.lit(1)), F.lit(1)), F.slice(ring, F.lit(1), F.greatest(size - 1, F.lit(0))))
    beside = F.zip_with(back, turned(2), lambda o, r: F.struct(o["lon"].alias("x0"), r["lon"].alias("x3")))
    ends = F.zip_with(
        ring, turned(1),
        lambda p, q: F.struct(p["lon"].alias("x1"), p["lat"].alias("y1"), q["lon"].alias("x2"), q["lat"].alias("y2")),
    )
    return F.zip_with(ends, beside, lambda e, b: F.struct(*(e[c].alias(c) for c in ENDS), *(b[c].alias(c) for c in ("x0", "x3"))))


def ring_edges(corners: DataFrame, keys: list[str], order: str, chunk: int = 1 << 16) -> DataFrame:
    """Edges of rings whose corners are rows, as :func:`edges_of` gives them;
    ``no`` tells the edges of a ring apart.

    Rings are dealt out by stretches of ``order``. What a stretch cannot know,
    the corner before it and the two behind it, comes from one small row per
    stretch; equal orders go by place."""
    c = corners.select(*keys, order, F.col("lon").alias("x1"), F.col("lat").alias("y1"))
    c = c.withColumn("stretch", F.coalesce(F.floor(F.col(order) / chunk), F.lit(-(1 << 60))))
    w = Window.partitionBy(*keys, "stretch").orderBy(order, "x1", "y1")
    c = c.withColumns({"nth": F.row_number().over(w), "x0": F.lag("x1").over(w), "x2": F.lead("x1").over(w), "y2": F.lead("y1").over(w), "x3": F.lead("x1", 2).over(w)})
    here = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    ends = c.groupBy(*keys, "stretch").agg(
        F.max("nth").alias("size"), F.max_by(here, "nth").alias("last"), F.min_by(here, "nth").alias("first"),
        F.min_by(here, F.when(F.col("nth") == 2, F.col("nth"))).alias("second"),
    )
    # a ring closes on itself: before its first stretch comes the last one, and the other way round
    all_of = Window.partitionBy(*keys).orderBy("stretch")
    whole = all_of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda name: F.coalesce(F.lead(name).over(all_of), F.first(name).over(whole))
    ends = ends.withColumns({"back": F.coalesce(F.lag("last").over(all_of), F.last("last").over(whole)), "next": after("first")})
    ends = ends.withColumn("then", F.coalesce("second", "next"))
    ends = ends.select(*(F.col(k).alias(f"_{k}") for k in (*keys, "stretch")), "size", "back", "next", after("then").alias("next2"))
    c = c.join(ends, reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, "stretch"))))
    left = F.col("size") - F.col("nth")
    c = c.withColumns({
        "x0": F.when(F.col("nth") == 1, F.col("back.x")).otherwise(F.col("x0")),
        "x2": F.when(left == 0, F.col("next.x")).otherwise(F.col("x2")), "y2": F.when(left == 0, F.col("next.y")).otherwise(F.col("y2")),
        "x3": F.when(left == 0, F.col("next2.x")).when(left == 1, F.col("next.x")).otherwise(F.col("x3")),
    })
    return c.select(*keys, F.xxhash64(order, "nth").alias("no"), *EDGE)


def _turn(e, x, y):
    """Which side of an edge's line a point lies on."""
    return (e["x2"] - e["x1"]) * (y - e["y1"]) - (x - e["x1"]) * (e["y2"] - e["y1"])


def on_edge(e, x: Column, y: Column) -> Column:
    """Whether a point lies on an edge."""
    within = x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(
        F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
    )
    return (_turn(e, x, y) == 0) & within


def crosses(e, x: Column, y: Column) -> Column:
    """Whether a ray from a point to the east crosses an edge."""
    turn, rises = _turn(e, x, y), e["y2"] > e["y1"]
    return ((e["y1"] > y) != (e["y2"] > y)) & ((rises & (turn > 0)) | (~rises & (turn < 0)))


def touches(e: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether an edge meets a closed cell: their boxes do, and the cell's
    corners are not all on one side of the edge's line."""
    apart = (
        (F.greatest(e["x1"], e["x2"]) < x0) | (F.least(e["x1"], e["x2"]) > x1)
        | (F.greatest(e["y1"], e["y2"]) < y0) | (F.least(e["y1"], e["y2"]) > y1)
    )
    sides = [_turn(e, x, y) for x in (x0, x1) for y in (y0, y1)]
    return ~apart & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def _size(level: int) -> float:
    return TILE / SPLIT**level


def _cell(value: Column, origin: float, level: int) -> Column:
    last = int(round(-2 * origin / _size(level))) - 1
    return F.least(F.floor((value - origin) / _size(level)), F.lit(last)).cast("int")  # the far edge belongs to the last cell


CELL = ["ring", "cx", "cy"]


def _corner(level: int) -> tuple[Column, Column]:
    """South-western corner of a cell."""
    return F.col("cx") * _size(level) - 180.0, F.col("cy") * _size(level) - 90.0


def _east_of(e, east: Column) -> Column:
    """Whether an edge lies wholly to the east; one with an unknown end never does."""
    known = e["y1"].isNotNull() & e["y2"].isNotNull()
    return F.coalesce((e["x1"] > east) & (e["x2"] > east) & known, F.lit(False))


def _in_cells(edges: DataFrame, level: int) -> DataFrame:
    """Edges by the cells of a level, out of those of their cell above (``ux``,
    ``uy``; at the first level out of the tiles round their ring) that are in
    their latitudes and not wholly east of them. ``far`` are those to the east
    of the cell that were not so of the cell above; ``turn`` are the latitudes
    at which the far ones change the number of crossings."""
    s, e = _size(level), {c: F.col(c) for c in EDGE}
    low_x, high_x, low_y, high_y = F.least("x1", "x2"), F.greatest("x1", "x2"), F.least("y1", "y2"), F.greatest("y1", "y2")
    if level:
        first, last = (F.col("ux") * SPLIT, F.col("uy") * SPLIT), (F.col("ux") * SPLIT + SPLIT - 1, F.col("uy") * SPLIT + SPLIT - 1)
    else:
        first, last = (F.col("west"), F.col("south")), (F.col("east"), F.col("north"))
    span = {
        "a": first[0], "b": F.least(last[0], _cell(high_x, -180.0, level)),
        "c": F.greatest(first[1], _cell(low_y - 1e-9, -90.0, level)), "d": F.least(last[1], _cell(high_y, -90.0, level)),
    }
    rows = edges.withColumns(span).filter("a <= b and c <= d")
    rows = rows.withColumn("cx", F.explode(F.sequence("a", "b"))).withColumn("cy", F.explode(F.sequence("c", "d")))
    x, y = _corner(level)
    rows = rows.filter((high_y >= y) & (low_y <= y + s) & (high_x >= x))
    east = x + s + APART
    rows = rows.withColumn("far", _east_of(e, east))
    beside = lambda before, c: F.coalesce(c > east, F.lit(False)) & ~before
    if level:
        above = (F.col("ux") + 1) * _size(level - 1) - 180.0 + APART
        gone = lambda p, q: F.coalesce((p > above) & (q > above), F.lit(False))
    else:
        gone = lambda p, q: F.lit(False)
    # where the edge beside it is as far, the chain goes on
    ends = lambda v, here, c: F.when(F.col("far") & v.between(y, y + s) & ~beside(gone(here, c), c), v)
    return rows.withColumns({"turn1": ends(e["y1"], e["x1"], e["x0"]), "turn2": ends(e["y2"], e["x2"], e["x3"])})


def _classified(rows: DataFrame, cells: DataFrame, turns: DataFrame, level: int) -> DataFrame:
    """Cells of regions with what their edges make of them: ``cut`` or whole;
    where neither, they are left out. ``below`` says whether the edges east of
    the cell are crossed an odd number of times just south of it."""
    s, e = _size(level), {c: F.col(c) for c in ENDS}
    x, y = _corner(level)
    mid = (x + s / 2, y + s / 2)
    touch, cross = touches(e, x, y, x + s, y + s), crosses(e, *mid)
    odd = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int")) % 2 == 1
    any_of = lambda c: F.coalesce(F.max(F.coalesce(c, F.lit(False))), F.lit(False))
    seen = rows.groupBy(*CELL).agg(
        any_of(touch).alias("cut"), any_of(touch.isNull() | cross.isNull()).alias("unknown"), any_of(on_edge(e, *mid)).alias("on"),
        odd(cross).alias("odd"), odd(F.col("far") & ((F.col("y1") < y) != (F.col("y2") < y))).alias("flip"),
        F.sum((~F.col("far")).cast("int")).alias("near"),
    )
    if level:
        t = turns.select("ring", "y", F.col("cx").alias("ux"), F.col("cy").alias("uy"))
        t = t.withColumn("cy", F.explode(F.sequence(F.col("uy") * SPLIT, F.col("uy") * SPLIT + SPLIT - 1)))
        t = t.groupBy("ring", "ux", "cy").agg(odd(F.col("y") < y).alias("t_below"), odd(F.col("y") <= y + s / 2).alias("t_mid"))
        parts = F.sequence(F.col("ux") * SPLIT, F.col("ux") * SPLIT + SPLIT - 1)
        cells = cells.join(seen, CELL, "left").join(t.withColumn("cx", F.explode(parts)).drop("ux"), CELL, "left")
        before = lambda c: F.col("below") != F.coalesce(c, F.lit(False))
        above, now = before(F.col("t_mid")), before(F.col("t_below"))
    else:
        cells = cells.join(seen, CELL, "left")
        above = now = F.col("below")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    inside = no("on") | (~no("unknown") & (above != no("odd")))
    cells = cells.select(*CELL, "whole", (~F.col("whole") & no("cut")).alias("cut"), (now != no("flip")).alias("below"), (inside & ~no("unknown")).alias("inside"), "near")
    return cells.withColumn("whole", ~F.col("cut") & (F.col("whole") | F.col("inside"))).drop("inside").filter("cut or whole")


def _key(level: Column, cx: Column, cy: Column) -> Column:
    return (level.cast("bigint") * (1 << 40) + cx.cast("bigint") * (1 << 20) + cy.cast("bigint")).alias("leaf")


NOWHERE = -1  # leaf of points without a place on the map


def _rows_of(layer: DataFrame) -> DataFrame:
    """Edges of a layer, which has them as rows or as rings."""
    if "ring" not in layer.columns:
        return layer.select(F.struct("rank", "region", F.lit(0).cast("bigint").alias("id")).alias("ring"), "no", *EDGE)
    layer = cut(layer.select("rank", "region", "ring", F.monotonically_increasing_id().alias("id")))  # two rings may have one name
    edges = layer.select(F.struct("rank", "region", "id").alias("of"), F.posexplode(edges_of(F.col("ring"))).alias("no", "e"))
    return edges.select(F.col("of").alias("ring"), F.col("no").cast("bigint").alias("no"), *(F.col(f"e.{c}").alias(c) for c in EDGE))


def leaves(layer: DataFrame) -> DataFrame:
    """(leaf, regions): all leaves of the tree of ``layer(region, rank, ring)``,
    or of its edges (:func:`ring_edges`), those without a region too, so that
    every point has exactly one leaf. A row has one region at most: a region
    that covers its leaf, or a piece of one that cuts it. The edges of all
    pieces count, and so do their ``turns`` and ``below``."""
    spark = layer.sparkSession
    edges = cut(_rows_of(layer))
    tile = lambda value, origin: _cell(value, origin, 0)
    box = edges.groupBy("ring").agg(
        tile(F.min("x1") - 1e-9, -180.0).alias("west"), tile(F.max("x1"), -180.0).alias("east"),
        tile(F.min("y1") - 1e-9, -90.0).alias("south"), tile(F.max("y1"), -90.0).alias("north"),
    )
    box = cut(box.filter("west is not null and south is not null"))
    found = box.withColumn("cx", F.explode(F.sequence("west", "east"))).withColumn("cy", F.explode(F.sequence("south", "north")))
    found = found.select(*CELL, F.lit(False).alias("whole"), F.lit(False).alias("below"))
    wide, high = int(360 / TILE), int(180 / TILE)
    cells = spark.range(wide * high).select((F.col("id") % wide).cast("int").alias("cx"), F.floor(F.col("id") / wide).cast("int").alias("cy"))
    parts = F.sequence(F.lit(0), F.lit(SPLIT - 1))
    deeper = lambda df: (
        df.withColumn("i", F.explode(parts)).withColumn("j", F.explode(parts))
        .withColumns({"cx": F.col("cx") * SPLIT + F.col("i"), "cy": F.col("cy") * SPLIT + F.col("j")}).drop("i", "j")
    )
    entry = lambda whole, near, turns, below: F.array(F.struct(
        F.col("ring.rank").alias("rank"), F.col("ring.region").alias("region"), F.col("ring.id").alias("id"), F.lit(whole).alias("whole"),
        near.alias("edges"), turns.alias("turns"), below.alias("below"),
    ))
    nothing = (F.lit(None).cast("array<struct<x1: double, y1: double, x2: double, y2: double>>"), F.lit(None).cast("array<double>"), F.lit(None).cast("boolean"))
    out = [spark.range(1).select(F.lit(NOWHERE).cast("bigint").alias("leaf"), F.lit(None).alias("regions"))]
    rows, turns = edges.join(broadcast_if_small(box, LEAVES), "ring"), None
    for level in range(LEVELS):
        rows = _in_cells(rows, level)
        found = cut(_classified(rows, found, turns, level))
        within = broadcast_if_small(found.filter("cut").select(*CELL, F.greatest(F.lit(1), F.ceil(F.col("near") / PIECE)).alias("pieces")), LEAVES)
        rows = rows.filter("not far or turn1 is not null or turn2 is not null").join(within, CELL)
        rows = cut(rows.select(*CELL, "no", *EDGE, "far", "turn1", "turn2", "pieces")) if level < LEVELS - 1 else rows
        y = _corner(level)[1]
        here = rows.select(*CELL, "pieces", F.explode(F.array("turn1", "turn2")).alias("y")).filter("y is not null")
        if turns is not None:
            held = deeper(turns.select(*CELL, "y")).filter(F.col("y").between(y, y + _size(level)))
            here = here.unionByName(held.join(within, CELL))
        turns = here
        # a cell is split for all its regions where an edge of any runs through it
        split = found.filter("cut").select("cx", "cy").distinct() if level < LEVELS - 1 else found.select("cx", "cy").limit(0)
        split = cut(split)
        here = found.filter("whole").select("cx", "cy", entry(True, *nothing).alias("regions"))
        kept = cells.join(split, ["cx", "cy"], "left_anti").join(here, ["cx", "cy"], "left")
        out.append(kept.select(_key(F.lit(level), F.col("cx"), F.col("cy")), "regions"))
        if level < LEVELS - 1:
            found = deeper(found.join(split, ["cx", "cy"], "left_semi").select(*CELL, "whole", "below"))
            cells = deeper(split)
            rows = rows.filter("not far").select("ring", "no", *EDGE, F.col("cx").alias("ux"), F.col("cy").alias("uy"))
    piece = lambda number: F.pmod(number, F.col("pieces")).alias("piece")
    held = [
        rows.filter("not far").select(*CELL, piece(F.col("no")), F.struct(*ENDS).alias("e")),
        turns.select(*CELL, piece(F.xxhash64("y")), "y"),
        found.filter("cut").select(*CELL, F.lit(0).cast("bigint").alias("piece"), "below"),
    ]
    held = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), held).groupBy(*CELL, "piece").agg(
        F.collect_list("e").alias("edges"), F.collect_list("y").alias("turns"), F.coalesce(F.max("below"), F.lit(False)).alias("below")
    )
    held = held.select(_key(F.lit(LEVELS - 1), F.col("cx"), F.col("cy")), entry(False, F.col("edges"), F.col("turns"), F.col("below")).alias("regions"))
    return reduce(DataFrame.unionByName, [*out[1:], held, out[0]])


def _covered(x, y, x1, y1, x2, y2, odd):
    """Which points the region of some edges covers, as far as it is known;
    points on an edge count. ``odd`` says whether a ray from a point to the
    east crosses further edges an odd number of times.

    Points and edges are halved together. Of the edges east of all points of a
    half only the latitudes count, those west of them do not count at all, and
    the rest are compared point by point once that is little work."""
    blind = np.isnan(x1) | np.isnan(x2) | np.isnan(y1) | np.isnan(y2)
    unknown = np.full(len(x), bool((np.isnan(y1) | np.isnan(y2)).any()))
    if blind.any() and not unknown.any():  # a crossing is unknown where such an edge reaches the latitude
        low, top = np.sort(np.minimum(y1, y2)[blind]), np.sort(np.maximum(y1, y2)[blind])
        unknown = np.searchsorted(low, y, "right") > np.searchsorted(top, y, "right")
    odd, on = odd.copy(), np.zeros(len(x), bool)
    stack = [(np.arange(len(x)), np.flatnonzero(~blind))]
    while stack:
        p, e = stack.pop()
        px, py = x[p], y[p]
        west, east, south, north = px.min(), px.max(), py.min(), py.max()
        ex1, ey1, ex2, ey2 = x1[e], y1[e], x2[e], y2[e]
        reach = (np.maximum(ey1, ey2) >= south) & (np.minimum(ey1, ey2) <= north) & (np.maximum(ex1, ex2) >= west)
        e, ex1, ey1, ex2, ey2 = e[reach], ex1[reach], ey1[reach], ex2[reach], ey2[reach]
        dx, dy = ex2 - ex1, ey2 - ey1
        a, b, c, d = dx * (south - ey1), dx * (north - ey1), (west - ex1) * dy, (east - ex1) * dy
        least, most = np.minimum(a, b) - np.maximum(c, d), np.maximum(a, b) - np.minimum(c, d)
        blur = 1e-14 * (np.maximum(abs(a), abs(b)) + np.maximum(abs(c), abs(d)))  # more than rounding may change
        left, right = least > blur, most < -blur
        passed = ((dy > 0) & left) | ((dy < 0) & right)
        ends = np.sort(np.concatenate([ey1[passed], ey2[passed]]))
        odd[p] ^= ((len(ends) - np.searchsorted(ends, py, "right")) & 1).astype(bool)
        near = ~(left | right)
        e = e[near]
        if not len(e):
            continue
        if len(p) > 1 and len(p) * len(e) > PAIRS:
            along = px if east - west >= north - south else py
            middle = np.partition(along, len(along) // 2)[len(along) // 2]
            half = along < middle
            if not half.any():
                half = along <= middle
            stack += [(p[half], e), (p[~half], e)]
            continue
        dx, dy, ex1, ey1, ex2, ey2 = dx[near], dy[near], ex1[near], ey1[near], ex2[near], ey2[near]
        qx, qy = px[:, None], py[:, None]
        turn = dx * (qy - ey1) - (qx - ex1) * dy
        crossed = ((ey1 > qy) != (ey2 > qy)) & np.where(dy > 0, turn > 0, turn < 0)
        odd[p] ^= (crossed.sum(axis=1) & 1).astype(bool)
        within = (qx >= np.minimum(ex1, ex2)) & (qx <= np.maximum(ex1, ex2)) & (qy >= np.minimum(ey1, ey2)) & (qy <= np.maximum(ey1, ey2))
        on[p] |= ((turn == 0) & within).any(axis=1)
    return on | (odd & ~unknown)


def _first_of(name: str, helpers: list[str]):
    """Points of a leaf, or a block of them, with the first region that covers each."""

    def numbers(values) -> np.ndarray:
        return values.to_numpy(zero_copy_only=False).astype(float)

    def found(points: pa.Table, tree: pa.Table) -> pa.Table:
        both, back = np.unique(numbers(points["__x"].combine_chunks()) + 1j * numbers(points["__y"].combine_chunks()), return_inverse=True)
        x, y = both.real.copy(), both.imag.copy()
        entries = pa.concat_arrays([c.flatten() for c in tree["regions"].chunks])
        field = lambda k: pc.struct_field(entries, k)
        ranks, regions, ids, whole = (field(k).to_pylist() for k in ("rank", "region", "id", "whole"))
        below, edges, turns = field("below").to_pylist(), field("edges"), field("turns")
        order: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(ranks, regions, ids)):
            order.setdefault(key, []).append(i)
        first = lambda v: (v is not None, 0 if v is None else v)
        keys = sorted(order, key=lambda k: (first(k[0]), first(k[1]), k[2]))
        hit = np.full(len(x), -1)
        for n, key in enumerate(keys):
            open_, rows = np.flatnonzero(hit < 0), order[key]
            if not len(open_):
                break
            if whole[rows[0]]:
                hit[open_] = n
                break
            mine = pa.array(rows)
            e, t = edges.take(mine).flatten(), np.sort(numbers(turns.take(mine).flatten()))
            odd = (np.searchsorted(t, y[open_], "right") & 1).astype(bool) ^ (sum(bool(below[i]) for i in rows) % 2 == 1)
            hit[open_[_covered(x[open_], y[open_], *(numbers(pc.struct_field(e, c)) for c in ENDS), odd)]] = n
        hit = hit[back]
        out = pa.array([k[1] for k in keys], type=field("region").type).take(pa.array(hit, mask=hit < 0))
        return points.drop_columns(helpers).append_column(name, out)

    return found


def assign(points: DataFrame, tree: DataFrame, name: str = "region", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``points`` with the region of lowest rank that covers them, or null.

    ``tree`` is a written table of :func:`leaves`. Longitudes run from -180 to
    180; points without a place in that range are in no region. A point lies
    in exactly one leaf, so an inner join on the leaves of all levels gives each
    point one row. Points in leaves that are cut go by leaf, in blocks, and meet
    the leaf's edges there."""
    x, y = F.col(lon), F.col(lat)
    placed = F.coalesce(x.between(-180, 180) & y.between(-90, 90) & ~F.isnan(x) & ~F.isnan(y), F.lit(False))
    here = F.array(*(_key(F.lit(k), _cell(x, -180.0, k), _cell(y, -90.0, k)) for k in range(LEVELS)))
    nowhere = F.array(F.lit(NOWHERE).cast("bigint"))
    head = tree.select(F.col("leaf").alias("__leaf"), *(F.col(f"regions.{c}")[0].alias(c) for c in ("whole", "rank", "region")))
    head = cut(head.groupBy("__leaf").agg(
        F.coalesce(F.max(~F.col("whole")), F.lit(False)).alias("__cut"), F.min(F.when(F.col("whole"), F.struct("rank", "region"))).alias("__first")
    ))
    rows = points.withColumn("__leaf", F.explode(F.when(placed, here).otherwise(nowhere))).join(broadcast_if_small(head, LEAVES), "__leaf")
    rows = cut(rows.withColumns({"__id": F.monotonically_increasing_id(), name: F.col("__first.region")}).drop("__first"))
    helpers = ["__leaf", "__cut", "__id"]
    done, left = rows.filter("not __cut").drop(*helpers), rows.filter("__cut").drop(name)
    blocks = cut(left.groupBy("__leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("__blocks")))
    blocks = broadcast_if_small(blocks, LEAVES)
    left = left.join(blocks, "__leaf").withColumns({"__block": F.col("__id") % F.col("__blocks"), "__x": x.cast("double"), "__y": y.cast("double")})
    edges = tree.join(blocks, F.col("leaf") == F.col("__leaf")).withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    own, kind = ["__leaf", "__block"], done.schema
    first = _first_of(name, [*helpers, "__blocks", "__block", "__x", "__y"])
    found = left.groupBy(*own).cogroup(edges.select(*own, "regions").groupBy(*own)).applyInArrow(first, kind)
    return done.unionByName(found)
