"""Grid rules on drawn fields and against brute force."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from galespark.functions.geo import EARTH_RADIUS_M
from galespark.operators import grid

T0 = datetime(2024, 1, 1)


def cells(spark, mslp, u=None, v=None, lat0=20.0, dlat=-1.0):
    rows, cols = mslp.shape
    zero = np.zeros_like(mslp)
    u, v = (zero if a is None else a for a in (u, v))
    data = [
        ("GFS", T0, 0, x, y, lat0 + dlat * x, -60.0 + y, float(mslp[x, y]), float(u[x, y]), float(v[x, y]), 10950.0, 1400.0)
        for x in range(rows) for y in range(cols)
    ]
    return spark.createDataFrame(
        data, "model_name string, init_time timestamp, time_step int, x int, y int, lat double, lon double, mslp double, u double, v double, gh250 double, gh850 double"
    ).selectExpr("*", "u as u925", "v as v925", "u as u10", "v as v10")


def bowl(rows=41, cols=41, cut=False):
    x, y = np.mgrid[:rows, :cols]
    d = np.hypot(x - rows // 2, y - cols // 2)
    p = 1000 + np.minimum(d, 12.0) * 1.5
    p[d > 12] = 1018.0
    if cut:
        p[rows // 2, cols // 2 :] = 1000.5
    return p


def flood(field, cx, cy, r, t, ring):
    """True where no cell under the threshold reaches the ring."""
    n, m = field.shape
    box = np.array([[field[(cx + i) % n, (cy + j) % m] for j in range(-r, r + 1)] for i in range(-r, r + 1)])
    low = (box - box[r, r] - t) < 0
    todo, seen = [(r, r)], set()
    while todo:
        a, b = todo.pop()
        if (a, b) in seen or not (0 <= a <= 2 * r and 0 <= b <= 2 * r) or not low[a, b]:
            continue
        seen.add((a, b))
        todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    edge = {ring, 2 * r - ring}
    return not any(a in edge or b in edge for a, b in seen), seen


def test_closed_isobar_equals_flood(spark):
    rng = np.random.default_rng(4)
    field = rng.normal(1000, 2, (24, 30)).round(3)
    g = grid.Grid(24, 30, 20.0, -1.0, 1.0)
    strips = grid.strips(cells(spark, field), ["lon", "mslp"])
    low = grid.local_minima(strips)
    spots = [(r.x, r.y) for r in low.collect()]
    want_low = [
        (x, y) for x in range(24) for y in range(30)
        if field[x, y] == min(field[(x + i) % 24, (y + j) % 30] for i in (-1, 0, 1) for j in (-1, 0, 1))
    ]
    assert sorted(spots) == want_low
    for ring, touching in ((0, False), (1, True)):
        for t in (1.0, 2.0):
            got = {(r.x, r.y) for r in grid.closed_isobar(low, strips, g, t, touching=touching).collect()}
            assert got == {s for s in spots if flood(field, *s, 5, t, ring)[0]}


def spiral(side, turns):
    """A low channel winding out from the centre between high walls, to the edge or not."""
    p = np.full((side, side), 1010.0)
    x = y = side // 2
    p[x, y] = 1000.0
    length, way = 2, 0
    for t in range(2 * turns):
        for _ in range(length):
            x, y = x + (0, 1, 0, -1)[way], y + (1, 0, -1, 0)[way]
            if 0 <= x < side and 0 <= y < side:
                p[x, y] = 1000.5 + 0.01 * t
        way = (way + 1) % 4
        length += 2 * (t % 2)
    return p


def plain_rise(box):
    """Least highest cell on the way from the centre, one cell after another in order of height."""
    import heapq

    s = len(box)
    c = s // 2
    done, todo = {}, [(0.0, c, c)]
    while todo:
        h, a, b = heapq.heappop(todo)
        if (a, b) not in done:
            done[a, b] = h
            for i, j in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= i < s and 0 <= j < s and (i, j) not in done:
                    heapq.heappush(todo, (max(h, box[i, j] - box[c, c]), i, j))
    return np.array([[done[i, j] for j in range(s)] for i in range(s)])


def test_rise_on_spirals_and_noise():
    rng = np.random.default_rng(3)
    fields = [spiral(21, t) for t in (1, 3, 5, 11)] + [spiral(21, t).T for t in (4, 6)] + [spiral(21, 5) + rng.normal(0, 0.3, (21, 21)) for _ in range(4)]
    fields += [rng.normal(1000, 2, (21, 21)).round(1) for _ in range(8)] + [np.full((21, 21), 1000.0)]
    got = grid._rise(np.stack(fields))
    for f, r in zip(fields, got):
        assert np.array_equal(r, plain_rise(f))
    assert grid._barrier(got, 0)[0] == 10 and grid._barrier(got, 0)[3] < 1  # a short spiral is closed, a long one leads out


def test_bowl_is_closed_and_ridge_cut_is_not(spark):
    g = grid.Grid(41, 41, 20.0, -1.0, 1.0)
    for cut, n in ((False, 1), (True, 0)):
        strips = grid.strips(cells(spark, bowl(cut=cut)), ["lon", "mslp"])
        centre = grid.local_minima(strips).filter("x = 20 and y = 20")
        assert grid.closed_isobar(centre, strips, g).count() == n


def test_outermost_isobar_and_radius(spark):
    p = bowl()
    g = grid.Grid(41, 41, 20.0, -1.0, 1.0)
    strips = grid.strips(cells(spark, p), ["lon", "mslp"])
    centre = grid.local_minima(strips).filter("x = 20 and y = 20")
    got = grid.radius_of_closed_isobar(centre, strips, g).first()
    want = max(t for t in range(2, 200) if flood(p, 20, 20, 15, t, 1)[0])
    assert got.closed_isobar_delta == want == 18
    assert (got.mass_x, got.mass_y) == (20, 20)
    filled = {(a - 15, b - 15) for a, b in flood(p, 20, 20, 15, want, 1)[1]}
    legs, metres = [], []
    for k in range(576):
        pos, d = np.array([15.0, 15.0]), np.array([np.cos(k * 2 * np.pi / 576), np.sin(k * 2 * np.pi / 576)])
        n, last = 0, (15, 15)
        while True:
            pos = pos + d
            c = tuple(pos.astype(int))
            if (c[0] - 15, c[1] - 15) not in filled:
                break
            n, last = n + 1, c
        legs.append(n)
        la = np.radians(20.0 - (20 + last[0] - 15))
        h = np.sin((la - 0) / 2) ** 2 + np.cos(la) * np.sin(np.radians(last[1] - 15) / 2) ** 2
        metres.append(2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(h)))
    assert got.roci_grid_units == pytest.approx(np.mean(legs), abs=1e-9)
    assert got.roci == pytest.approx(np.mean(metres), rel=1e-9)


def test_no_radius_where_nothing_is_closed(spark):
    p = np.full((9, 9), 1000.0)
    strips = grid.strips(cells(spark, p), ["lon", "mslp"])
    one = grid.local_minima(strips).filter("x = 4 and y = 4")
    r = grid.radius_of_closed_isobar(one, strips, grid.Grid(9, 9, 20.0, -1.0, 1.0), degrees=3).first()
    assert r.closed_isobar_delta is None and r.roci is None


def test_solid_rotation_has_constant_vorticity(spark):
    omega = 2e-5
    x, y = np.mgrid[:21, :21]
    lat = 1.0 - 0.1 * x
    ny = EARTH_RADIUS_M * np.radians(lat)
    nx = EARTH_RADIUS_M * np.radians(0.1 * (y - 10)) * np.cos(np.radians(lat))
    g = grid.Grid(21, 21, 1.0, -0.1, 0.1)
    c = cells(spark, np.zeros((21, 21)), u=-omega * ny, v=omega * nx, lat0=1.0, dlat=-0.1)
    v = grid.vorticity(grid.strips(c, ["lon", "u", "v"]), g)
    values = np.array([r.vort for r in v.orderBy("x").collect()])
    assert np.allclose(values, 2 * omega, rtol=1e-3)


def test_box_extreme_turns_south_of_the_equator(spark):
    p = bowl(11, 11)
    c = cells(spark, p, u=np.arange(121.0).reshape(11, 11) - 60, lat0=5.0)
    strips = grid.strips(c, ["lon", "mslp", "u"])
    cand = strips.filter("x in (2, 8)").select(*grid.RUN, "x", F.lit(5).alias("y"), "lat")
    got = {r.x: r.e for r in grid.box_extreme(cand, strips, "u", "e", 1, 11, by_hemisphere=True).collect()}
    assert got == {2: 3 * 11 + 6 - 60, 8: 7 * 11 + 4 - 60}


def test_detection_finds_the_bowl_with_strong_wind(spark):
    p = bowl()
    x, y = np.mgrid[:41, :41]
    u, v = (x - 20) * 6.0, (y - 20) * 6.0
    c = cells(spark, p, u=u, v=v)
    limits = spark.createDataFrame([("GFS", "AL", 20.0, 1.0, 9500.0)], "model_name string, basin string, ws double, rv double, thkn double")
    found = grid.detect(c, grid.Grid(41, 41, 20.0, -1.0, 1.0), limits).collect()
    spots = {(f.x, f.y) for f in found}
    assert (20, 20) in spots
    f = next(f for f in found if (f.x, f.y) == (20, 20))
    assert f.criteria == {"vmax925": True, "rv850max": True, "gp250_850_thickness": True, "all": True}
    r = int(np.round(f.roci_grid_units))
    assert f.vmax10m_in_roci == pytest.approx(np.hypot(6.0 * r, 6.0 * r))
