"""Regions of a polygon layer against a plain test of every ring."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from galespark.operators import regions

LAYER = "region string, rank int, ring array<struct<lon: double, lat: double>>"


def plain(ring, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        turn = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
        if turn == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return True
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def star(rng, lon, lat, size, n):
    at = [(size * rng.uniform(0.4, 1), 2 * math.pi * i / n) for i in range(n)]
    return [(round(lon + r * math.cos(a), 3), round(lat + r * math.sin(a), 3)) for r, a in at]


def test_first_region_that_covers(spark):
    rng = random.Random(5)
    rings = [
        star(rng, -40, 20, 30, 1200), star(rng, -30, 10, 25, 300), star(rng, 100, -20, 3, 40),
        [(-180, -90), (180, -90), (180, -60), (-180, -60)],  # reaches the ends of the map
        [(0, 0), (10, 0), (10, 10), (0, 10)], [(20.0, 0.0), (30.0, 0.0), (25.0, 9.0)],  # along borders of tiles
        [(50, 30), (60, 30), (60, 40), (58, 40), (58, 32), (52, 32), (52, 40), (50, 40)],  # a bay
    ]
    layer = spark.createDataFrame([(f"R{i}", i, [(float(x), float(y)) for x, y in r]) for i, r in enumerate(rings)] + [("empty", 99, [])], LAYER)
    points = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(600)]
    points += [(rng.uniform(-75, 5), rng.uniform(-20, 52)) for _ in range(800)] + [(rng.uniform(96, 104), rng.uniform(-24, -16)) for _ in range(200)]
    points += [p for r in rings for p in r[:40]]  # corners count
    points += [(0, 5), (10, 10), (10, 5), (5, 0), (25, 0), (22.5, 4.5), (55, 36), (58, 36), (58.000001, 36), (180, -75), (-180, -90), (180, 90), (-60, 20), (5, 5)]
    frame = spark.createDataFrame([(i, float(x), float(y), "mine") for i, (x, y) in enumerate(points)], "id int, lon double, lat double, whole string")
    tree = regions.leaves(layer)
    got = {r.id: r.region for r in regions.assign(frame, tree).collect()}
    assert len(got) == frame.count()
    for i, (x, y) in enumerate(points):
        want = next((f"R{k}" for k, r in enumerate(rings) if plain(r, x, y)), None)
        assert got[i] == want, (x, y)


def test_points_without_a_place_and_an_empty_layer(spark):
    nan = float("nan")
    odd = spark.createDataFrame([(1, None, 0.0), (2, 0.0, None), (3, nan, 0.0), (4, 200.0, 5.0), (5, 5.0, 95.0), (6, 5.0, 5.0)], "id int, lon double, lat double")
    world = spark.createDataFrame([("all", 0, [(-180.0, -90.0), (180.0, -90.0), (180.0, 90.0), (-180.0, 90.0)])], LAYER)
    got = {r.id: r.region for r in regions.assign(odd, regions.leaves(world)).collect()}
    assert got == {1: None, 2: None, 3: None, 4: None, 5: None, 6: "all"}
    assert {r.region for r in regions.assign(odd, regions.leaves(world.limit(0))).collect()} == {None}


def test_a_leaf_holds_few_edges(spark):
    rng = random.Random(2)
    layer = spark.createDataFrame([("R", 0, star(rng, 0.0, 0.0, 40, 4000))], LAYER)
    tree = regions.leaves(layer).filter("regions is not null").select(F.explode("regions").alias("r"))
    most = tree.agg(F.max(F.size("r.edges")), F.sum(F.col("r.whole").cast("int"))).first()
    assert most[0] < 600 and most[1] > 50  # of 4,000 edges; and leaves that need none


def test_edges_further_east_are_folded(spark):
    """A leaf holds the edges round it, not those on the other side of a wide region."""
    ring = [(40 * math.cos(2 * math.pi * i / 4000), 40 * math.sin(2 * math.pi * i / 4000)) for i in range(4000)]
    layer = spark.createDataFrame([("R", 0, ring)], LAYER)
    r = regions.leaves(layer).filter("regions is not null").select(F.explode("regions").alias("r")).filter("not r.whole")
    west = r.withColumn("first", F.array_min(F.transform("r.edges", lambda e: F.least(e["x1"], e["x2"]))))
    west = west.withColumn("last", F.array_max(F.transform("r.edges", lambda e: F.greatest(e["x1"], e["x2"]))))
    assert west.agg(F.max(F.col("last") - F.col("first"))).first()[0] < 11
    assert r.select(F.explode("r.edges").alias("e")).distinct().count() == 4000


@pytest.mark.parametrize("touching", [(0.0, 0.0, 1.0, 1.0), (-1.0, 0.5, 2.0, 0.5), (1.0, -1.0, 1.0, 3.0), (0.2, 0.2, 0.3, 0.3)])
def test_edges_that_touch_a_cell(spark, touching):
    e = F.struct(*(F.lit(v).alias(n) for v, n in zip(touching, ("x1", "y1", "x2", "y2"))))
    cell = [F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)]
    assert spark.range(1).select(regions.touches(e, *cell)).first()[0]
    far = F.struct(F.lit(1.5).alias("x1"), F.lit(0.0).alias("y1"), F.lit(0.9).alias("x2"), F.lit(2.0).alias("y2"))
    assert not spark.range(1).select(regions.touches(far, *cell)).first()[0]


def test_edges_of_corner_rows(spark):
    """Rings dealt out by stretches close on themselves, whatever their corners' order or number."""
    rng = random.Random(9)
    sizes = {"one": 1, "two": 2, "five": 5, "many": 41}
    rings = {k: [(None if (i, k) == (3, "five") else rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(n)] for k, n in sizes.items()}
    rows = [(k, 1, i // 2 * 3 if k == "many" else i, *p) for k, r in rings.items() for i, p in enumerate(r)]
    rng.shuffle(rows)
    corners = spark.createDataFrame([*rows, (None, None, None, 1.0, 2.0)], "region string, rank int, corner long, lon double, lat double")
    got = regions.ring_edges(corners, ["region", "rank"], "corner", chunk=4)
    ring = F.sort_array(F.collect_list(F.struct("corner", "lon", "lat")))
    whole = corners.groupBy("region", "rank").agg(ring.alias("r")).select("region", "rank", F.explode(regions.edges_of(F.col("r"))).alias("e"))
    whole = whole.select("region", "rank", *(F.col(f"e.{c}").alias(c) for c in regions.EDGE))
    assert got.count() == len(rows) + 1
    assert got.drop("no").exceptAll(whole).isEmpty() and whole.exceptAll(got.drop("no")).isEmpty()


def test_many_edges_and_points_in_few_leaves(spark, monkeypatch):
    """Edges of a leaf come in pieces, points in blocks; few pairs of them are compared."""
    rng = random.Random(3)
    rings = {"fine": star(rng, 0.3, 0.3, 0.25, 3000), "wide": star(rng, 2.0, 1.0, 9, 500)}
    rows = [(k, i, n, x, y) for i, (k, r) in enumerate(rings.items()) for n, (x, y) in enumerate(r)]
    corners = spark.createDataFrame(rows, "region string, rank int, corner long, lon double, lat double")
    monkeypatch.setattr(regions, "PIECE", 64)
    monkeypatch.setattr(regions, "BLOCK", 100)
    tree = regions.leaves(regions.ring_edges(corners, ["region", "rank"], "corner", chunk=300)).persist()
    r = tree.filter("regions is not null").select(F.explode("regions").alias("r"))
    assert r.agg(F.max(F.size("r.edges"))).first()[0] < 200
    points = [(rng.uniform(0, 0.6), rng.uniform(0, 0.6)) for _ in range(400)] + [rng.choice(rings["fine"]) for _ in range(50)] * 4
    frame = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id int, lon double, lat double")
    got = {r.id: r.region for r in regions.assign(frame, tree).collect()}
    tree.unpersist()
    assert len(got) == len(points)
    for i, (x, y) in enumerate(points):
        assert got[i] == next((k for k, ring in rings.items() if plain(ring, x, y)), None), (x, y)


def test_points_and_edges_are_halved_together(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(regions, "PAIRS", 64)
    at = np.round(rng.uniform(0, 5, (300, 2)), 1)  # rounded: edges level with points, points on corners
    x1, y1 = at.T
    x2, y2 = np.roll(at, -1, axis=0).T
    x, y = np.round(rng.uniform(-1, 6, (500, 2)), 1).T
    odd = rng.uniform(size=500) < 0.5
    got = regions._covered(x, y, x1, y1, x2, y2, odd)
    turn = (x2 - x1) * (y[:, None] - y1) - (x[:, None] - x1) * (y2 - y1)
    crossed = ((y1 > y[:, None]) != (y2 > y[:, None])) & np.where(y2 > y1, turn > 0, turn < 0)
    box = (x[:, None] >= np.minimum(x1, x2)) & (x[:, None] <= np.maximum(x1, x2)) & (y[:, None] >= np.minimum(y1, y2)) & (y[:, None] <= np.maximum(y1, y2))
    want = ((turn == 0) & box).any(axis=1) | (odd ^ (crossed.sum(axis=1) % 2 == 1))
    assert (got == want).all()
    y2[7] = np.nan  # an edge with an unknown end: only points on an edge are known to be covered
    assert (regions._covered(x, y, x1, y1, x2, y2, odd) <= want).all()
