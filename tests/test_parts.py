"""Readers, writers, sequences, geometry, geodesics, products."""

import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from galespark.functions import geo, geodesic
from galespark.functions import text as text_fn
from galespark.operators import ensemble, grid, microwave, passes, sequence, verify, winds
from galespark.operators.ranking import quantiles, ranked
from galespark.plans import runs
from galespark.sinks import writers
from galespark.sources import advisory, deck, dims, files, tracker
from galespark.sources import grid as grid_rows
from galespark.streaming import streams

LINE = (
    "TG, 18L, 2024100500_F000_201N_0951W_FOF, 2024100500, 03, GFSO, 006, 201N, 951W, 35, 1004, XX, 34, NEQ, 60, 50, 0, 40, "
    "1007, 120, 40, -999, 310, -9999, Y, 25, 40, 150, 300, 120, 250, 0, 0, 0, 0, 0, 0, 0, 0"
)


def test_tracker_files_of_wrong_width_are_left_out_whole(spark, tmp_path):
    (tmp_path / "good.txt").write_text(LINE + "\n" + LINE.replace("006", "012") + "\n")
    (tmp_path / "bad.txt").write_text(LINE + "\n" + LINE + ", 1\n")
    (tmp_path / "empty.txt").write_text("")
    rows = tracker.read_tracker(spark, str(tmp_path)).orderBy("forecast_hour").collect()
    assert [r.forecast_hour for r in rows] == [6, 12]
    r = rows[0]
    assert (r.lat, r.lon, r.basin, r.atcf_id, r.named, r.invest) == (20.1, -95.1, "AL", "AL182024", True, False)
    assert r.cps_b is None and r.cps_vtl == 31.0 and r.cps_vtu is None
    assert r.valid_time == datetime(2024, 10, 5, 6) and r.rmw == 40 * 1852.0
    p = tracker.track_points(tracker.read_tracker(spark, str(tmp_path))).first()
    assert p.closed_isobar_delta == 3.0 and p.wind_radii_34 == [111120.0, 92600.0, 0.0, 74080.0] and p.wind_radii_50 is None
    assert p.warm_core is True and p.tropical is False


def test_deck_lines(spark, tmp_path):
    (tmp_path / "a.dat").write_text(
        "AL, 18, 2024110400, 03, HFSA, 006, 152N, 0775W, 42, 1001, XX, 34, NEQ, 60, 40, 0, 50, 1008, 150, 30\n"
        "AL, 18, 2024110400, 02, OFCL, 006, 152S, 0775E, 0, 0\nAL, 18, 2024\n"
    )
    rows = deck.read_deck(spark, str(tmp_path)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.atcf_id, r.lat, r.lon, r.vmax10m, r.closed_isobar_delta) == ("AL182024", 15.2, -77.5, 42, 7)
    assert r.roci == 150 * 1852 and r.rmw == 30 * 1852 and r.speed is None and r.valid_time == datetime(2024, 11, 4, 6)


BULLETIN = """<html><pre class="x">
BULLETIN
Tropical Storm Rafael Intermediate Advisory Number   7A
NWS National Hurricane Center Miami FL       AL182024
1000 PM EST Mon Nov 04 2024

SUMMARY OF 1000 PM EST...0300 UTC...INFORMATION
----------------------------------------------
LOCATION...16.3N 76.5W
MAXIMUM SUSTAINED WINDS...50 MPH...85 KM/H
PRESENT MOVEMENT...NW OR 310 DEGREES AT 9 MPH...15 KM/H
MINIMUM CENTRAL PRESSURE...1000 MB...29.53 INCHES

WATCHES
LOCATION...1.0S 1.0E
</pre></html>"""


def test_bulletin(spark, tmp_path):
    (tmp_path / "a.html").write_text(BULLETIN)
    (tmp_path / "b.html").write_text("<pre>no report</pre>")
    (tmp_path / "c.html").write_text(BULLETIN.replace("Intermediate Advisory Number   7A", "Tropical Cyclone Update"))
    rows = {r.advisory: r for r in advisory.read_advisories(spark, str(tmp_path)).collect()}
    r = rows[True]
    assert (r.atcf_id, r.storm_name, r.init_storm_type) == ("AL182024", "Rafael", "Storm")
    assert r.advisory_time == datetime(2024, 11, 5, 3) and (r.lat, r.lon) == (16.3, -76.5)
    assert r.vmax_kt == pytest.approx(85 * 0.539956803) and r.mslp_hpa == 1000 and r.heading == 310
    assert rows[False].init_storm_type == "Tropical Storm"


def test_midnight_and_noon(spark):
    df = spark.createDataFrame([("1200", "AM", 0), ("1200", "PM", 12), ("1130", "AM", 11), ("0130", "PM", 13)], "t string, h string, want int")
    got = df.select("want", F.hour(advisory.local_to_utc(F.col("t"), F.col("h"), F.lit("AST"), F.lit("2024-Jul-1"))).alias("utc"))
    assert all((r.want + 4) % 24 == r.utc for r in got.collect())


def test_dimension_files(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"GFS": {"AL": {"WS": 16.0, "RV": 13.5}}}')
    (tmp_path / "c.json").write_text('{"NA": {"SD": [[1003.0, 52.5], [1004.0, 60.25]]}}')
    (tmp_path / "theta.csv").write_text("Lat,Jan,Feb,Mar,Apr,May,Jun,Jul,Aug,Sep,Oct,Nov,Dec\n10,1,2,3,4,5,6,7,8,9,10,11,12\n-10,0,0,0,0,0,0,0,0,0,0,0,0.5\n")
    assert dims.read_thresholds(spark, str(tmp_path / "t.json")).count() == 2
    assert [tuple(r) for r in dims.read_categories(spark, str(tmp_path / "c.json")).orderBy("mslp").collect()][1] == ("NA", "SD", 1004.0, 60.25)
    th = dims.read_theta(spark, str(tmp_path / "theta.csv"))
    assert th.filter("lat = -10 and month = 12").first().theta == 0.5 and th.count() == 24
    near = microwave.theta_lookup(spark.createDataFrame([(1.0, 4), (-1.0, 12), (0.0, 4)], "lat double, month int"), th)
    assert {(r.lat, r.theta) for r in near.collect()} == {(1.0, 4.0), (-1.0, 0.5), (0.0, 4.0)}


def test_inventory_reads_no_content(spark, tmp_path):
    for n in ("gfs.f012_a.grib2", "gfs.f018_a.idx"):
        (tmp_path / n).write_text("x")
    listed = files.list_files(spark, str(tmp_path)).withColumn("model_name", F.lit("GFS"))
    assert [r.time_step for r in files.inventory(listed).collect()] == [12]
    late = files.older_than(listed, F.timestamp_add("DAY", F.lit(3), F.current_timestamp()))
    assert late.count() == 1


def test_decks_are_written_in_order_of_their_runs(spark, tmp_path):
    from galespark.operators.catalog import adeck_lines

    lines = [f"AL, 0{n}, 20240{m}0100, 03, GFS, 0" for n in (1, 2) for m in (3, 1, 2)]
    writers.write_decks(adeck_lines(spark.createDataFrame([(x,) for x in lines], "value string")), str(tmp_path / "d"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "d" / "atcf_id=AL012024").glob("*.txt")))
    assert text.split() == " ".join(sorted(lines)[:3]).split()


def test_partition_overwrite_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    writers.overwrite_partitions(df, path, ["k"])
    writers.overwrite_partitions(df.filter("k = 2").withColumn("v", F.lit("c")), path, ["k"])
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}


def test_geojson_and_gzip(spark, tmp_path):
    n = spark.range(40).select(
        F.lit("METOP-B").alias("satellite"), F.col("id").alias("minute_id"), (F.col("id") * 1.5 - 30).alias("lat"), (F.col("id") * 1.0 + 160).alias("lon"),
        F.timestamp_add("MINUTE", F.col("id"), F.lit("2024-01-01").cast("timestamp")).alias("valid_time"),
    )
    q = passes.split_rings(passes.swath_quads(n)).withColumnRenamed("satellite", "satellite_name")
    lons = F.transform("ring", lambda p: p["lon"])
    assert q.filter((F.array_min(lons) < -180 - 1e-9) | (F.array_max(lons) > 180 + 1e-9)).count() == 0
    assert q.filter("poly_num = 1").count() > 0
    closed = q.filter(F.element_at("ring", 1) != F.element_at("ring", -1)).count()
    assert closed == 0
    writers.write_swaths(q, str(tmp_path / "g"))
    back = spark.read.json(str(tmp_path / "g"))
    assert back.count() == q.count() and {r.t for r in back.select(F.col("geometry.type").alias("t")).distinct().collect()} == {"Polygon"}


# ---------------------------------------------------------------- geometry


@settings(max_examples=60, deadline=None)
@given(st.floats(-80, 80), st.floats(-179, 179), st.floats(0, 359), st.floats(1000, 5e6))
def test_geodesic_direct_then_inverse(lat, lon, az, dist):
    lat2, lon2 = geodesic.direct([lat], [lon], [az], [dist])
    back, az2 = geodesic.inverse([lat], [lon], lat2, lon2)
    assert back[0] == pytest.approx(dist, abs=1e-3)
    assert (az2[0] - az + 180) % 360 - 180 == pytest.approx(0, abs=1e-6)


def test_known_geodesic_and_udf(spark):
    d, _ = geodesic.inverse([0.0], [0.0], [0.0], [1.0])
    assert d[0] == pytest.approx(111319.4908, abs=1e-3)
    df = spark.createDataFrame([(10.0, 20.0, 10.0, 20.0), (10.0, 20.0, 12.0, 25.0)], "a double, b double, c double, d double")
    rows = df.select(geodesic.wgs84_inverse("a", "b", "c", "d").alias("g"), geo.distance_m(*[F.col(c) for c in "abcd"]).alias("s")).collect()
    assert rows[0].g.distance_m == 0 and rows[1].g.distance_m == pytest.approx(rows[1].s, rel=5e-3)


def test_polygon_cover_with_general_ring(spark):
    tri = [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (0.0, 2.0), (-0.1, 1.0)], "lon double, lat double")
    got = [r.c for r in df.select(geo.covers(tri, F.col("lat"), F.col("lon")).alias("c")).collect()]
    assert got == [True, True, False, True, False]


def test_swath_sees_a_storm_on_both_sides_of_180(spark):
    n = spark.createDataFrame(
        [("HAIYANG-2B", i, datetime(2024, 1, 1) + timedelta(minutes=i), float(i), 179.9) for i in range(4)],
        "satellite string, minute_id long, valid_time timestamp, lat double, lon double",
    )
    q = passes.swath_quads(n)
    storm = lambda lon: spark.createDataFrame([("GFS", datetime(2024, 1, 1), 0, 120, 1.5, lon, 30000.0)],
        "model_name string, init_time timestamp, storm_no int, interp_id long, lat double, lon double, rmw double")
    assert passes.sensed(storm(-176.0), q).count() == 1
    assert passes.sensed(storm(176.0), q).count() == 1
    assert passes.sensed(storm(160.0), q).count() == 0


def test_lone_minutes_stay_unless_compatible(spark):
    ids = [0, 60, 120, 300, 600]
    m = spark.createDataFrame(
        [("GFS", datetime(2024, 1, 1), 0, "S", 0, 0, i, 10.0, 20.0, *([10.0 + i / 1e4, 20.0] * 4)) for i in ids],
        "model_name string, init_time timestamp, storm_no int, satellite string, pass_number int, side int, interp_id long, lat double, lon double,"
        + ", ".join(f"{k}_lat double, {k}_lon double" for k in "abcd"),
    )
    assert sorted(r.interp_id for r in passes.dedupe_sensing(m).collect()) == [0, 300, 600]
    assert sorted(r.interp_id for r in passes.dedupe_sensing(m, compat=True).collect()) == [0, 600]


# ---------------------------------------------------------------- sequences and ranks


def test_chunk_edges_do_not_show(spark):
    rng = random.Random(1)
    rows = [(k, t, rng.randrange(9)) for k in ("a", "b") for t in sorted(rng.sample(range(500), 120))]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    got = {(r.k, r.t): (r.prev.v if r.prev else None) for r in sequence.with_previous(df, ["k"], "t", ["v"], 37).collect()}
    total = {(r.k, r.t): r.s for r in sequence.running_sum(df, ["k"], "t", "v", "s", 37).collect()}
    for k in ("a", "b"):
        last, acc = None, 0
        for _, t, v in [r for r in rows if r[0] == k]:
            acc += v
            assert got[(k, t)] == last and total[(k, t)] == acc
            last = v


def test_ranks_and_quantiles_over_partition_edges(spark):
    rng = np.random.default_rng(2)
    data = [("hot" if i % 3 else f"g{i % 7}", float(v)) for i, v in enumerate(rng.normal(size=3000))]
    df = spark.createDataFrame(data, "k string, v double").repartition(8)
    q = {r.k: (r.a, r.b) for r in quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.9}).collect()}
    for k in {d[0] for d in data}:
        values = [v for g, v in data if g == k]
        assert q[k] == pytest.approx(tuple(np.quantile(values, [0.5, 0.9])))
    r = ranked(df, ["k"], ["v"])
    assert r.groupBy("k").agg(F.count_distinct("rank").alias("c"), F.max("n").alias("n")).filter("c <> n").count() == 0


# ---------------------------------------------------------------- products


def test_first_source_wins(spark):
    a = spark.createDataFrame([(1, 2.0)], "m int, v double")
    b = spark.createDataFrame([(1, 2.0), (1, 3.0)], "m int, v double")
    assert {(r.v, r.source_rank) for r in ensemble.merge_first([a, b], ["m", "v"]).collect()} == {(2.0, 0), (3.0, 1)}


def test_ensembles_hold_their_members():
    by = dims.ensemble_of_member()
    assert sum(v == "GEFS-TCGEN" for v in by.values()) == 32 + 1 and sum(v == "EPS-TCGEN" for v in by.values()) == 52 + 1
    assert by["AP30"] == "GEFS-TCGEN" and by["CMC"] == "GEPS-TCGEN" and by["NP20"] == "FNMOC-TCGEN"


def test_quality_masks(spark):
    df = spark.createDataFrame([(5.0, 0), (5.0, 1 << 17), (5.0, (1 << 24) - 1), (5.0, 1 << 5)], "s double, qc int")
    got = [r.m for r in df.select(winds.mask_speed(F.col("s"), F.col("qc"), ["knmi_quality_control_fails"]).alias("m")).collect()]
    assert got == [5.0, None, None, 5.0]


def test_coregistration_by_hand(spark):
    df = spark.createDataFrame([(1, 0, 10.0, 20.0), (1, 1, 10.5, 21.0), (2, 0, -9999.0, 20.0), (2, 1, 10.0, 20.0)], "scan int, pixel int, lat double, lon double")
    rows = {r.scan: r for r in microwave.coregister(df, 1.4, 0.25).collect()}
    vec = lambda la, lo: np.array([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])
    p, q = vec(*np.radians([10.0, 20.0])), vec(*np.radians([10.5, 21.0]))
    n = np.cross(p, q)
    n /= np.linalg.norm(n)
    t = np.arccos(p @ q)
    r = np.cos(0.25 * t) * (np.cos(1.4 * t) * p + np.sin(1.4 * t) * np.cross(n, p)) + np.sin(0.25 * t) * n
    assert rows[1].lat == pytest.approx(np.degrees(np.arcsin(r[2]))) and rows[1].lon == pytest.approx(np.degrees(np.arctan2(r[1], r[0])))
    assert rows[2].lat is None


def test_regrid_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    # one dense clump and a few far samples: some mesh points need wider tiles
    pts = np.concatenate([rng.normal(10, 0.1, (200, 2)), rng.uniform(0, 40, (6, 2))])
    s = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "f int, i int, lat double, lon double").withColumnRenamed("i", "sample")
    mesh = microwave.mesh_of(s, ["f"], 5, 5)
    got = {(r.i, r.j): r.sample for r in microwave.regrid_nearest(s, mesh, ["f"], ["sample"]).collect()}
    for r in mesh.collect():
        assert got[(r.i, r.j)] == int(np.argmin(((pts - [r.mlat, r.mlon]) ** 2).sum(axis=1)))


def test_coefficients(spark):
    c = spark.createDataFrame([("6G-1.518,7G--1.4,36G-0.5,99G-1",)], "t string").select(text_fn.coefficient_map(F.col("t")).alias("c")).first().c
    assert c == {"6G": 1.518, "7G": -1.4, "36G": 0.5}


def test_interpolation_between_and_beyond(spark):
    t0 = datetime(2024, 1, 1)
    d = spark.createDataFrame(
        [("S", "H", t0, t0 + timedelta(hours=h), 10.0, 20.0 + h / 6, 40 + h, 1000, 0, 5) for h in (0, 6, 12)],
        "storm_id string, model_id string, init_time timestamp, valid_time timestamp, lat double, lon double, vmax int, mslp int, dir int, speed int",
    )
    a = spark.createDataFrame(
        [("S", t0 + timedelta(hours=h), 10.0, 20.0, 50.0, 1000.0, 0.0, 5.0) for h in (-3, 3, 9, 30)],
        "storm_id string, advisory_time timestamp, lat double, lon double, vmax_kt double, mslp_hpa double, heading double, speed_kt double",
    )
    w = verify.advisory_weights(a)
    f = {r.advisory_time: r for r in verify.interpolate(verify.bracket(d, w)).collect()}
    at = lambda h: f[t0 + timedelta(hours=h)]
    assert [at(h).f_vmax for h in (-3, 3, 9, 30)] == [40.0, 43.0, 49.0, 52.0]
    assert at(3).pos_lon == pytest.approx(20.5, abs=1e-4) and at(30).pos_lon == 22.0
    old = {r.advisory_time: r for r in verify.interpolate(verify.bracket(d, w, compat=True), compat=True).collect()}
    assert old[t0 + timedelta(hours=9)].f_vmax == pytest.approx(40 * 0.25 + 52 * 0.75)


# ---------------------------------------------------------------- streams


def test_stream_picks_up_only_new_files(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "model_name string, init_time timestamp, time_step int"
    row = lambda s: spark.createDataFrame([("GFS", datetime(2024, 1, 1), s)], schema)
    for s in (0, 6):
        row(s).write.mode("append").parquet(src)
        steps = streams.run_steps(streams.files(spark, src, schema))
        streams.run_to_end(steps, streams.merge_latest(out, ["model_name", "init_time"], "n_steps", "init_time"), state)
    assert [(r.n_steps, r.last_step) for r in spark.read.parquet(out).collect()] == [(2, 6)]


def test_unchanged_listing_does_nothing(spark, tmp_path):
    listing = spark.createDataFrame([("/a", datetime(2024, 1, 1))], "path string, modificationTime timestamp")
    seen = []
    sink = lambda df: seen.append(df.count())
    path = str(tmp_path / "seen")
    assert streams.changed_only(listing, path, sink) and not streams.changed_only(listing, path, sink)
    newer = listing.withColumn("modificationTime", F.lit(datetime(2024, 1, 2)))
    assert streams.changed_only(newer, path, sink) and seen == [1, 1]


def test_mesh_of_a_file_without_positions_gets_null(spark):
    from galespark.operators import microwave

    rows = [("a", 0.0, 0.0, 1.0), ("a", 2.0, 2.0, 5.0), ("b", None, None, 3.0), ("b", float("nan"), 1.0, 4.0)]
    samples = spark.createDataFrame(rows, "file string, lat double, lon double, tb double")
    mesh = microwave.mesh_of(samples, ["file"], 2, 2)
    got = {(r.file, r.i, r.j): r.tb for r in microwave.regrid_nearest(samples, mesh, ["file"], ["tb"]).collect()}
    assert len(got) == 8 and {v for (f, _, _), v in got.items() if f == "b"} == {None}
    assert got["a", 0, 0] == 1.0 and got["a", 1, 1] == 5.0


def test_samples_without_attributes_or_month_stay(spark):
    from galespark.operators import microwave

    samples = spark.createDataFrame([("a", 10, 7), ("b", 20, None)], "file string, tb int, month int").withColumn("lat", F.lit(3.0))
    scaled = microwave.scale(samples, spark.createDataFrame([("a", 0.5)], "file string, scale_factor double"), "file", ["tb"])
    assert {r.file: r.tb for r in scaled.collect()} == {"a": 5.0, "b": None}
    theta = spark.createDataFrame([(7, 0.0, 0.8), (7, 10.0, 0.9)], "month int, lat double, theta double")
    assert {r.file: r.theta for r in microwave.theta_lookup(samples, theta).collect()} == {"a": 0.8, "b": None}


def test_one_row_of_a_new_key_is_inserted(spark):
    from galespark.operators import catalog

    stored = spark.createDataFrame([(1, 5)], "k int, v int")
    new = spark.createDataFrame([(1, 0), (2, 9), (2, 3), (3, 1)], "k int, v int")
    assert sorted(map(tuple, catalog.insert_absent(stored, new, ["k"], ["v"]).collect())) == [(2, 3), (3, 1)]
    assert len(catalog.absent(stored, new, ["k"]).collect()) == 3


def test_nearly_opposite_points_have_a_geodesic():
    import numpy as np
    from galespark.functions import geodesic

    rng = np.random.default_rng(1)
    n = 4000
    lat, lon, az = rng.uniform(-90, 90, n), rng.uniform(-180, 180, n), rng.uniform(-180, 180, n)
    way = np.concatenate([rng.uniform(0, 1.9970e7, n // 2), rng.uniform(1.985e7, 1.9970e7, n // 2)])
    lat[:300], az[:100], az[100:200], lat[-100:] = 0, 90, 0, 90  # along the equator and meridians, from the pole
    lat[300:400] = rng.uniform(-1e-6, 1e-6, 100)
    lat2, lon2 = geodesic.direct(lat, lon, az, way)
    dist, back = geodesic.inverse(lat, lon, lat2, lon2)
    assert np.abs(dist - way).max() < 1e-3
    again = geodesic.direct(lat, lon, back, dist)
    off = np.radians((again[1] - lon2 + 180) % 360 - 180) * np.cos(np.radians(lat2))
    assert 6.4e6 * np.hypot(np.radians(again[0] - lat2), off).max() < 1e-3
    opposite, _ = geodesic.inverse(lat, lon, -lat, lon + 180)  # half a meridian wherever one starts
    assert np.abs(opposite - 20003931.4586).max() < 1e-3
    dist, az = geodesic.inverse([0.0, 10.0, 1.0, np.nan], [0.0, 20.0, 2.0, 1.0], [0.0, 11.0, 1.0, 2.0], [179.5, 20.0, 2.0, 3.0])
    assert dist[0] == pytest.approx(19980861.9089, abs=1e-3) and 110_000 < dist[1] < 111_500 and dist[2] == 0 and np.isnan(dist[3])


def test_detection_names_a_missing_field(spark):
    from galespark.operators import grid

    cells = spark.createDataFrame([], "mslp double, u double, v double, gh250 double, gh850 double, u10 double, v10 double")
    with pytest.raises(ValueError, match="u925, v925"):
        grid.detect(cells, grid.Grid(3, 3, 0.0, 1.0, 1.0), cells)


def test_queries_leave_the_settings_alone(spark):
    from galespark.plans import registry

    before = spark.conf.getAll
    for name in ("track_summary", "stream_watermark"):
        registry.queries()[name](spark, "/root/testdata/sf0.001").count()
    assert spark.conf.getAll == before


def test_lead_days_without_a_legend():
    from galespark.functions import units

    assert units.lead_day_bin(F.lit(1000)) is not None


def test_components_of_runs_on_an_adverse_path(spark):
    from galespark.operators import track

    n, t = 1024, "timestamp'2024-01-01'"
    order = [0, *range(n - 1, 0, -1)]
    nodes = spark.range(n).selectExpr("'M' as model_name", f"{t} as init_time", "lpad(cast(id as string), 5, '0') as node_id", "cast(id as int) as time_step")
    links = spark.createDataFrame([(f"{a:05}", f"{b:05}") for a, b in zip(order, order[1:])], "src string, dst string")
    out = track.track_components(nodes, links.selectExpr("'M' as model_name", f"{t} as init_time", "src", "dst"))
    assert {r.label for r in out.select("label").distinct().collect()} == {"00000"} and out.count() == n


def test_parsed_tables_come_back_as_saved(spark, tmp_path):
    from galespark.session import remove
    from galespark.sinks import writers

    table = spark.createDataFrame([("a", 1, [1.5, None], datetime(2024, 1, 2)), ("b", None, None, None)], "k string, n int, v array<double>, t timestamp")
    writers.append(table, f"{tmp_path}/saved", ["k"])
    back = spark.read.schema(table.schema).parquet(f"{tmp_path}/saved").select(*table.columns)
    assert back.schema == table.schema and sorted(back.collect(), key=lambda r: r.k) == table.collect()
    remove(spark, f"{tmp_path}/saved")
    assert not (tmp_path / "saved").exists()


def test_old_partitions_are_dropped(spark, tmp_path):
    table = spark.createDataFrame([(i, f"2024-01-{i:02}") for i in range(1, 6)], "v int, day string")
    writers.overwrite_partitions(table, f"{tmp_path}/t", ["day"])
    assert writers.drop_partitions(spark, f"{tmp_path}/t", "day", "2024-01-03") == ["2024-01-01", "2024-01-02"]
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [3, 4, 5]
    assert writers.drop_partitions(spark, f"{tmp_path}/t", "day", "2024-01-03") == []


def test_ensembles_have_all_their_members(spark, tmp_path):
    """The fourth model belongs to an ensemble as the others do."""
    start = datetime(2024, 1, 2)
    rows = [(i, 30 * n, start + timedelta(days=d), "view", 10.0) for i, (n, d) in enumerate((n, d) for n in range(8) for d in range(9))]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.ensemble_name: r.n_members for r in runs.ensemble_cycles(spark, str(tmp_path)).collect()}
    assert got == {"E0": 3, "E1": 3, "E2": 2}
    tracks = runs.tracks_current_ensemble(spark, str(tmp_path)).collect()
    assert tracks and all(r.ensemble_name is not None for r in tracks)


def nadir_rows(spark, n, twice=()):
    """Paths of two satellites with standstills and gaps, over several chunks."""
    rng = random.Random(4)
    rows = []
    for sat in ("SAT0", "SAT1"):
        lat, way = 0.0, 1
        for m in range(n):
            if rng.random() < 0.02:
                way = -way
            lat += way * rng.choice([0, 0.5, 0.5, 0.5])
            if rng.random() < 0.95:
                rows += [(sat, m, datetime(2024, 1, 1) + timedelta(minutes=m), round(lat, 1), (m * 3.7) % 360 - 180)] * (2 if m in twice else 1)
    return spark.createDataFrame(rows, "satellite string, minute_id bigint, valid_time timestamp, lat double, lon double"), rows


def test_passes_are_numbered_over_chunk_edges(spark, monkeypatch):
    monkeypatch.setattr(passes, "MINUTES_PER_CHUNK", 7)
    frame, rows = nadir_rows(spark, 400)
    want = set()
    for sat in ("SAT0", "SAT1"):
        before, number, way = None, 0, 0
        for _, m, _, lat, _ in sorted(r for r in rows if r[0] == sat):
            if before is not None:
                now = (lat > before[1]) - (lat < before[1])
                number += bool(now and way and now != way)
                way = now or way
                want.add((sat, m, before[0], number, now > 0))
            before = m, lat
    s = passes.steps(frame)
    assert {(r.satellite, r.minute_id, r.start.minute_id, r.pass_number, r.ascending) for r in s.collect()} == want
    # the path is shuffled by chunk once; the other exchanges carry a row per chunk or use it again
    assert s._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning(satellite") <= 5


def test_sensed_tracks_are_the_sensed_minutes(spark):
    frame, _ = nadir_rows(spark, 900)
    quads = passes.swath_quads(frame, {"SAT0": (336000, 550000), "SAT1": (0, 900000)}).cache()
    rng = random.Random(9)
    points = [(f"M{k}", datetime(2024, 1, 1), 0, datetime(2024, 1, 1, h), rng.uniform(-40, 40), rng.uniform(-180, 180), 20.0 + h, 40000, 200000 if h % 2 else None)
              for k in range(12) for h in (0, 5, 6, 14)]
    storms = spark.createDataFrame(points, "model_name string, init_time timestamp, storm_no int, valid_time timestamp, lat double, lon double, vmax double, rmw int, roci int")
    got, want = passes.sensed_tracks(storms, quads), passes.sensed(passes.minutes(storms), quads)
    cols = [*passes.TRACK, "interp_id", "satellite", "side", "pass_number", "lat", "lon", "vmax", "roci"]
    rows = sorted(map(tuple, want.select(*cols).collect()))
    assert sorted(got.columns) == sorted(want.columns) and len(rows) > 20
    assert sorted(map(tuple, got.select(*cols).collect())) == rows
    assert "hashpartitioning(interp_id" not in got._jdf.queryExecution().executedPlan().toString()  # minutes are not shuffled


def test_log_of_passes_has_a_partition_per_start(spark, tmp_path):
    """Not one per model and start: sixty times the models are not sixty times the files."""
    start = [datetime(2024, 1, d) for d in (1, 2)]
    schema = "model_name string, init_time timestamp, pass_number int"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    runs_of = [(f"M{k}", t) for k in range(20) for t in start]
    known = lambda rows: spark.createDataFrame(rows, "model_name string, init_time timestamp")
    writers.log_passes(known(runs_of), frame([(m, t, 1) for m, t in runs_of[:30]]), f"{tmp_path}/log")
    again = [("M3", start[0]), (None, start[0]), ("M4", start[1])]
    writers.log_passes(known(again), frame([("M3", start[0], 7), ("M3", start[0], 8)]), f"{tmp_path}/log")
    got = sorted(((r.model_name or "", r.init_time, r.pass_number or 0) for r in spark.read.parquet(f"{tmp_path}/log").collect()))
    kept = [(m, t, 1 if (m, t) in runs_of[:30] else 0) for m, t in runs_of if (m, t) not in again]
    assert got == sorted([*kept, ("M3", start[0], 7), ("M3", start[0], 8), ("", start[0], 0), ("M4", start[1], 0)])
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if p.is_dir()) == ["run=2024-01-01T0000", "run=2024-01-02T0000"]


def test_regridding_broadcasts_no_mesh(spark, monkeypatch):
    """A mesh shrinks to a few bytes a point in a shuffle, not in a broadcast."""
    plans, write = [], microwave.cut

    def seen(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(microwave, "cut", seen)
    rng = random.Random(1)
    s = spark.createDataFrame([(k % 2, k, 1, rng.uniform(0, 5), rng.uniform(0, 5)) for k in range(60)], "file_no int, scan int, pixel int, lat double, lon double")
    assert microwave.regrid_nearest(s, microwave.mesh_of(s, ["file_no"], 4, 4), ["file_no"], ["scan", "pixel"]).count() == 32
    assert len(plans) > 4 and not any("BroadcastHashJoin" in p.split("Initial Plan")[0] for p in plans)


def test_boxes_broadcast_no_cells(spark):
    cells = spark.createDataFrame([("M", 0, 0, x, y, 1.0 * x, 0.0, float(x * 7 % 5 + y)) for x in range(6) for y in range(6)],
                                  "model_name string, init_time int, time_step int, x int, y int, lat double, lon double, v double")
    field = grid.strips(cells, ["lon", "v"])
    got = grid.box_extreme(cells.select(*grid.CELL, "lat"), field, "v", "best", 1, 6)
    best = {(r.x, r.y): r.best for r in got.collect()}
    assert best[2, 2] == max(float(x * 7 % 5 + y) for x in (1, 2, 3) for y in (1, 2, 3)) and len(best) == 36
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_bracket_meets_one_stretch_of_each_run(spark):
    """Points and advisories without time among others; only stretches go into the join, without arrays of points."""
    at = lambda h: None if h is None else datetime(2024, 1, 1 + h // 24, h % 24)
    runs = {"A": [None, 6, 12, 30], "B": [12], "C": [None], "D": [0, 3]}
    rows = [("S", m, at(0), at(h), float(i), 0.0, i, i, i, i) for m, hours in runs.items() for i, h in enumerate(hours)]
    deck = spark.createDataFrame(rows, "storm_id string, model_id string, init_time timestamp, valid_time timestamp, lat double, lon double, vmax int, mslp int, dir int, speed int")
    hours = [None, 0, 3, 6, 7, 12, 29, 30, 40]
    given = spark.createDataFrame([(s, at(h)) for s in ("S", None, "X") for h in hours], "storm_id string, advisory_time timestamp")
    got = verify.bracket(deck, given)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "points" not in plan.split("Join Inner")[0]
    found = {(r.model_id, r.advisory_time): (r.prior.vmax, r.future.vmax, r.inside) for r in got.collect()}
    want = {}
    for m, own in runs.items():
        for h in hours:
            k, last = sum(x is not None and h is not None and x <= h for x in own), len(own) - 1
            want[m, at(h)] = max(k - 1, 0), min(k, last), 1 <= k <= last
    assert found == want and got.count() == len(want)


def test_minutes_are_spread_and_lie_on_the_great_circle(spark):
    rows = [("A", datetime(2024, 1, 1), k, datetime(2024, 1, 1, h), lat, lon, 20.0 + h, 40000, None) for k, track in enumerate(
        ([(10.0, 179.5), (12.0, -179.0)], [(-30.0, 5.0), (-30.0, 5.0)], [(89.5, 0.0), (89.5, 170.0)])) for h, (lat, lon) in zip((0, 6), track)]
    storms = spark.createDataFrame(rows, "model_name string, init_time timestamp, storm_no int, valid_time timestamp, lat double, lon double, vmax double, rmw int, roci int")
    found = passes.minutes(storms)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()  # tasks are not folded by the size of the pieces
    step = F.col("dist") * F.col("i") / F.col("n")
    p = passes._pieces(storms).withColumn("i", F.explode(F.sequence("i0", "i1")))
    moved = [F.when(F.col("dist") > 0, to).otherwise(F.col(c)) for c, to in (
        ("lat", geo.dest_lat(F.col("lat"), F.col("az"), step)), ("lon", geo.dest_lon(F.col("lat"), F.col("lon"), F.col("az"), step)))]
    second = F.unix_timestamp("valid_time") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + 60 * F.col("i")
    want = {(r[0], r[1]): r for r in p.select("storm_no", second, *moved).collect()}
    got = {(r.storm_no, r.interp_id): r for r in found.collect()}
    assert got.keys() == want.keys() and len(got) == 3 * 360
    for k, r in got.items():
        assert r.lat == pytest.approx(want[k][2], abs=1e-9) and r.lon == pytest.approx(want[k][3], abs=1e-9)
        assert (r.minute_time - datetime(2024, 1, 1)).total_seconds() == r.interp_id


def test_fields_of_a_cell_are_one_row_of_one_shuffle(spark, monkeypatch):
    written = []
    monkeypatch.setattr(grid_rows, "cut", lambda df: written.append(df) or df.cache())
    every = [(p, lv) for p, lv in grid_rows.FIELDS]
    rows = [("A", datetime(2024, 1, 1), s, x, 0, p, lv, "Pa" if p == "prmsl" else "m/s", 100.0 * (x + 1))
            for s in range(5) for x in range(2) for p, lv in every if not (s == 1 and p == "gh") and not (s == 2 and (p, lv, x) == ("u", 10, 0))]
    rows += [("A", datetime(2024, 1, 1), 3, 0, 0, "absv", 850, "1/s", 0.5), ("A", datetime(2024, 1, 1), 0, 0, 0, "other", 1, "x", 9.0)]
    rows += [("A", datetime(2024, 1, 1), 4, x, 0, "absv", 850, "1/s", 0.5) for x in range(2)]
    long = spark.createDataFrame(rows, "model_name string, init_time timestamp, time_step int, x int, y int, param string, level int, unit string, value double")
    got = {(r.time_step, r.x): (r.mslp, r.v10, r.vort850) for r in grid_rows.select_fields(long).collect()}
    # no geopotential, a cell short, an optional field in half the cells: these steps go whole
    assert got == {(s, x): (x + 1.0, 100.0 * (x + 1), v) for s, v in ((0, None), (4, 0.5)) for x in range(2)}
    assert [len(w.columns) for w in written] == [5 + 2 * 10, 3]


def test_sessions_meet_the_storms_of_their_hours(spark):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    spans = [("A", 0, 10), ("A", 29, 91), ("A", 300, 3000), ("B", 60, 60), ("B", 90, 100)]
    times = [(k, m) for k in "AB" for m in (0, 29, 30, 40, 41, 60, 90, 121, 122, 130, 131, 269, 270, 1000, 3030, 3031)]
    sessions = spark.createDataFrame([(k, (at(a), at(b)), 1) for k, a, b in spans], "k string, w struct<start timestamp, end timestamp>, n long")
    storms = spark.createDataFrame([(k, at(m)) for k, m in times], "k string, t timestamp")
    hits = streams.storms_in_sessions(sessions, storms, ["k"], "t")
    want = sorted((k, at(a), at(b), 1, at(m)) for k, a, b in spans for j, m in times if j == k and a - 30 <= m <= b + 30)
    assert hits.columns == ["k", "first", "closed", "n", "t"] and sorted(map(tuple, hits.collect())) == want
    join = next(x for x in hits._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x)
    assert "hour" in join  # a session does not meet all storm points of its model


def storms_of(spark, rng):
    points = [(f"M{k}", datetime(2024, 1, 1), 0, datetime(2024, 1, 1, h), rng.uniform(-40, 40), rng.uniform(-180, 180), 20.0 + h, 40000, 200000)
              for k in range(12) for h in (3, 5, 6, 11)]
    return spark.createDataFrame(points, "model_name string, init_time timestamp, storm_no int, valid_time timestamp, lat double, lon double, vmax double, rmw int, roci int")


def test_swaths_of_a_span_keep_their_passes(spark, monkeypatch):
    """Only the steps and areas of the span become rows; passes are numbered over the whole path."""
    monkeypatch.setattr(passes, "MINUTES_PER_CHUNK", 50)
    frame, _ = nadir_rows(spark, 900)
    storms, sats = storms_of(spark, random.Random(4)), {"SAT0": (336000, 550000), "SAT1": (0, 900000)}
    within = F.col("valid_time").between(datetime(2024, 1, 1, 3), datetime(2024, 1, 1, 11))
    for build in (passes.steps, lambda n, **k: passes.swath_quads(n, sats, **k)):
        got, want = build(frame, during=passes.span_of(storms)), build(frame).filter(within)
        assert got.count() == want.count() > 300
        assert got.exceptAll(want).isEmpty()
    assert passes.predict(storms, frame, sats).exceptAll(passes.dedupe_sensing(passes.sensed_tracks(storms, passes.swath_quads(frame, sats)))).isEmpty()


@pytest.mark.parametrize("held", [0, 1 << 30])
def test_pieces_meet_areas_in_small_methods(spark, monkeypatch, held):
    """Few areas are broadcast, more are merged; either way the machine code of
    the test of a pair is compiled, for which a method has 8,000 bytes at most."""
    monkeypatch.setattr(passes, "HELD_AREAS", held)
    frame, _ = nadir_rows(spark, 900)
    storms, quads = storms_of(spark, random.Random(5)), passes.swath_quads(frame, {"SAT0": (336000, 550000), "SAT1": (0, 900000)}).cache()
    got, want = passes.sensed_tracks(storms, quads), passes.sensed(passes.minutes(storms), quads)
    cols = [*passes.TRACK, "interp_id", "satellite", "side", "pass_number", "lat", "lon", "vmax"]
    assert got.count() == want.count() > 20 and got.select(*cols).exceptAll(want.select(*cols)).isEmpty()
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(passes.sensed_tracks(storms, quads)._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert 0 < max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text))) < 8000


def test_whole_numbers_are_those_of_round(spark):
    values = [0.0, 0.3, 0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -0.49999999999999994, 179.99999999999997, None]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert all(r.a == r.b for r in frame.select(passes._whole(F.col("v")).alias("a"), F.round("v").alias("b")).collect())
