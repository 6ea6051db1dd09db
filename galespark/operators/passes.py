"""Satellite passes: segments, swaths, minute tracks, sensing."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galespark.functions import geo, units
from galespark.operators.sequence import islands
from galespark.session import broadcast_if_small, cut

# fixed values: satellite -> nadir gap and swath width to each side, metres
SWATHS = {
    "METOP-B": (336000, 550000),
    "METOP-C": (336000, 550000),
    "HAIYANG-2B": (0, 900000),
    "HAIYANG-2C": (0, 900000),
    "OCEANSAT-3": (0, 900000),
}
TRACK = ["model_name", "init_time", "storm_no"]
MINUTES_PER_CHUNK = 1440
SLOT_SECONDS, SLOTS_PER_KEY = 600, 18  # slots of three hours meet under one key
HELD_AREAS = 200_000  # areas, or chunks of paths, that may be broadcast
CORNERS = ["a", "b", "c", "d"]


# ---------------------------------------------------------------- passes


def span_of(points: DataFrame) -> tuple[Column, Column]:
    """First and last moment of some tracks."""
    span = points.agg(F.min("valid_time").alias("t0"), F.max("valid_time").alias("t1"))
    return span.select("t0").scalar(), span.select("t1").scalar()


def _chunk(order: str) -> Column:
    return F.floor(F.col(order) / MINUTES_PER_CHUNK)


def _way(here: str, before: str) -> Column:
    return F.signum(F.col(here) - F.col(before)).cast("int")


def _moved(c: str) -> Column:
    return F.when(F.col(c) != 0, F.col(c))


def _within_chunks(nadir: DataFrame, order: str) -> DataFrame:
    """What a chunk of a path knows by itself of its steps."""
    w = Window.partitionBy("satellite", "chunk").orderBy(order)
    minute = Window.partitionBy("satellite", "chunk", order)
    s = nadir.withColumn("chunk", _chunk(order)).withColumn("point", F.struct(order, "lat", "lon", "valid_time"))
    s = s.withColumns({"start": F.lag("point").over(w), "place": F.row_number().over(w), "twins": F.count(F.lit(1)).over(minute)})
    s = s.withColumn("way", _way("lat", "start.lat"))
    s = s.withColumn("before", F.last(_moved("way"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("turn", F.max(F.coalesce(_moved("way") != F.col("before"), F.lit(False)).cast("int")).over(minute))
    return s.withColumn("turns", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def steps(nadir: DataFrame, order: str = "minute_id", during: tuple[Column, Column] | None = None) -> DataFrame:
    """Consecutive nadir points with the number and direction of their pass.

    A pass ends where the latitude turns; a step without any change of
    latitude continues the pass.

    Paths are shuffled once, by chunks. What a chunk cannot know by itself, the
    point and the direction before it and the passes so far, comes from one
    small row per chunk. All rows of a minute in which the path turns count, so
    a minute that comes twice numbers two passes. Of a time span (``during``)
    all chunks are numbered, but only the steps of its own become rows."""
    key = ["satellite", "chunk"]
    s = _within_chunks(nadir, order)
    moves = F.when(F.col("way") != 0, F.col("place"))
    ends = s.groupBy(*key).agg(
        F.min_by("point", "place").alias("head"), F.max_by("point", "place").alias("tail"), F.min_by("twins", "place").alias("head_rows"),
        F.min_by(F.struct("way", "place", "twins"), moves).alias("first"), F.max_by("way", moves).alias("last_way"), F.max("turns").alias("inside"),
        *([F.min("valid_time").alias("since"), F.max("valid_time").alias("until")] if during else []),
    )
    v = Window.partitionBy("satellite").orderBy("chunk")
    before = v.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("start0", F.lag("tail").over(v)).withColumn("way0", _way("head.lat", "start0.lat"))
    ends = ends.withColumn("carried", F.last(F.coalesce("last_way", _moved("way0")), ignorenulls=True).over(before))
    turns = lambda now, then: F.coalesce(now != then, F.lit(False)).cast("int")
    # turns that only the chunk before shows: at the first minute, and where the path first moves within the chunk
    ends = ends.withColumns({"turn0": turns(_moved("way0"), F.col("carried")), "turn1": turns(F.col("first.way"), F.coalesce(_moved("way0"), "carried"))})
    total = F.col("inside") + F.col("turn0") * F.col("head_rows") + F.col("turn1") * F.coalesce("first.twins", F.lit(0))
    ends = ends.withColumn("passed", F.coalesce(F.sum(total).over(before), F.lit(0)))
    ends = ends.drop("head", "tail", "last_way", "inside", "carried")
    if during:
        ends = cut(ends.filter((F.col("until") >= during[0]) & (F.col("since") <= during[1])).drop("since", "until"))
        chunks = broadcast_if_small(ends.select(F.col("satellite").alias("of"), F.col("chunk").alias("nth")), HELD_AREAS)
        s = _within_chunks(nadir.join(chunks, (F.col("satellite") == F.col("of")) & (_chunk(order) == F.col("nth")), "left_semi"), order)
    s = s.join(ends, key)
    at_head = F.col("place") == 1
    since_first = F.greatest(F.lit(0), F.least(F.col("place") - F.col("first.place") + 1, F.col("first.twins")))
    number = (
        F.col("passed") + F.col("turns") + F.col("turn0") * F.least("place", "head_rows")
        + F.col("turn1") * F.when(F.col("first").isNotNull(), since_first).otherwise(0)
    )
    s = s.withColumns({"start": F.when(at_head, F.col("start0")).otherwise(F.col("start")), "way": F.when(at_head, F.col("way0")).otherwise(F.col("way")), "pass_number": number})
    s = s.filter(F.col("start").isNotNull())
    if during:
        s = s.filter(F.col("valid_time").between(*during))
    return s.select(*nadir.columns, "start", "way", "pass_number", (F.col("way") > 0).alias("ascending"))


def pass_points(nadir: DataFrame, order: str = "minute_id") -> DataFrame:
    """Points of each pass in order; a turning point belongs to both passes."""
    s = steps(nadir, order)
    ends = s.select("satellite", "pass_number", "ascending", order, "lat", "lon")
    starts = s.select("satellite", "pass_number", "ascending", *[F.col(f"start.{c}").alias(c) for c in (order, "lat", "lon")])
    return starts.unionByName(ends).distinct()


# ---------------------------------------------------------------- swaths


def swath_quads(
    nadir: DataFrame, swaths: dict[str, tuple[float, float]] = SWATHS, epoch: str = "2024-01-01", during: tuple[Column, Column] | None = None
) -> DataFrame:
    """Swath areas between consecutive nadir points: one on each side of the
    blind range, or one across where there is none. Corners keep unrolled
    longitudes, so an area never jumps at the antimeridian. ``during`` is a time
    span of which areas are wanted, such as that of the storms they are to meet."""

    def side(n, near_turn, near, far_turn, far):
        return F.struct(
            F.lit(n).alias("side"), F.lit(float(near_turn)).alias("near_turn"), F.lit(float(near)).alias("near"),
            F.lit(float(far_turn)).alias("far_turn"), F.lit(float(far)).alias("far"),
        )

    areas = {}
    for name, (blind, width) in swaths.items():
        if blind:
            areas[name] = F.array(side(0, -90, blind, -90, blind + width), side(1, 90, blind, 90, blind + width))
        else:
            areas[name] = F.array(side(0, 90, width, -90, width))
    pick = F.lit(None)
    for name, area in areas.items():
        pick = F.when(F.col("satellite") == name, area).otherwise(pick)
    s = steps(nadir, during=during).select(
        "satellite", "pass_number", F.col("ascending").cast("int").alias("ascending"), "valid_time", "lat",
        (F.col("start.lon") + units.signed_lon(F.col("lon") - F.col("start.lon"))).alias("lon"),
        F.col("start.lat").alias("lat0"), F.col("start.lon").alias("lon0"),
        (F.unix_timestamp("valid_time") - F.unix_timestamp(F.lit(epoch).cast("timestamp"))).alias("interp_id"),
    )
    s = s.withColumn("az", geo.azimuth_deg(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")))
    s = s.withColumn("s", F.explode(pick)).select("*", "s.*").drop("s")
    at = {"a": ("0", "near"), "b": ("0", "far"), "c": ("", "far"), "d": ("", "near")}
    cols = {}
    for k, (p, edge) in at.items():
        lat, lon = F.col(f"lat{p}"), F.col(f"lon{p}")
        az = F.col("az") + F.col(f"{edge}_turn")
        cols[f"{k}_lat"] = geo.dest_lat(lat, az, F.col(edge))
        cols[f"{k}_lon"] = lon + geo.dest_dlon(lat, az, F.col(edge))
    return s.select(
        "satellite", "pass_number", "ascending", "side", "interp_id", "valid_time", *[c.alias(n) for n, c in cols.items()]
    )


def ring(quads: DataFrame) -> DataFrame:
    """Corners as a closed counter-clockwise ring."""
    pts = [F.struct(F.col(f"{k}_lon").alias("lon"), F.col(f"{k}_lat").alias("lat")) for k in [*CORNERS, "a"]]
    return quads.withColumn("ring", geo.counter_clockwise(F.array(*pts)))


def split_rings(quads: DataFrame) -> DataFrame:
    """One row per part after cutting at the antimeridian."""
    r = ring(quads)
    return r.select(
        *[c for c in r.columns if c != "ring"], F.posexplode(geo.split_at_antimeridian(F.col("ring"))).alias("poly_num", "ring")
    )


def time_window(swaths: DataFrame, as_of: Column, before_hours: int, after_hours: int, satellites: list[str]) -> DataFrame:
    """Swaths of some satellites round a moment; unreadable times drop out."""
    span = F.col("valid_time").between(
        F.timestamp_add("HOUR", F.lit(-before_hours), as_of), F.timestamp_add("HOUR", F.lit(after_hours), as_of)
    )
    return swaths.filter(span & F.col("satellite").isin(satellites))


# ---------------------------------------------------------------- minute tracks


def _pieces(points: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Tracks from point to point, with the first and last whole minute (within
    a time span, if there is one), the way they go and its direction."""
    w = Window.partitionBy(*TRACK).orderBy("valid_time")
    cols = ["valid_time", "lat", "lon", "vmax", "rmw", "roci"]
    p = points.select(*TRACK, *cols).withColumn("z", F.lead(F.struct(*cols)).over(w)).filter(F.col("z").isNotNull())
    seconds = F.unix_timestamp("z.valid_time") - F.unix_timestamp("valid_time")
    p = p.withColumn("n", F.floor(seconds / 60).cast("int")).filter(F.col("n") > 0)
    first, last = F.lit(0), F.col("n") - 1
    if start is not None:
        since = lambda t: (F.unix_timestamp(t) - F.unix_timestamp("valid_time")) / 60
        first, last = F.greatest(first, F.ceil(since(start)).cast("int")), F.least(last, F.floor(since(end)).cast("int"))
    p = p.withColumns({"i0": first, "i1": last}).filter(F.col("i0") <= F.col("i1"))
    a, z = [F.col("lat"), F.col("lon")], [F.col("z.lat"), F.col("z.lon")]
    return p.withColumns({"dist": geo.distance_m(*a, *z), "az": geo.azimuth_deg(*a, *z)})


def _headed(pieces: DataFrame) -> DataFrame:
    """Pieces with the sines and cosines that all their minutes share."""
    turns = {f"{fn}_{c}": getattr(F, fn)(F.radians(c)) for fn in ("sin", "cos") for c in ("lat", "az")}
    return pieces.withColumns(turns)


def _since(epoch: str) -> Column:
    """Start of a piece in seconds."""
    return F.unix_timestamp("valid_time") - F.unix_timestamp(F.lit(epoch).cast("timestamp"))


def _at_minute(pieces: DataFrame, *further: str) -> DataFrame:
    """Pieces (:func:`_headed`, with ``since``) at their minute ``i``: place, wind and radii in between.

    The place is that of ``geo.dest_lat`` and ``geo.dest_lon``, each sine taken once."""
    p = pieces.withColumn("share", F.col("i") / F.col("n"))
    p = p.withColumn("arc", F.col("dist") * F.col("share") / F.lit(geo.EARTH_RADIUS_M))
    p = p.withColumns({"sin_arc": F.sin("arc"), "cos_arc": F.cos("arc")})
    up = F.col("sin_lat") * F.col("cos_arc") + F.col("cos_lat") * F.col("sin_arc") * F.col("cos_az")
    p = p.withColumn("sin_to", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), up)))
    east = F.atan2(F.col("sin_az") * F.col("sin_arc") * F.col("cos_lat"), F.col("cos_arc") - F.col("sin_lat") * F.col("sin_to"))
    blend = lambda x, y: x + F.col("share") * (y - x)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    moved = F.col("dist") > 0
    return p.select(
        *TRACK, F.timestamp_add("MINUTE", F.col("i"), F.col("valid_time")).alias("minute_time"),
        (F.col("since") + F.lit(60).cast("bigint") * F.col("i")).alias("interp_id"),
        F.when(moved, F.degrees(F.asin("sin_to"))).otherwise(F.col("lat")).alias("lat"),
        F.when(moved, units.signed_lon(F.col("lon") + F.degrees(east))).otherwise(F.col("lon")).alias("lon"),
        blend(F.col("vmax"), F.col("z.vmax")).alias("vmax"), blend(F.col("rmw"), F.col("z.rmw")).alias("rmw"),
        blend(zero("roci"), zero("z.roci")).alias("roci"), *further,
    )


def minutes(points: DataFrame, start: Column | None = None, end: Column | None = None, epoch: str = "2024-01-01") -> DataFrame:
    """Tracks at every minute, end points left out. A missing closed-isobar
    radius counts as 0. With a time span, minutes outside are never made.

    Pieces are few bytes and many minutes: they are spread by number, which the
    adaptive planner does not fold to a few tasks by their size."""
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = _headed(_pieces(points.repartition(parts, *TRACK), start, end).withColumn("since", _since(epoch)))
    return _at_minute(p.withColumn("i", F.explode(F.sequence("i0", "i1"))))


def close_pieces(pieces: DataFrame, quads: DataFrame, epoch: str) -> DataFrame:
    """Track pieces at each minute ``i`` whose swath area comes near, with the
    area; ``since`` is the start of the piece in seconds.

    A slot of ten minutes has a few boxes only, one for each satellite and side,
    and its box carries its areas. Pieces meet the boxes of their hours, and what
    is near opens to the areas, so that pieces are dealt out once at most, and
    not at all where the areas are few. The piece's box is its start grown by the way it goes and its
    radius; it holds every minute of it."""
    corner = {c: [F.col(f"{k}_{c}") for k in CORNERS] for c in ("lat", "lon")}
    west, east = F.least(*corner["lon"]), F.greatest(*corner["lon"])
    areas = quads.drop("valid_time").withColumnRenamed("interp_id", "at")
    own = [c for c in areas.columns if c not in ("satellite", "side")]
    box = {"south": F.least(*corner["lat"]), "north": F.greatest(*corner["lat"]), "middle": (west + east) / 2, "half": (east - west) / 2}
    areas = areas.withColumns(box | {"slot": F.floor(F.col("at") / SLOT_SECONDS)})
    middle, half = (F.min(west) + F.max(east)) / 2, (F.max(east) - F.min(west)) / 2
    boxes = areas.groupBy("slot", "satellite", "side").agg(
        F.min("south").alias("box_south"), F.max("north").alias("box_north"), middle.alias("box_middle"), half.alias("box_half"),
        F.collect_list(F.struct(*own, *box)).alias("areas"),
    )
    boxes = boxes.withColumn("in_hours", F.floor(F.col("slot") / SLOTS_PER_KEY))
    reach = (F.col("dist") + F.greatest("rmw", "z.rmw")) * 1.01 + 1000
    slot = lambda i: F.floor((F.col("since") + 60 * F.col(i)) / SLOT_SECONDS)
    p = pieces.select("*", _apart({"since": _since(epoch), "dlat": reach / units.M_PER_DEGREE * 1.01}))
    narrow = F.cos(F.radians(F.least(F.lit(89.9), F.abs("lat") + F.col("dlat"))))
    p = p.withColumns({"dlon": F.col("dlat") / narrow, "s0": slot("i0"), "s1": slot("i1")})
    p = p.withColumn("hours", F.explode(F.sequence(F.floor(F.col("s0") / SLOTS_PER_KEY), F.floor(F.col("s1") / SLOTS_PER_KEY))))

    def near(of: str) -> Column:
        south, north, middle, half = (F.col(f"{of}{c}") for c in ("south", "north", "middle", "half"))
        level = (F.col("lat") - F.col("dlat") <= north) & (F.col("lat") + F.col("dlat") >= south)
        return level & (F.abs(units.signed_lon(F.col("lon") - middle)) <= half + F.col("dlon"))

    # rows of pieces shrink so well in a shuffle that a broadcast of them looks cheaper than it is
    boxes = F.broadcast(boxes) if quads.count() <= HELD_AREAS else boxes.hint("merge")
    p = p.join(boxes, (F.col("hours") == F.col("in_hours")) & F.col("slot").between(F.col("s0"), F.col("s1")) & near("box_"))
    p = p.select(*pieces.columns, "since", "dlat", "dlon", "satellite", "side", F.inline("areas")).filter(near(""))
    p = p.withColumn("i", F.col("at") - F.col("since")).filter("i % 60 = 0 and i between 60 * i0 and 60 * i1")
    return p.withColumn("i", (F.col("i") / 60).cast("int")).drop("dlat", "dlon", "at", *box)


def storm_box(lat: Column, lon: Column, radius: Column) -> dict[str, Column]:
    """Bounding box of a radius: geodesic north and south, cosine east and west."""
    dlon = geo.metres_to_lon_degrees(lat, radius)
    return {
        "north": geo.dest_lat(lat, F.lit(0.0), radius), "south": geo.dest_lat(lat, F.lit(180.0), radius),
        "east": lon + dlon, "west": lon - dlon,
    }


def sensed(storms: DataFrame, quads: DataFrame, radius: str = "rmw") -> DataFrame:
    """Storm minutes whose circle meets a swath of the same minute.

    An equi-join on the minute. Bounding boxes come first, then the centre inside the convex area or an edge of it
    within the radius, on the local plane round the storm."""
    return _meeting(storms.join(quads.drop("valid_time"), "interp_id"), radius)


def _whole(x: Column) -> Column:
    """``F.round`` to whole numbers, halves away from zero, without decimals in between."""
    up = F.floor(F.abs(x) + 0.5)
    return F.signum(x) * F.when(up - 0.5 > F.abs(x), up - 1).otherwise(up)  # the sum above may be rounded up


def _meeting(hits: DataFrame, radius: str = "rmw") -> DataFrame:
    """Of storm minutes with a swath of their minute, those that it meets.

    What is unknown is NaN here, and no radius is below all: columns without null
    keep the test in a method that is small enough to be compiled."""
    known = lambda c: F.coalesce(c, F.lit(float("nan")))
    lat, lon, scale = known(F.col("lat")), known(F.col("lon")), F.lit(units.M_PER_DEGREE)
    at = {"__lat": lat, "__lon": lon, "__narrow": F.cos(F.radians(lat)), "__turn": known(F.lit(360.0) * _whole((lon - F.col("a_lon")) / 360))}
    own, hits = hits.columns, hits.withColumns(at)
    y = {f"__{k}_y": (known(F.col(f"{k}_lat")) - F.col("__lat")) * scale for k in CORNERS}
    x = {f"__{k}_x": (known(F.col(f"{k}_lon")) + F.col("__turn") - F.col("__lon")) * scale * F.col("__narrow") for k in CORNERS}
    reach = {"__r": F.coalesce(F.col(radius).cast("double"), F.lit(float("-inf")))}
    hits = hits.select(*own, _apart(x | y | reach))
    xs, ys, r = [F.col(n) for n in x], [F.col(n) for n in y], F.col("__r")
    hits = hits.filter((F.least(*ys) <= r) & (F.least(*(-v for v in ys)) <= r) & (F.least(*xs) <= r) & (F.least(*(-v for v in xs)) <= r))
    edges = [*zip(CORNERS, xs, ys, xs[1:] + xs[:1], ys[1:] + ys[:1])]
    ways = {f"__{k}_u": qx - px for k, px, _, qx, _ in edges} | {f"__{k}_v": qy - py for k, _, py, _, qy in edges}
    hits = hits.withColumns(ways)
    u, v = (lambda k: F.col(f"__{k}_u")), (lambda k: F.col(f"__{k}_v"))
    along = lambda k, px, py: known(-(px * u(k) + py * v(k)) / F.greatest(u(k) * u(k) + v(k) * v(k), F.lit(1e-9)))
    hits = hits.withColumns({f"__{k}_t": F.least(F.lit(1.0), F.greatest(F.lit(0.0), along(k, px, py))) for k, px, py, _, _ in edges})
    hits = hits.withColumns({f"__{k}_n": px + F.col(f"__{k}_t") * u(k) for k, px, _, _, _ in edges} | {f"__{k}_m": py + F.col(f"__{k}_t") * v(k) for k, _, py, _, _ in edges})
    gaps = {f"__{k}_gap": F.col(f"__{k}_n") * F.col(f"__{k}_n") + F.col(f"__{k}_m") * F.col(f"__{k}_m") for k in CORNERS}
    sides = {f"__{k}_side": px * qy - qx * py for k, px, py, qx, qy in edges}
    hits = hits.select(*own, "__r", _apart(gaps | sides))
    left, right = (reduce(and_, [c <= 0.0 for c in of]) for of in ([-F.col(n) for n in sides], [F.col(n) for n in sides]))
    return hits.filter(left | right | (F.least(*(F.col(n) for n in gaps)) <= F.col("__r") * F.col("__r"))).select(*own)


def _apart(columns: dict[str, Column]) -> Column:
    """Columns as a generated row: a filter on them is not moved below it, where
    it would work out each of them again wherever it names it."""
    return F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))


def corner_distance() -> Column:
    return F.least(*[geo.distance_m(F.col("lat"), F.col("lon"), F.col(f"{k}_lat"), F.col(f"{k}_lon")) for k in CORNERS])


def dedupe_sensing(matches: DataFrame, compat: bool = False) -> DataFrame:
    """Of minutes that follow one another keep the one whose swath corner is
    closest. Groups hold the minutes of one storm in one pass. ``compat`` also
    drops a lone minute that is not the last of its pass."""
    key = [*TRACK, "satellite", "pass_number"]
    w = Window.partitionBy(*key).orderBy("interp_id", "side")
    m = matches.withColumn("corner_m", corner_distance())
    gap = F.col("interp_id") - F.lag("interp_id").over(w)
    m = islands(m.withColumn("gap", gap), key, ["interp_id", "side"], F.coalesce(F.col("gap") != 60, F.lit(True)))
    i = Window.partitionBy(*key, "island")
    m = m.withColumn("r", F.row_number().over(i.orderBy("corner_m", "interp_id", "side"))).withColumn("n", F.count(F.lit(1)).over(i))
    if compat:
        m = m.withColumn("last_island", F.max("island").over(Window.partitionBy(*key)))
        m = m.filter((F.col("n") > 1) | (F.col("island") == F.col("last_island"))).drop("last_island")
    return m.filter("r = 1").drop("r", "gap", "island").withColumnRenamed("n", "n_minutes")


def predict(points: DataFrame, nadir: DataFrame, swaths: dict = SWATHS, compat: bool = False) -> DataFrame:
    """Which pass sees which storm, and when."""
    quads = cut(swath_quads(nadir, swaths, during=span_of(points)))
    return dedupe_sensing(sensed_tracks(points, quads), compat)


def sensed_tracks(points: DataFrame, quads: DataFrame, epoch: str = "2024-01-01") -> DataFrame:
    """Storm minutes that a swath meets. Slots with a swath near open to its
    areas, and the areas name the minutes, so minutes are never rows of a shuffle."""
    span = quads.agg(F.min("valid_time").alias("t0"), F.max("valid_time").alias("t1"))
    pairs = close_pieces(_pieces(points, span.select("t0").scalar(), span.select("t1").scalar()), quads, epoch)
    area = [c for c in quads.columns if c not in ("interp_id", "valid_time")]
    return _meeting(_at_minute(_headed(pairs), *area))


def time_overlap(storms: DataFrame, passes: DataFrame, hours: int = 6) -> DataFrame:
    """Storms and passes whose time ranges overlap (columns t0, t1 each).

    Both sides fall into slots; of the slots two ranges share, the pair is
    taken in the first, so no pair comes twice."""
    size = hours * 3600
    slot = lambda c: F.floor(F.unix_timestamp(c) / size)
    slots = lambda df, name: df.withColumn(name, slot("t0")).withColumn("slot", F.explode(F.sequence(slot("t0"), slot("t1"))))
    s = slots(storms, "s_first").withColumnsRenamed({"t0": "s0", "t1": "s1"})
    p = slots(passes, "p_first").withColumnsRenamed({"t0": "p0", "t1": "p1"})
    hits = s.join(p, "slot").filter(F.col("slot") == F.greatest("s_first", "p_first"))
    return hits.filter((F.col("s0") <= F.col("p1")) & (F.col("s1") >= F.col("p0"))).drop("slot", "s_first", "p_first")


# ---------------------------------------------------------------- lines


def cut_lines(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Track points cut into lines at the antimeridian; each crossing adds a
    point on either side, its latitude in proportion to the distances."""
    w = Window.partitionBy(*keys).orderBy(order)
    p = points.withColumns({"plon": F.lag("lon").over(w), "plat": F.lag("lat").over(w)})
    east = (F.col("plon") > 0) & (F.col("lon") < 0)
    west = (F.col("plon") < 0) & (F.col("lon") > 0)
    crossing = F.coalesce((F.abs(F.col("lon") - F.col("plon")) > 180) & (east | west), F.lit(False))
    p = islands(p.withColumn("crossing", crossing), keys, [order], F.col("crossing"), "line_no")
    left, right = F.lit(180.0) - F.abs("plon"), F.lit(180.0) - F.abs("lon")
    at = F.when(left + right != 0, F.col("plat") + (F.col("lat") - F.col("plat")) * left / (left + right)).otherwise(F.lit(0.0))
    edge = F.when(east, F.lit(180.0)).otherwise(F.lit(-180.0))
    point = lambda n, seq, lon, lat: F.struct(n.alias("line_no"), F.lit(seq).alias("seq"), lon.alias("lon"), lat.alias("lat"))
    n = F.col("line_no")
    here = point(n, 2, F.col("lon"), F.col("lat"))
    rows = F.when(F.col("crossing"), F.array(point(n - 1, 0, edge, at), point(n, 1, -edge, at), here)).otherwise(F.array(here))
    return p.select(*keys, order, F.explode(rows).alias("q")).select(*keys, order, "q.*")


def unwrapped_previous(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Previous longitude shifted by a turn where it jumps more than 270."""
    prev = F.lag("lon").over(Window.partitionBy(*keys).orderBy(order))
    p = points.withColumn("prev_lon", prev)
    far = F.abs(F.col("prev_lon") - F.col("lon")) > 270
    shift = F.when(F.col("prev_lon") < F.col("lon"), 360.0).otherwise(-360.0)
    return p.withColumn("prev_lon", F.when(far, F.col("prev_lon") + shift).otherwise(F.col("prev_lon")))
