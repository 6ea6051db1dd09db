"""Microwave samples: scaling, quality, corrected temperature, geolocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galespark.functions import units
from galespark.session import broadcast_if_small, cut

# fixed values: polarisation coefficients by frequency
THETA = {89: 0.818, 36: 1.18}
# fixed values: display range of the three channels by frequency (corrected, vertical, horizontal)
RANGES = {89: ((220, 310), (270, 290), (240, 300)), 36: ((260, 280), (160, 300), (180, 310))}
# fixed values: quality bit of each 89-GHz channel
PIXEL_BITS = {"tb_89ah": 1, "tb_89av": 2, "tb_89bh": 4, "tb_89bv": 8}
# fixed value: seconds between atomic and civil time
LEAP_SECONDS = 37
# fixed value: 1993-01-01 in seconds since 1970
EPOCH_1993 = 725846400
ABNORMAL = -9991.0


def scale(samples: DataFrame, attributes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Integer samples times the scale factor of their file, NULL where it has none."""
    out = samples.join(broadcast_if_small(attributes, 10_000), key, "left")
    return out.withColumns({c: F.col(c) * F.col("scale_factor") for c in columns})


def pixel_quality(samples: DataFrame, bits: dict[str, int] = PIXEL_BITS, flags: str = "pdq") -> DataFrame:
    """NULL each channel whose quality bit is set."""
    return samples.withColumns({c: F.when(~units.any_bit(F.col(flags), b), F.col(c)) for c, b in bits.items()})


def box(samples: DataFrame, lat: Column, lon: Column, radius: float = 5.0) -> DataFrame:
    """Samples within the box round a centre with both temperatures present."""
    near = F.col("lat").between(lat - radius, lat + radius) & F.col("lon").between(lon - radius, lon + radius)
    return samples.filter(near & F.col("tb_v").isNotNull() & F.col("tb_h").isNotNull())


def corrected(tb_v: Column, tb_h: Column, theta: Column) -> Column:
    return (F.lit(1.0) + theta) * tb_v - theta * tb_h


def colour(pct: Column, tb_v: Column, tb_h: Column, frequency: int = 89) -> dict[str, Column]:
    """Red, green, blue in 0..1; red runs backwards."""
    p, v, h = RANGES[frequency]
    return {
        "red": F.lit(1.0) - units.normalise(pct, *p),
        "green": units.normalise(tb_v, *v),
        "blue": units.normalise(tb_h, *h),
    }


def tai93_to_utc(seconds: Column) -> Column:
    return F.timestamp_micros(((seconds - LEAP_SECONDS + EPOCH_1993) * 1000000).cast("long"))


def theta_lookup(rows: DataFrame, theta: DataFrame, lat: str = "lat", month: str = "month") -> DataFrame:
    """Coefficient at the table latitude nearest to the row.

    The table folds to one list per month, so rows meet at most twelve keys
    by an equi-join and the argmin runs inside the row; NULL without a month."""
    per_month = theta.groupBy("month").agg(F.sort_array(F.collect_list(F.struct("lat", "theta")), asc=False).alias("steps"))
    per_month = per_month.withColumnRenamed("month", month)
    gaps = F.transform(
        "steps", lambda s, i: F.struct(F.abs(s["lat"] - F.col(lat)).alias("gap"), i.alias("i"), s["theta"].alias("theta"))
    )
    per_month = F.broadcast(cut(per_month))  # twelve rows at most
    return rows.join(per_month, month, "left").withColumn("theta", F.array_min(gaps)["theta"]).drop("steps")


def nearest_sample(samples: DataFrame, keys: list[str], lat: Column, lon: Column, payload: list[str]) -> DataFrame:
    """Per group the sample nearest to a centre in plain degrees; the first of
    equals in payload order."""
    d2 = F.pow(F.col("lat") - lat, 2) + F.pow(F.col("lon") - lon, 2)
    best = F.min(F.struct(d2.alias("d2"), *payload)).alias("best")
    return samples.groupBy(*keys).agg(best).select(*keys, *[f"best.{c}" for c in payload])


def coregister(samples: DataFrame, a1: float, a2: float, keys: list[str] = ["scan"], pixel: str = "pixel") -> DataFrame:
    """Low-frequency positions from pairs of neighbouring high-frequency
    pixels: the pair spans a plane, and the first position is turned in that
    plane and out of it by fixed fractions of the angle between the two."""

    def valid(p):
        ok = (F.col(f"{p}.lat") > ABNORMAL) & (F.abs(F.col(f"{p}.lat")) <= 90) & (F.abs(F.col(f"{p}.lon")) <= 180)
        return F.coalesce(ok, F.lit(False))

    side = lambda r: F.max(F.when(F.col(pixel) % 2 == r, F.struct("lat", "lon")))
    pairs = samples.groupBy(*keys, (F.floor(F.col(pixel) / 2)).alias("pair")).agg(side(0).alias("p"), side(1).alias("q"))
    pairs = pairs.filter(F.col("p").isNotNull() & F.col("q").isNotNull())

    def unit(s):
        lat, lon = F.radians(F.col(f"{s}.lat")), F.radians(F.col(f"{s}.lon"))
        return {f"{s}x": F.cos(lat) * F.cos(lon), f"{s}y": F.cos(lat) * F.sin(lon), f"{s}z": F.sin(lat)}

    c = F.col
    v = pairs.withColumns(unit("p") | unit("q")).withColumns(
        {
            "nx": c("py") * c("qz") - c("pz") * c("qy"),
            "ny": c("pz") * c("qx") - c("px") * c("qz"),
            "nz": c("px") * c("qy") - c("py") * c("qx"),
        }
    )
    v = v.withColumn("norm", F.sqrt(c("nx") * c("nx") + c("ny") * c("ny") + c("nz") * c("nz")))
    v = v.withColumns({f"n{k}": c(f"n{k}") / F.nullif(c("norm"), F.lit(0.0)) for k in "xyz"})
    v = v.withColumns(
        {
            "sx": c("ny") * c("pz") - c("nz") * c("py"),
            "sy": c("nz") * c("px") - c("nx") * c("pz"),
            "sz": c("nx") * c("py") - c("ny") * c("px"),
            "angle": F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c("px") * c("qx") + c("py") * c("qy") + c("pz") * c("qz")))),
        }
    )
    t1, t2 = c("angle") * a1, c("angle") * a2
    out = {}
    for k in "xyz":
        turned = F.cos(t2) * (F.cos(t1) * c(f"p{k}") + F.sin(t1) * c(f"s{k}")) + F.sin(t2) * c(f"n{k}")
        out[f"r{k}"] = F.when(c("norm") < 1e-6, c(f"p{k}")).otherwise(turned)
    v = v.withColumns(out)
    good = valid("p") & valid("q")
    lat = F.degrees(F.atan2(c("rz"), F.sqrt(c("rx") * c("rx") + c("ry") * c("ry"))))
    lon = F.degrees(F.atan2(c("ry"), c("rx")))
    return v.select(*keys, "pair", F.when(good, lat).alias("lat"), F.when(good, lon).alias("lon"))


def mesh_of(samples: DataFrame, keys: list[str], rows: int, cols: int) -> DataFrame:
    """Regular mesh over the extent of each group."""
    ext = samples.groupBy(*keys).agg(
        F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.min("lon").alias("lon0"), F.max("lon").alias("lon1")
    )
    at = lambda a, b, i, n: F.col(a) + i * ((F.col(b) - F.col(a)) / F.lit(n - 1))
    return (
        ext.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
        .select(*keys, "i", "j", at("lat0", "lat1", F.col("i"), rows).alias("mlat"), at("lon0", "lon1", F.col("j"), cols).alias("mlon"))
    )


def regrid_nearest(samples: DataFrame, mesh: DataFrame, keys: list[str], payload: list[str], tile: float = 0.5) -> DataFrame:
    """Nearest sample of every mesh point, exact at any sample density.

    Points look in the 3x3 tiles round their own. What is found within one
    tile length cannot be beaten from outside and is final; the rest goes on
    with tiles twice as wide, so rounds grow with the logarithm of the widest
    gap. Samples at one position collapse before they meet the mesh. Points
    without a position or in a group without usable samples get NULL."""
    usable = lambda a, b: F.abs(a).between(0, 1e6) & F.abs(b).between(0, 1e6)  # NULL and NaN are neither
    sites = samples.filter(usable(F.col("lat"), F.col("lon"))).groupBy(*keys, "lat", "lon").agg(F.min(F.struct(*payload)).alias("payload"))
    sites = cut(sites)  # read by every round
    # mesh points shrink so well in a shuffle that a broadcast of them looks cheaper than it is: no join may turn to one
    with_sites = mesh.filter(usable(F.col("mlat"), F.col("mlon"))).join(sites.select(*keys).distinct().hint("merge"), keys, "left_semi")
    open_points = cut(with_sites.select(*keys, "i", "j", "mlat", "mlon"))
    kinds = {f.name: f.dataType for f in samples.schema}
    bare = mesh.select(*keys, "i", "j").join(open_points.select(*keys, "i", "j").hint("merge"), [*keys, "i", "j"], "left_anti")
    done = cut(bare.select(*keys, "i", "j", *(F.lit(None).cast(kinds[c]).alias(c) for c in payload)))
    while not open_points.isEmpty():
        def index(c):
            return F.floor(F.col(c) / tile)

        offsets = F.sequence(F.lit(-1), F.lit(1))
        probes = (
            open_points.withColumn("du", F.explode(offsets)).withColumn("dv", F.explode(offsets))
            .withColumn("tu", index("mlat") + F.col("du")).withColumn("tv", index("mlon") + F.col("dv"))
        )
        tiled = sites.withColumn("tu", index("lat")).withColumn("tv", index("lon"))
        d2 = (F.col("lat") - F.col("mlat")) * (F.col("lat") - F.col("mlat")) + (F.col("lon") - F.col("mlon")) * (
            F.col("lon") - F.col("mlon")
        )
        hits = probes.join(tiled.hint("merge"), [*keys, "tu", "tv"])
        best = hits.groupBy(*keys, "i", "j").agg(F.min(F.struct(d2.alias("d2"), "payload")).alias("best"))
        final = best.filter(F.col("best.d2") <= tile * tile)
        found = cut(final.select(*keys, "i", "j", "best.payload.*"))
        done = done.unionByName(found)
        open_points = cut(open_points.join(found.select(*keys, "i", "j").hint("merge"), [*keys, "i", "j"], "left_anti"))
        tile *= 2
    return done


def product(samples: DataFrame, lat: Column, lon: Column, frequency: int, bits: dict[str, int], theta: Column | None = None) -> DataFrame:
    """Scene round a centre: quality, box, corrected temperature, colours."""
    s = box(pixel_quality(samples, bits), lat, lon)
    weight = F.lit(THETA[frequency]) if theta is None else theta
    s = s.withColumn("pct", corrected(F.col("tb_v"), F.col("tb_h"), weight))
    return s.withColumns(colour(F.col("pct"), F.col("tb_v"), F.col("tb_h"), frequency))
