"""Forecast verification against advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galespark.functions import geo
from galespark.operators.ranking import quantiles
from galespark.session import cut

RUN = ["storm_id", "model_id", "init_time"]
VALUES = ["lat", "lon", "vmax", "mslp", "dir", "speed"]
METRICS = ["position", "wind", "pressure", "heading", "speed"]
# fixed values: models without motion in their decks
EXCLUDED = {"heading": ["HWRF"], "speed": ["HWRF"]}


def dedupe(deck: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First line per key; exact repeats fold before the shuffle."""
    rest = [c for c in deck.columns if c not in {*keys, *order}]
    return deck.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("r")).select(*keys, "r.*")


def ace_by_run(deck: DataFrame, order: list[str]) -> DataFrame:
    """Accumulated energy of each run from six-hourly winds of 34 kt or more."""
    one = dedupe(deck.select(*RUN, "tau", "vmax", *order), [*RUN, "tau"], order)
    counted = (F.col("tau") % 6 == 0) & (F.col("vmax") >= 34)
    energy = F.sum(F.when(counted, F.pow(F.col("vmax").cast("double"), 2)).otherwise(0.0))
    return one.groupBy(*RUN).agg((energy * 1e-4).alias("ace"))


def verifiable(deck: DataFrame, advisories: DataFrame) -> DataFrame:
    """Storms that have both forecasts and advisories."""
    return deck.select("storm_id").distinct().join(advisories.select("storm_id").distinct(), "storm_id", "left_semi")


def advisory_weights(advisories: DataFrame) -> DataFrame:
    """Each advisory stands for half the time between its neighbours; weights
    add up to one per storm. A storm has a few hundred advisories at most."""
    w = Window.partitionBy("storm_id").orderBy("advisory_time")
    span = F.unix_timestamp(F.lead("advisory_time").over(w)) - F.unix_timestamp(F.lag("advisory_time").over(w))
    out = advisories.withColumn("duration", span / 2)
    return out.withColumn("weight", F.col("duration") / F.sum("duration").over(Window.partitionBy("storm_id")))


def bracket(deck: DataFrame, advisories: DataFrame, compat: bool = False) -> DataFrame:
    """Every run of a storm at every advisory, with the points round it.

    The points of a run, one per valid time, fold to one sorted array, which
    opens to the stretches between neighbouring points, the first and the last
    without end. An advisory meets the one stretch of each run that its time
    lies in, by plain comparisons, and what depends on the two points only
    (their distance and direction, ``leg``) is worked out once per stretch.
    ``compat`` takes the first earlier point instead of the nearest."""
    runs = deck.groupBy(*RUN).agg(
        F.sort_array(F.collect_list(F.struct("valid_time", *VALUES))).alias("points")
    )
    # times are sorted with nulls first, which lie before no advisory
    times = F.filter("points", lambda p: p["valid_time"].isNotNull())
    last = F.size("points") - 1
    stretch = lambda k: F.struct(
        F.get("times", k - 1)["valid_time"].alias("since"), F.get("times", k)["valid_time"].alias("until"),
        F.get("points", F.lit(0) if compat else F.greatest(k - 1, F.lit(0))).alias("prior"),
        F.get("points", F.least(k, last)).alias("future"), k.between(1, last).alias("inside"),
    )
    runs = runs.withColumn("times", times)
    parts = runs.select(*RUN, F.explode(F.transform(F.sequence(F.lit(0), F.size("times")), stretch)).alias("s")).select(*RUN, "s.*")
    a, z = ([F.col(f"{p}.{c}") for c in ("lat", "lon")] for p in ("prior", "future"))
    parts = parts.withColumn("leg", F.struct(geo.distance_m(*a, *z).alias("metres"), geo.azimuth_deg(*a, *z).alias("azimuth")))
    t = F.col("advisory_time")
    here = (F.col("since").isNull() | (t >= F.col("since"))) & (F.col("until").isNull() | t.isNull() | (t < F.col("until")))
    pairs = parts.withColumnRenamed("storm_id", "of_storm").join(advisories, (F.col("of_storm") == F.col("storm_id")) & here)
    return pairs.select(*advisories.columns, *RUN[1:], "prior", "future", "inside", "leg")


def interpolate(brackets: DataFrame, compat: bool = False) -> DataFrame:
    """Forecast at the advisory time; held constant outside the run."""
    t = F.unix_timestamp("advisory_time")
    t0, t1 = F.unix_timestamp("prior.valid_time"), F.unix_timestamp("future.valid_time")
    b = brackets.withColumn("late", F.when(F.col("inside"), (t - t0) / (t1 - t0)).otherwise(F.lit(0.0)))
    p, f = "prior", "future"
    # after the last point both neighbours are that point, before the first too
    blend = lambda c: F.when(
        F.col("inside"), (F.lit(1.0) - F.col("late")) * F.col(f"{p}.{c}") + F.col("late") * F.col(f"{f}.{c}")
    ).otherwise(F.col(f"{p}.{c}").cast("double"))
    a = [F.col(f"{p}.lat"), F.col(f"{p}.lon")]
    ratio = F.lit(1.0) - F.col("late") if compat else F.col("late")
    az, step = F.col("leg.azimuth"), F.col("leg.metres") * ratio
    moved = F.col("inside") & (F.col("leg.metres") > 0)
    return b.withColumns(
        {f"f_{c}": blend(c) for c in VALUES}
        | {
            "pos_lat": F.when(moved, geo.dest_lat(a[0], az, step)).otherwise(a[0]),
            "pos_lon": F.when(moved, geo.dest_lon(a[0], a[1], az, step)).otherwise(a[1]),
        }
    ).drop("prior", "future", "leg")


def _differences() -> dict[str, Column]:
    """Signed difference of forecast and advisory by metric, the distance in metres for the position."""
    return {
        "position": geo.distance_m(F.col("pos_lat"), F.col("pos_lon"), F.col("lat"), F.col("lon")),
        "wind": F.col("f_vmax") - F.col("vmax_kt"),
        "pressure": F.col("f_mslp") - F.col("mslp_hpa"),
        "heading": F.col("f_dir") - F.col("heading"),
        "speed": F.col("f_speed") - F.col("speed_kt"),
    }


def errors(forecasts: DataFrame) -> DataFrame:
    """One row per metric and pair of forecast and advisory."""
    diffs = _differences()
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), d.alias("diff")) for m, d in diffs.items()])
    base = [*RUN, "advisory_time", "duration", "weight"]
    return forecasts.select(*base, F.explode(rows).alias("r")).select(*base, "r.*")


def statistics(errs: DataFrame) -> DataFrame:
    """Plain and weighted error statistics of each run and metric."""
    d, w = F.col("diff"), F.col("weight")
    return errs.groupBy(*RUN, "metric").agg(
        F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"), F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"),
        F.count(F.lit(1)).alias("cases"), F.sum("duration").alias("duration"),
        F.sum(F.abs(d * w)).alias("w_mae"), F.sum(d * w).alias("w_bias"), F.sum(d * d * w).alias("w_mse"),
        F.sqrt(F.sum(d * d * w)).alias("w_rmse"),
    )


def run_statistics(forecasts: DataFrame) -> DataFrame:
    """The same as ``statistics(errors(forecasts))``, with all metrics of a run
    in one aggregation; only the few result rows are laid out by metric."""
    w, weighted = F.col("weight"), _differences()
    rows = []
    for metric in weighted:
        d = F.col(f"d_{metric}")
        mse, w_mse = F.avg(d * d), F.sum(d * d * w)
        rows.append(F.struct(
            F.lit(metric).alias("metric"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"), mse.alias("mse"), F.sqrt(mse).alias("rmse"),
            F.count(F.lit(1)).alias("cases"), F.sum("duration").alias("duration"), F.sum(F.abs(d * w)).alias("w_mae"),
            F.sum(d * w).alias("w_bias"), w_mse.alias("w_mse"), F.sqrt(w_mse).alias("w_rmse"),
        ))
    wide = forecasts.select(*RUN, "duration", "weight", *(d.alias(f"d_{m}") for m, d in weighted.items()))
    return wide.groupBy(*RUN).agg(F.array(*rows).alias("rows")).select(*RUN, F.explode("rows").alias("r")).select(*RUN, "r.*")


def verify(deck: DataFrame, advisories: DataFrame, compat: bool = False) -> DataFrame:
    """Statistics of every run; ``deck`` holds one point per valid time."""
    weighted = advisory_weights(advisories)
    return run_statistics(interpolate(bracket(deck, weighted, compat), compat))


def _by_weighting(stats: DataFrame) -> DataFrame:
    rows = F.array(
        F.struct(F.lit("unweighted").alias("weighting"), F.col("rmse").alias("rmse")),
        F.struct(F.lit("weighted").alias("weighting"), F.col("w_rmse").alias("rmse")),
    )
    return stats.select(*RUN, "metric", F.explode(rows).alias("r")).select(*RUN, "metric", "r.*")


def model_statistics(stats: DataFrame) -> DataFrame:
    """Spread of the runs' errors per model, and over models (model NULL)."""
    # a few rows per run, read by two aggregations: written once
    long = cut(_by_weighting(stats))
    keys = ["metric", "weighting", "model_id"]
    plain = long.groupBy(*keys).agg(F.min("rmse").alias("low"), F.avg("rmse").alias("mean"), F.max("rmse").alias("high"))
    per_model = plain.join(quantiles(long, keys, "rmse", {"median": 0.5}), keys)
    over = per_model.groupBy("metric", "weighting").agg(
        F.min("low").alias("low"), F.avg("mean").alias("mean"), F.max("high").alias("high"),
        # one value per model: a list of model names bounds it
        F.median("median").alias("median"), F.lit(None).cast("string").alias("model_id"),
    )
    return per_model.unionByName(over)


def best_runs(stats: DataFrame, excluded: dict[str, list[str]] = EXCLUDED) -> DataFrame:
    """Run of smallest error per model, and over all models (model NULL)."""
    long = _by_weighting(stats)
    for metric, models in excluded.items():
        long = long.filter(~((F.col("metric") == metric) & F.col("model_id").isin(models)))
    pick = F.min(F.struct("rmse", "model_id", "init_time", "storm_id")).alias("b")
    per_model = cut(long.groupBy("metric", "weighting", F.col("model_id").alias("m")).agg(pick))
    overall = per_model.groupBy("metric", "weighting").agg(F.min("b").alias("b")).withColumn("m", F.lit(None).cast("string"))
    return per_model.unionByName(overall).select(
        "metric", "weighting", F.col("m").alias("of_model"), "b.model_id", "b.init_time", "b.storm_id", "b.rmse"
    )
