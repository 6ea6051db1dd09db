"""Run catalogue: stored disturbances and tracks, as-of and cycle queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galespark.functions.units import ms_to_kt

RUN = ["model_name", "init_date"]
POINT_JSON = "lat double, lon double, mslp_value double, vmax10m_in_roci double"


# ---------------------------------------------------------------- stored disturbances


def disturbance_store(points: DataFrame) -> DataFrame:
    """One JSON document per candidate. Rows instead of one document per run:
    a run of any size is written and read by many tasks."""
    doc = F.to_json(F.struct("lat", "lon", F.col("mslp").alias("mslp_value"), F.col("vmax").alias("vmax10m_in_roci")))
    return points.select("model_name", F.col("init_time").alias("init_date"), "time_step", doc.alias("data"))


def disturbances_of_run(store: DataFrame, model: str, init: str) -> DataFrame:
    """Candidates of one run; both filters reach the partition columns of the store."""
    rows = store.filter((F.col("model_name") == model) & (F.col("init_date") == F.lit(init).cast("timestamp")))
    return rows.select(*RUN, "time_step", F.from_json("data", POINT_JSON).alias("p")).select(*RUN, "time_step", "p.*")


def step_completeness(points: DataFrame, expected: int | Column, step: str = "time_step", init: str = "init_time") -> DataFrame:
    """Steps present per run against the number expected."""
    runs = points.groupBy("model_name", F.col(init).alias("init_date")).agg(F.count_distinct(step).alias("n_steps"))
    goal = expected if isinstance(expected, Column) else F.lit(expected)
    return runs.withColumn("is_complete", F.col("n_steps") == goal)


def complete_disturbances(store: DataFrame, completeness: DataFrame) -> DataFrame:
    return store.join(completeness.filter("is_complete").select(*RUN), RUN, "left_semi").orderBy("init_date", "model_name")


# ---------------------------------------------------------------- upserts


def replace_steps(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the keys that arrive replace the stored rows of those keys."""
    return existing.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored."""
    return incoming.join(existing.select(*keys).distinct(), keys, "left_anti")


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str] = []) -> DataFrame:
    """One incoming row for each key that is not stored, the first in ``order``
    (then by the other columns); stored rows never change."""
    rest = [*order, *(c for c in incoming.columns if c not in {*keys, *order})]
    if not rest:
        return absent(existing, incoming, keys).select(*keys).distinct()
    first = incoming.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r"))
    return absent(existing, first, keys).select(*(c if c in keys else f"r.{c}" for c in incoming.columns))


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the highest version per key. ``max_by`` folds on the map
    side, so a key with many versions sends one row per task."""
    both = existing.unionByName(incoming)
    rest = [c for c in both.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r"))
    return last.select(*keys, "r.*")


def ensemble_status(processed: DataFrame, expected: DataFrame) -> DataFrame:
    """Files processed against expected; a partial cycle expects -1."""
    n = processed.groupBy("ensemble_name", "init_date").agg(F.count_distinct("path").alias("num_files_processed"))
    out = n.join(expected, ["ensemble_name", "init_date"], "left")
    goal = F.coalesce("expected", F.lit(-1))
    return out.select(
        "ensemble_name", "init_date", "num_files_processed", goal.alias("expected_num_files_processed"),
        (F.col("num_files_processed") == goal).alias("completed"),
    )


def run_documents(points: DataFrame, fields: list[str]) -> DataFrame:
    """One JSON document per run and forecast hour, its candidates in order. A
    document holds the candidates of one hour, a bounded list."""
    listed = F.sort_array(F.collect_list(F.struct(*fields)))
    return points.groupBy("model_name", "init_date", "time_step").agg(F.to_json(listed).alias("data"))


def from_documents(documents: DataFrame, schema: str) -> DataFrame:
    """Rows of the documents' candidates."""
    parts = F.explode(F.from_json("data", f"array<struct<{schema}>>")).alias("p")
    return documents.select("model_name", "init_date", "time_step", parts).select("p.*", "model_name", "init_date", "time_step")


def step_documents(points: DataFrame, fields: list[str]) -> DataFrame:
    """One document per run: its candidates by step, and the components it is
    made of. A run holds one simplified point per component and step."""
    listed = points.groupBy(*RUN, F.col("time_step").cast("string").alias("step")).agg(
        F.sort_array(F.collect_list(F.struct("component_id", *fields))).alias("candidates"), F.collect_set("component_id").alias("some")
    )
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("step", "candidates"))))
    done = F.array_sort(F.array_distinct(F.flatten(F.collect_list("some"))))
    return listed.groupBy(*RUN).agg(entries.alias("data"), done.alias("done_components"))


def merge_step_documents(stored: DataFrame, points: DataFrame, fields: list[str]) -> DataFrame:
    """Documents that ``points`` change, whole. Components that a stored
    document names as done are skipped; others join its steps and its list.

    Only runs among ``points`` are touched, so a caller rewrites their
    partitions and no others."""
    known = stored.select(*RUN, F.col("done_components").alias("__done"))
    new = points.join(known, RUN, "left").filter(~F.coalesce(F.array_contains("__done", F.col("component_id")), F.lit(False))).drop("__done")
    fresh = step_documents(new, fields).withColumnsRenamed({"data": "__data", "done_components": "__new"})
    both = lambda a, b: F.array_sort(F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array())))
    data = F.when(F.col("data").isNull(), F.col("__data")).otherwise(F.map_zip_with("data", "__data", lambda _, a, b: both(a, b)))
    done = F.array_sort(F.array_union(F.coalesce("done_components", F.array().cast(stored.schema["done_components"].dataType)), "__new"))
    return fresh.join(stored, RUN, "left").select(*RUN, data.alias("data"), done.alias("done_components"))


def opened(documents: DataFrame) -> DataFrame:
    """A row per candidate, with the components its document has done."""
    steps = documents.select(*RUN, "done_components", F.explode("data").alias("step", "candidates"))
    rows = steps.select(*RUN, "done_components", F.col("step").cast("int").alias("time_step"), F.explode("candidates").alias("c"))
    return rows.select(*RUN, "time_step", "c.*", "done_components")


# ---------------------------------------------------------------- as-of and cycles


def latest_completed(completed: DataFrame, as_of: Column | None = None, extra: list[str] = []) -> DataFrame:
    """Newest completed run per model, at or before a moment."""
    seen = completed if as_of is None else completed.filter(F.col("init_date") <= as_of)
    newest = F.max(F.struct("init_date", "completed_date")).alias("r")
    return seen.groupBy("model_name", *extra).agg(newest).select("model_name", *extra, "r.*")


def tracks_as_of(tracks: DataFrame, completed: DataFrame, as_of: Column) -> DataFrame:
    latest = latest_completed(completed, as_of)
    return tracks.join(latest, RUN).orderBy(F.desc("start_valid_date"), "model_name", "component_id")


def cycle_neighbours(completed: DataFrame, moment: Column) -> DataFrame:
    """Cycle at or before a moment and its neighbours, in two aggregations."""
    at = completed.agg(F.max(F.when(F.col("init_date") <= moment, F.col("init_date")))).scalar()
    return completed.agg(
        F.max(F.when(F.col("init_date") < at, F.col("init_date"))).alias("previous"),
        F.max(F.when(F.col("init_date") <= moment, F.col("init_date"))).alias("at"),
        F.min(F.when(F.col("init_date") > at, F.col("init_date"))).alias("next"),
    )


def latest_cycle(completed: DataFrame, moment: Column) -> DataFrame:
    return cycle_neighbours(completed, moment).select(F.coalesce("next", "at").alias("cycle"))


def latest_runs(completed: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` distinct runs per model."""
    runs = completed.select("model_name", "init_date").distinct()
    rank = F.row_number().over(Window.partitionBy("model_name").orderBy(F.desc("init_date")))
    return runs.withColumn("recency", rank).filter(F.col("recency") <= n)


def unprocessed(all_runs: DataFrame, completed: DataFrame) -> DataFrame:
    return all_runs.join(completed.select(*RUN), RUN, "left_anti")


def ensemble_state(completed: DataFrame, status: DataFrame, members: DataFrame, as_of: Column) -> DataFrame:
    """Per ensemble: cycles its members stand at, whether one complete cycle
    speaks for it, and the cycle its tracks must come from.

    A complete cycle newer than every member's run counts too: it is a cycle
    in which no member predicted anything."""
    m = latest_completed(completed, as_of).join(members, "model_name")
    cycles = m.groupBy("ensemble_name", "init_date").agg(F.max("completed_date").alias("completed_date"))
    done = status.filter(F.col("completed") & (F.col("init_date") <= as_of)).select("ensemble_name", "init_date")
    newest = cycles.groupBy("ensemble_name").agg(F.max("init_date").alias("newest_member"))
    silent = (
        done.groupBy("ensemble_name").agg(F.max("init_date").alias("init_date"))
        .join(newest, "ensemble_name").filter(F.col("init_date") > F.col("newest_member"))
        .select("ensemble_name", "init_date", F.lit(None).cast("timestamp").alias("completed_date"))
    )
    known = cycles.unionByName(silent).join(
        done.withColumn("is_done", F.lit(True)), ["ensemble_name", "init_date"], "left"
    )
    done_at = F.when(F.col("is_done"), F.col("init_date"))
    s = known.groupBy("ensemble_name").agg(
        F.count(F.lit(1)).alias("n_cycles"), F.count(done_at).alias("n_done"),
        F.min(done_at).alias("first_done"), F.max(done_at).alias("last_done"), F.max("completed_date").alias("completed_date"),
    )
    single = (F.col("n_cycles") == 1) & (F.col("n_done") == 1)
    several = (F.col("n_cycles") > 1) & (F.col("n_done") > 1)
    return s.select(
        "ensemble_name", "n_cycles", "n_done", (single | several).alias("complete"),
        F.when(several, F.col("last_done")).otherwise(F.col("first_done")).alias("earliest_cycle"),
        F.col("last_done").alias("latest_cycle"),
        F.when(single | several, F.col("completed_date")).alias("completed_date"),
    )


def current_tracks(tracks: DataFrame, completed: DataFrame, status: DataFrame, members: DataFrame, as_of: Column) -> DataFrame:
    """As-of tracks without members left over from older cycles of an ensemble
    that is complete."""
    state = ensemble_state(completed, status, members, as_of).select("ensemble_name", "complete", "latest_cycle")
    runs = latest_completed(completed, as_of).join(members, "model_name", "left").join(state, "ensemble_name", "left")
    stale = F.coalesce(F.col("complete") & (F.col("init_date") != F.col("latest_cycle")), F.lit(False))
    # runs are pruned before tracks are touched
    return tracks.join(runs.filter(~stale).select(*RUN, "ensemble_name"), RUN)


def status_of_sources(completed: DataFrame, status: DataFrame, members: DataFrame, as_of: Column) -> DataFrame:
    """Newest run and completion per model for every kind of source: models of
    an ensemble and models of none."""
    m = latest_completed(completed, as_of).join(members, "model_name", "left")
    done = status.filter("completed").select("ensemble_name", "init_date", F.lit(True).alias("ensemble_done"))
    kind = F.when(F.col("ensemble_name").isNull(), "GLOBAL-DET").otherwise("ALL-TCGEN")
    return m.join(done, ["ensemble_name", "init_date"], "left").select(
        kind.alias("source"), "model_name", "ensemble_name", "init_date", "completed_date",
        F.coalesce("ensemble_done", F.lit(False)).alias("ensemble_done"),
    )


def ensemble_cycles(completed: DataFrame, members: DataFrame) -> DataFrame:
    """Cycle counts and range of each ensemble's members."""
    return completed.join(members, "model_name").groupBy("ensemble_name").agg(
        F.count_distinct("init_date").alias("n_cycles"), F.count_distinct("model_name").alias("n_members"),
        F.min("init_date").alias("first_cycle"), F.max("init_date").alias("last_cycle"),
        F.max("completed_date").alias("last_completed"),
    )


def model_recency(completed: DataFrame, state: DataFrame, members: DataFrame, as_of: Column) -> DataFrame:
    """Moment each model speaks for: its newest run, or the completion of its
    ensemble where that is later (a member without predictions stays current)."""
    m = latest_completed(completed, as_of).join(members, "model_name", "left")
    s = state.filter(F.col("complete") & (F.col("n_cycles") == 1)).select(
        "ensemble_name", F.col("completed_date").alias("ensemble_completed")
    )
    stamp = F.greatest("init_date", "ensemble_completed")
    return m.join(s, "ensemble_name", "left").select(
        "model_name", stamp.alias("recent"), F.date_format(stamp, "dd/HH'Z'").alias("label")
    )


# ---------------------------------------------------------------- calendars


def cycle_floor(moment: Column, hours: Column) -> Column:
    """Start of the cycle a moment lies in."""
    slot = (F.floor(F.hour(moment) / hours) * hours).cast("int")
    return F.timestamp_add("HOUR", slot, F.date_trunc("day", moment))


def latest_cycles(runs: DataFrame, moment: str, hours: str, n: int) -> DataFrame:
    """The current cycle and the ``n`` before it, newest first."""
    out = runs.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(n))))
    start = cycle_floor(F.col(moment), F.col(hours))
    return out.withColumn("cycle", F.timestamp_add("HOUR", -F.col("back") * F.col(hours), start))


def lookback_cycles(runs: DataFrame, moment: str, hours: str, back_hours: int = 48) -> DataFrame:
    """Every cycle from some hours back up to the next one."""
    start = cycle_floor(F.col(moment), F.col(hours))
    count = (F.lit(back_hours) / F.col(hours)).cast("int") + 1
    out = runs.withColumn("slot", F.explode(F.sequence(F.lit(0), count)))
    return out.withColumn("cycle", F.timestamp_add("HOUR", F.col("slot") * F.col(hours) - back_hours, start)).drop("slot")


def missing_steps(done: DataFrame, runs: DataFrame, last_step: int, interval: int = 6) -> DataFrame:
    """Expected steps of each run that have not been calculated."""
    expected = runs.withColumn("time_step", F.explode(F.sequence(F.lit(0), F.lit(last_step), F.lit(interval))))
    return expected.join(done.select(*RUN, "time_step").distinct(), [*RUN, "time_step"], "left_anti")


# ---------------------------------------------------------------- track reports


def tracks_by_basin(tracks: DataFrame, basin: str, limit: int = 10) -> DataFrame:
    """Newest tracks that start in a basin (a top-k report)."""
    order = [F.desc("init_date"), "model_name", "component_id"]
    return tracks.filter(F.col("start_basin") == basin).orderBy(*order).limit(limit)


def ace_by_track(points: DataFrame, keys: list[str], last_step: Column) -> DataFrame:
    """Accumulated energy, named-storm days and how each track ends."""
    kt = ms_to_kt(F.col("vmax"))
    named = kt >= 34
    out = points.groupBy(*keys).agg(
        F.sum(F.when(named, F.lit(1e-4) * kt * kt).otherwise(0.0)).alias("ace"),
        (F.count(F.when(named, 1)) * 0.25).alias("named_storm_days"),
        F.max("time_step").alias("last_step"),
        F.max_by(kt, F.struct(F.col("time_step"), kt)).alias("last_kt"),
        F.max(kt).alias("max_kt"),
    )
    end = (
        F.when(F.col("last_step") != last_step, "before end of run")
        .when(F.col("last_kt") >= 34, "at/above 34 kt at end of run")
        .otherwise("below 34 kt at end of run")
    )
    return out.withColumn("status", end)


def adeck_lines(lines: DataFrame) -> DataFrame:
    """Deck text lines with the storm they belong to and their run."""
    parts = F.split("value", ", *")
    part = lambda i: F.trim(F.get(parts, F.lit(i)))
    return lines.select(
        F.concat(part(0), part(1), F.substring(part(2), 1, 4)).alias("atcf_id"), part(2).alias("init_text"),
        F.trim("value").alias("value"),
    ).filter(F.col("atcf_id").isNotNull())
