"""File streams in place of polling loops."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galespark.operators.catalog import upsert_latest
from galespark.session import exists, remove, touch
from galespark.sinks.writers import overwrite_partitions

RUN_STATE = T.StructType().add("model_name", T.StringType()).add("init_time", T.TimestampType())


def files(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """Rows of files as they arrive; a file is read once."""
    reader = spark.readStream.format(fmt).schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path)


def late_cutoff(points: DataFrame, column: str = "init_time", days: int = 10) -> DataFrame:
    """Rows older than the newest by more than some days count as late."""
    return points.withWatermark(column, f"{days} days")


def cycle_counts(points: DataFrame, hours: int = 6, column: str = "ts") -> DataFrame:
    """Points per model in tumbling cycles."""
    w = F.window(column, f"{hours} hours").alias("w")
    return points.groupBy("model_name", w).agg(F.count(F.lit(1)).alias("n"), F.max("vmax").alias("vmax")).select(
        "model_name", F.col("w.start").alias("cycle"), "n", "vmax"
    )


def sensing_sessions(points: DataFrame, keys: list[str], column: str = "ts", gap: str = "61 seconds") -> DataFrame:
    """Stretches of sensing without a break longer than a minute, as windows
    ``w``. In append mode a stretch is given once, when the watermark has passed
    its end, and leaves the state."""
    return points.groupBy(*keys, F.session_window(column, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def storms_in_sessions(sessions: DataFrame, storms: DataFrame, keys: list[str], time: str, margin: str = "30 minutes") -> DataFrame:
    """Storm points next to a stretch of sensing, by an interval join of two
    streams. Both carry a watermark, so that each side's state goes once the
    other can no longer reach it; stretches come in when they are closed.

    A stretch counts in every hour that it reaches and a storm point in its own.
    The hour is a key of the join, so that a row meets the state of its hour,
    not all that the state holds of its keys."""
    own = [F.col(f"s.{k}") == F.col(f"p.{k}") for k in (*keys, "hour")]
    gap = F.expr(f"interval {margin}")
    near = (F.col(f"p.{time}") >= F.col("s.w.start") - gap) & (F.col(f"p.{time}") <= F.col("s.w.end") + gap)
    hour = lambda t: F.floor(F.unix_micros(t) / 3_600_000_000)
    reached = F.explode(F.sequence(hour(F.col("w.start") - gap), hour(F.col("w.end") + gap)))
    hits = sessions.withColumn("hour", reached).alias("s").join(storms.withColumn("hour", hour(F.col(time))).alias("p"), reduce(and_, own, near))
    rest = [F.col(f"p.{c}") for c in storms.columns if c not in keys]
    return hits.select(*(F.col(f"s.{k}") for k in keys), F.col("s.w.start").alias("first"), F.col("s.w.end").alias("closed"), "s.n", *rest)


def first_seen(points: DataFrame, keys: list[str], column: str, delay: str) -> DataFrame:
    """Each key once within the watermark; later copies drop out."""
    return points.withWatermark(column, delay).dropDuplicatesWithinWatermark(keys)


def run_steps(points: DataFrame, init: str = "init_time", days: int = 40) -> DataFrame:
    """Steps seen so far per run. Steps are a short fixed list, so the set
    kept in state is bounded by the forecast length; a run leaves the state
    once newer runs are ``days`` ahead."""
    return points.withWatermark(init, f"{days} days").groupBy("model_name", init).agg(
        F.size(F.collect_set("time_step")).alias("n_steps"), F.max("time_step").alias("last_step")
    )


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Process what is there and stop; the checkpoint remembers what was read."""
    q = (
        stream.writeStream.outputMode(mode).trigger(availableNow=True)
        .option("checkpointLocation", checkpoint).foreachBatch(sink).start()
    )
    q.awaitTermination()


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """One folder per batch, so a repeated batch overwrites itself."""
    return lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")


def merge_latest(path: str, keys: list[str], version: str, partition: str) -> Callable[[DataFrame, int], None]:
    """Keep the newest version per key in a partitioned table.

    Only partitions named by the batch are read and rewritten. They go
    through a side table, since a job cannot overwrite what it reads."""

    def sink(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        touched = df.select(partition).distinct()
        if exists(spark, path):
            stored = spark.read.schema(df.schema).parquet(path).join(touched, partition, "left_semi")
        else:
            stored = df.limit(0)
        side = f"{path}_side/batch={n}"
        upsert_latest(stored, df, keys, version).write.mode("overwrite").parquet(side)
        overwrite_partitions(spark.read.parquet(side), path, [partition])
        remove(spark, side)

    return sink


def hand_over(job: Callable[[DataFrame], None], log: str, wanted: str = "status = 'complete'") -> Callable[[DataFrame, int], None]:
    """Give runs to a follow-up job, each in one batch only, whatever is repeated.

    A batch first writes down which runs it hands over (those that no earlier
    batch has), then does the job, then marks itself as done. A batch repeated
    after a crash finds its own list and gives the job the very same runs, or
    finds its mark and does nothing. The job must replace what it wrote for a
    run before, as :func:`galespark.sinks.writers.log_passes` does."""
    keys = RUN_STATE.fieldNames()

    def sink(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        listed, done = f"{log}/runs/batch={n}", f"{log}/marks"
        if exists(spark, f"{done}/{n}.done"):
            return
        if not exists(spark, f"{done}/{n}.listed"):
            runs = df.filter(wanted).select(*keys).distinct()
            if exists(spark, f"{log}/runs"):
                known = spark.read.schema(T.StructType([*RUN_STATE.fields, T.StructField("batch", T.LongType())])).parquet(f"{log}/runs")
                runs = runs.join(known.filter(F.col("batch") != n), keys, "left_anti")
            runs.write.mode("overwrite").parquet(listed)
            touch(spark, f"{done}/{n}.listed")
        runs = spark.read.schema(RUN_STATE).parquet(listed)
        if not runs.isEmpty():
            job(runs)
        touch(spark, f"{done}/{n}.done")

    return sink


def changed_only(listing: DataFrame, seen_path: str, sink: Callable[[DataFrame], None]) -> bool:
    """Run the sink on files that are new or newer than at the last call."""
    spark = listing.sparkSession
    if exists(spark, seen_path):
        seen = spark.read.schema("path string, seen timestamp").parquet(seen_path)
    else:
        seen = spark.createDataFrame([], "path string, seen timestamp")
    last = seen.groupBy("path").agg(F.max("seen").alias("seen"))
    fresh = listing.join(last, "path", "left").filter(F.col("seen").isNull() | (F.col("modificationTime") > F.col("seen")))
    if fresh.isEmpty():
        return False
    sink(fresh.drop("seen"))
    fresh.select("path", F.col("modificationTime").alias("seen")).write.mode("append").parquet(seen_path)
    return True
