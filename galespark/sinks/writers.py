"""Writers. Each takes a DataFrame and leaves files other jobs can read."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce
from operator import and_
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galespark.session import exists, folders, remove, touch

RUN_FORMAT = "yyyy-MM-dd'T'HHmm"


def overwrite_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace only the partitions that occur in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def log_passes(runs: DataFrame, passes: DataFrame, path: str) -> None:
    """Replace the passes logged for some runs, one partition per start of runs.

    A run that no pass sees gets one row without a pass, which clears what was
    logged for it and tells a run without passes from one not predicted yet.
    Runs that start together share a partition, so that files number the starts,
    not the models times the starts. What other models have there is carried
    over through a side table; one that a crash has left whole is put in first."""
    keys, spark, side = ["model_name", "init_time"], runs.sparkSession, f"{path}_side"
    named = runs.select(*keys).distinct().withColumn("run", run_name("init_time"))
    rows = named.join(passes, keys, "left")

    def put():
        overwrite_partitions(spark.read.schema(rows.schema).parquet(side), path, ["run"])
        remove(spark, side)

    if exists(spark, f"{side}/_SUCCESS"):
        put()
    if exists(spark, path):
        same = lambda a, b, names: reduce(and_, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names))
        stored = spark.read.schema(rows.schema).parquet(path).alias("s")
        stored = stored.join(named.select("run").distinct().alias("d"), same("s", "d", ["run"]), "left_semi")
        rows = rows.unionByName(stored.alias("s").join(named.alias("n"), same("s", "n", keys), "left_anti"))
    rows.write.mode("overwrite").parquet(side)
    put()


def partitions(spark: SparkSession, path: str, column: str) -> list[tuple[str, str]]:
    """(value, folder) of a table's partitions by ``column``, on whatever level
    it stands, from the listing of folders alone."""
    out = []
    for name in folders(spark, path):
        key, _, value = name.partition("=")
        if key == column:
            out.append((unquote(value), f"{path}/{name}"))
        elif value:
            out += partitions(spark, f"{path}/{name}", column)
    return sorted(out)


def drop_partitions(spark: SparkSession, path: str, column: str, before: str) -> list[str]:
    """Delete the partitions of a table whose ``column`` lies before a value;
    returns the values. No row is read."""
    old = [(value, folder) for value, folder in partitions(spark, path, column) if value < before]
    for _, folder in old:
        remove(spark, folder)
    return sorted({value for value, _ in old})


def run_name(time: str) -> Column:
    """Name of a run's partition; names sort as times do."""
    return F.date_format(time, RUN_FORMAT)


def retain(spark: SparkSession, tables: dict[str, str], leading: str, ledger: str, today: date, days: int = 10, column: str = "run") -> dict[str, list[str]] | None:
    """Once a day, drop every table's runs that start more than some days
    before the newest run of the leading table.

    Tables are folders partitioned by run; names alone decide, no row is read.
    The ledger keeps a mark per day. None is returned where the day has its
    mark, else the runs that went, by table."""
    mark = f"{ledger}/{today.isoformat()}.done"
    if exists(spark, mark):
        return None
    names = [value for value, _ in partitions(spark, tables[leading], column)]
    gone: dict[str, list[str]] = {}
    if names:
        cutoff = datetime.strptime(max(names), "%Y-%m-%dT%H%M") - timedelta(days=days)
        for name, path in tables.items():
            gone[name] = drop_partitions(spark, path, column, cutoff.strftime("%Y-%m-%dT%H%M"))
    touch(spark, mark)
    return gone


def append(df: DataFrame, path: str, keys: list[str] = []) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def write_decks(lines: DataFrame, path: str) -> None:
    """Deck text by storm, lines in order of their run.

    Ranges over (storm, run) split a storm with very many lines over several
    files whose names keep the order; no task holds a whole storm by need."""
    ordered = lines.repartitionByRange("atcf_id", "init_text").sortWithinPartitions("atcf_id", "init_text", "value")
    ordered.select("atcf_id", "value").write.mode("overwrite").partitionBy("atcf_id").text(path)


def swath_features(swaths: DataFrame) -> DataFrame:
    """One GeoJSON feature per line; ring points become coordinate pairs."""
    pairs = F.transform("ring", lambda p: F.array(p["lon"], p["lat"]))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(
            "satellite_name", "ascending", "interp_id",
            F.date_format("valid_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("valid_time"),
        ).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(pairs).alias("coordinates")).alias("geometry"),
    )
    return swaths.select(F.to_json(feature).alias("value"))


def write_swaths(swaths: DataFrame, path: str) -> None:
    swath_features(swaths).write.mode("overwrite").option("compression", "gzip").text(path)
