"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", app: str = "galespark") -> SparkSession:
    """A session for tests and benches; a cluster supplies its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Let measured sizes alone decide on broadcasts.

    Estimates do not see how far an explode multiplies its rows, so a side
    that looks small may be huge. Planned broadcasts are therefore off; the
    adaptive planner still turns a join into a broadcast once a finished
    shuffle shows that a side is small. Explicit hints follow a count."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a temporary one is set
    only where a local session (a test, a laptop) names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="galespark-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession) -> str:
    """A new folder name below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A written table ends the lineage, outlives lost executors and, unlike an
    RDD checkpoint, gives the optimizer real sizes, so later joins broadcast
    only what is proven small.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _store(spark: SparkSession, path: str):
    """The file system that a path lies in, and the path as it names it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data, in whatever store it lies."""
    fs, at = _store(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _store(spark, path)
    return fs.exists(at)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, whose presence marks something as done."""
    fs, at = _store(spark, path)
    fs.create(at, True).close()


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, sorted; none where there is no such folder."""
    fs, at = _store(spark, path)
    if not fs.exists(at):
        return []
    return sorted(f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory())


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only after counting that the side holds few rows; a
    larger side keeps the shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
