"""Exact deduplication as a stream with disk-backed keyed state.

Every row becomes a small event (digest, stable identifier, locator). A
streaming aggregation keyed by digest keeps, without expiry, the largest
identifier with its locator and the number of rows; the state lives in RocksDB
on the executors' disks and in the checkpoint, so a stream that goes on later
still knows every digest. A digest is only a hint: wherever it was hit more
than once the whole texts are compared, and a digest shared by different texts
is taken apart by the texts themselves.

Defined results: a null text equals the empty one; a null identifier is smaller
than any other; of repeated rows with one identifier the one with the larger
locator stays; an empty table gives an empty result; further columns are ignored
(``events``) or kept, whatever their names (``keep_one``).
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galespark.llm.names import free, quoted
from galespark.session import cut, scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BROADCAST_ROWS = 200_000  # about 20 MB of digests; more rows go by a shuffle join


def normalised(text) -> F.Column:
    """Lower case for A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def sha256(text) -> F.Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def events(docs: DataFrame, digest=sha256) -> DataFrame:
    """One small row per document: identifier, digest, locator (its place in this listing)."""
    return docs.select(
        F.col("doc_id"), digest(normalised(F.col("text"))).alias("digest"), F.monotonically_increasing_id().alias("locator")
    )


@contextmanager
def _settings(spark, values: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def track(rows: DataFrame, checkpoint: str, sink: str) -> None:
    """Fold all rows of the stream that have arrived into the keyed state.

    ``rows`` is a streaming frame of events. Changed state goes to ``sink``, a
    folder per micro-batch, written over when a batch is repeated."""
    state = rows.groupBy("digest").agg(
        F.max(F.struct("doc_id", "locator")).alias("best"), F.count(F.lit(1)).alias("group_size")
    )

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    memory = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores; no space ahead of need
    }
    with _settings(rows.sparkSession, memory):
        query = (
            state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()


def state_of(spark, sink: str) -> DataFrame:
    """The state after the last batch: counts and best rows only ever grow."""
    schema = "digest string, best struct<doc_id: bigint, locator: bigint>, group_size bigint, batch bigint"
    return (
        spark.read.schema(schema).parquet(sink).groupBy("digest")
        .agg(F.max("best").alias("best"), F.max("group_size").alias("group_size"))
        .select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.locator").alias("keep_at"), "group_size")
    )


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int) -> DataFrame:
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, on, how)


def dedup(docs: DataFrame, digest=sha256, files_per_batch: int = 100_000) -> DataFrame:
    """One row per document: doc_id, locator, digest, keep_id, group_size, kept."""
    spark = docs.sparkSession
    at = scratch_path(spark)
    schema = "doc_id bigint, digest string, locator bigint"
    events(docs.select(F.col("doc_id").cast("bigint"), "text"), digest).write.parquet(f"{at}/events")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{at}/events")
    track(stream, f"{at}/state", f"{at}/updates")
    listed = spark.read.schema(schema).parquet(f"{at}/events")
    if listed.isEmpty():
        return listed.selectExpr(
            "doc_id", "locator", "digest", "doc_id as keep_id", "cast(0 as bigint) as group_size", "true as kept"
        )
    state = cut(state_of(spark, f"{at}/updates"))
    marked = listed.join(state, "digest", "left")
    clash = _clashes(docs, state, digest)
    if not clash.isEmpty():
        marked = _apart(docs, marked, clash, digest)
    return marked.select(
        "doc_id", "locator", "digest", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("locator") == F.col("keep_at"))).alias("kept"),
    )


def _clashes(docs: DataFrame, state: DataFrame, digest) -> DataFrame:
    """Digests whose texts differ. All bytes of every hit are compared, as the
    least and greatest text of a digest, which fold to one text per task
    before the shuffle however large the group of copies is."""
    hits = state.filter("group_size > 1").select("digest")
    n = hits.count()
    texts = docs.select(normalised(F.col("text")).alias("text")).withColumn("digest", digest(F.col("text")))
    return cut(
        _joined(texts, hits, ["digest"], "left_semi", n).groupBy("digest")
        .agg(F.min("text").alias("least"), F.max("text").alias("most")).filter("least <> most").select("digest")
    )


def _apart(docs: DataFrame, marked: DataFrame, clash: DataFrame, digest) -> DataFrame:
    """Decide the rows of clashing digests by whole texts."""
    rows = docs.select(F.col("doc_id").cast("bigint"), normalised(F.col("text")).alias("text")).withColumn("digest", digest(F.col("text")))
    rows = cut(rows.withColumn("locator", F.monotonically_increasing_id()).join(clash, "digest", "left_semi"))
    best = rows.groupBy("digest", "text").agg(
        F.max(F.struct("doc_id", "locator")).alias("b"), F.count(F.lit(1)).alias("group_size")
    )
    solved = rows.join(best, ["digest", "text"]).select(
        "digest", "doc_id", "locator", F.col("b.doc_id").alias("keep_id"), F.col("b.locator").alias("keep_at"), "group_size"
    )
    rest = marked.join(clash, "digest", "left_anti")
    return rest.unionByName(solved)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay.

    Rows are found again by identifier and digest; whole rows repeated under
    one identifier come back once."""
    # written, so that the join by digest stands alone and a hot digest can be split
    verdict = cut(dedup(docs).select("doc_id", "digest", "kept"))
    drop = cut(verdict.groupBy("doc_id", "digest").agg(F.max("kept").alias("any"), F.count(F.lit(1)).alias("n")).filter("not any or n > 1"))
    id_, digest_, gone_id, gone_digest = free(docs.columns, "id", "digest", "gone_id", "gone_digest")
    keyed = docs.withColumns({id_: F.col("doc_id").cast("bigint"), digest_: sha256(normalised(F.col("text")))})
    listed = lambda rows: rows.select(F.col("doc_id").alias(gone_id), F.col("digest").alias(gone_digest))
    same = F.col(id_).eqNullSafe(F.col(gone_id)) & (F.col(digest_) == F.col(gone_digest))
    gone, twice = (F.broadcast(x) if x.count() <= BROADCAST_ROWS else x for x in (listed(drop.filter("not any")), listed(drop.filter("any"))))
    left = keyed.join(gone, same, "left_anti")
    once = left.join(twice, same, "left_anti")
    again = left.join(twice, same, "left_semi").dropDuplicates([id_, digest_])
    return once.unionByName(again).select(*quoted(docs))
