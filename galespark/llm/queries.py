"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op3_exact_dedup",
    """
    with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) h
               from documents)
    select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, h as text_sha256
    from d window w as (partition by h)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galespark.llm import exact_dedup

    out = exact_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query("op10_simhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galespark.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_embedding_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galespark.llm import embed_dedup

    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from galespark.llm import token_counts

    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from galespark.llm import packing

    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galespark.llm import langid
    from galespark.llm.vectors import remainder

    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), langid.learn(docs.filter(remainder(3) != 1)))
    return out.select(
        "doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected")
    )


@query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galespark.llm import quality
    from galespark.llm.vectors import remainder

    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels").filter(remainder(5) != 0))
    out = quality.score(docs, model)
    return out.select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


@query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galespark.llm import secret_scan

    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query("op9_lm_scoring")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galespark.llm import lm
    from galespark.llm.vectors import remainder

    docs = table(spark, sf_dir, "documents")
    out = lm.score(docs, *lm.learn(docs.filter(remainder(7) != 2)))
    return out.select("doc_id", (remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query("op6_piece_sampling")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from galespark.llm import piece_sampling

    out = piece_sampling.sample(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "draw", "n_pieces", "log_prob", "log_inclusion", F.crc32("ids").alias("ids_crc32"), "round_trip")


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galespark.llm import periodic_runs

    out = periodic_runs.find(periodic_runs.repeat_tails(table(spark, sf_dir, "documents")))
    # the longest run; of equally long ones the first, then the one of the least period
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    out = out.withColumn("longest", longest)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return out.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.expr("-longest.start").alias("start"),
        F.col("longest.length"),
        F.expr("-longest.period").alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galespark.llm import whitening

    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query(
    "op13_decontaminate",
    r"""
    with d as (
      select row_number() over () rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
      from documents),
    b as (
      select item_id::varchar item_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
      from benchmark),
    bi as (select item_id, w, least(10, len(w)) k, unnest(range(1, len(w) - least(10, len(w)) + 2)) i from b where len(w) > 0),
    bw as (select distinct item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') s from bi),
    di as (select rid, w, k, unnest(range(1, len(w) - k + 2)) i from d, (select distinct k from bw) where len(w) >= k),
    dw as (select rid, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') s from di),
    m as (select rid, k, i, item_id from dw join bw using (k, s)),
    h as (select rid, count(distinct p) n_hit from (select rid, unnest(range(i, i + k)) p from (select distinct rid, k, i from m)) group by rid),
    t as (select rid, count(*) n_items, string_agg(item_id, ',' order by item_id) items from (select distinct rid, item_id from m) group by rid)
    select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
           sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
    from d left join h using (rid) left join t using (rid)
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galespark.llm import decontaminate

    out = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s.end - s.start)
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
