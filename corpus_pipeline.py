"""Corpus preparation: language, exact copies, near copies, secrets, packing.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and
returns a frame that is written and read again as the next one's ``docs``. All
but the last return the columns of ``documents``. The functions read nothing
but ``docs``, except that the language classifier learns from the documents
with a known language among them. Further columns come through all stages but
the last, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galespark.llm import exact_dedup, langid, packing, secret_scan, simhash
from galespark.llm.names import free, quoted
from galespark.session import scratch_path

ORACLE_SQL = None  # classifier, XXH64 fingerprints and tokenizer are not expressible in SQL


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter (null, empty) or
    too far from every centroid go. Repeated rows are judged alike."""
    names = free(docs.columns, "language", "score", "rejected")
    out = langid.identify(docs, langid.learn(docs), names=names)
    return out.filter(~F.col(names[2])).select(*quoted(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest identifier; null is an empty
    text and the smallest identifier. Of rows repeated whole one stays."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest
    identifier, one row of it; a row without one only where no other has one."""
    return simhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with every reported span replaced by a mark and ``n_chars`` set
    anew where there was one; null and empty texts stay as they are."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of fixed length; a null or
    empty text is one piece, repeated rows are packed each."""
    import public_tokenizers

    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("secret_scan", secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = scratch_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
