"""Hashed n-gram count vectors of whole texts, and a bounded training sample."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 12  # 4096 buckets
PIECE = 1 << 20  # bytes hashed at a time; very long texts add up piece by piece
MULTIPLIER = 2654435761  # multiplicative hashing, 2^32 over the golden ratio
BLOCK = 128  # rows of every matrix product


def ngram_counts(raw: bytes, bits: int = BITS) -> np.ndarray:
    """Counts of all byte bigrams and trigrams in hashed buckets."""
    out = np.zeros(1 << bits, np.float32)
    for at in range(0, max(len(raw) - 1, 0), PIECE):
        a = np.frombuffer(raw, np.uint8, min(len(raw) - at, PIECE + 2), at).astype(np.uint32)
        two = a[:-1] << np.uint32(8) | a[1:]
        three = two[:-1] << np.uint32(8) | a[2:]
        shift = np.uint32(32 - bits)
        codes = np.concatenate([(two[:PIECE] + np.uint32(1 << 24)) * np.uint32(MULTIPLIER) >> shift, three[:PIECE] * np.uint32(MULTIPLIER) >> shift])
        out += np.bincount(codes, minlength=1 << bits)
    return out


def block(rows: list[np.ndarray]) -> np.ndarray:
    """At most ``BLOCK`` rows in a matrix of exactly that many, in doubles."""
    out = np.zeros((BLOCK, len(rows[0])))
    out[: len(rows)] = rows
    return out


def product(block: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Dot products of all rows with all points, each summed in one order.

    A library's matrix product sums a row in another order at another place or
    with another number of threads; here equal texts get equal scores in any batch."""
    return np.einsum("ij,kj->ik", block, points)


def unit_rows(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit_rows(np.log1p(counts) * idf)


def idf_of(counts: np.ndarray) -> np.ndarray:
    return (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)


def learned_from(docs: DataFrame, label: str, count: Callable[[str | None], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Labels and count vectors of a training sample that the caller has bounded.
    Only fixed-size vectors travel, whatever the length of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = pa.array([count(t.as_py()).astype("<f4").tobytes() for t in b.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), raw], names=["doc_id", "label", "raw"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col(label).cast("string").alias("label"), F.col("text").cast("string"))
    got = rows.mapInArrow(run, "doc_id bigint, label string, raw binary").toArrow().sort_by([("doc_id", "ascending"), ("raw", "ascending")])
    counts = [np.frombuffer(x.as_py(), "<f4") for x in got["raw"]]
    return np.array(got["label"].to_pylist(), object), np.stack(counts) if counts else np.zeros((0, 1), np.float32)


def remainder(n: int) -> F.Column:
    """crc32 of the identifier as text, modulo n; a null identifier counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def spread() -> F.Column:
    """A fixed uniform number in [0, 1) of a row's identifier, for reproducible samples."""
    return F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
