"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text becomes the TF-IDF vector of its raw byte bigrams and trigrams (case and
punctuation matter) and of a few style terms: how many words repeat the word
before, how many lines repeat, how many words are all capitals or end in
symbols, each as a step of its share. A truncated SVD of the labelled sample
gives the latent space. The sample's latent vectors and labels are broadcast;
every document is compared with all of them by blocked exact cosine products,
and the nearest vote with their similarity as weight.

The sample is bounded by ``LABELLED`` labelled documents; scoring covers every
whole text. Labels, language, source and identifiers are never inputs.

Defined results: null and empty texts get the score of the empty vector, the
sample's mean label; conflicting labels of a document count with their mean;
ties in similarity go to the earlier sample row; repeated rows give repeated
results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galespark.llm import vectors

LABELLED, RANK, NEIGHBOURS = 5000, 48, 15
STEPS = 12
STYLE_WEIGHT = 4.0
FEATURES = 6
SYMBOLS = b"!#$%&*|"


def style(text: str) -> np.ndarray:
    """Shares of words and lines with a property, each as one step in a one-hot block."""
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))
    letters = sum(map(str.isupper, words))
    bare = text.encode("utf-8", "surrogatepass")
    share = (
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        letters / n,
        min(1.0, (len(bare) - len(bare.translate(None, SYMBOLS))) / n),
        min(1.0, np.log1p(len(words)) / 10),
    )
    out = np.zeros((FEATURES, STEPS), np.float32)
    for i, s in enumerate(share):
        out[i, min(STEPS - 1, int(np.ceil(s * (STEPS - 1))))] = 1
    return out.ravel()


def count(text: str | None) -> np.ndarray:
    text = text or ""
    return np.concatenate([vectors.ngram_counts(text.encode("utf-8", "surrogatepass")), style(text) if text.strip() else np.zeros(FEATURES * STEPS)])


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF of the n-grams beside the weighted style terms."""
    split = FEATURES * STEPS
    grams = vectors.tf_idf(counts[:, :-split], idf[:-split])
    return np.hstack([grams, counts[:, -split:] * STYLE_WEIGHT / np.sqrt(split)])


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray  # a row per latent dimension
    points: np.ndarray  # unit rows
    labels: np.ndarray
    k: int

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return vectors.unit_rows(vectors.product(weighted(counts, self.idf), self.axes))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        score = np.empty(len(texts))
        mean = float(self.labels.mean()) if len(self.labels) else 0.5
        for at in range(0, len(texts), vectors.BLOCK):
            part = texts[at : at + vectors.BLOCK]
            if not len(self.points):
                score[at : at + len(part)] = mean
                continue
            near = vectors.product(self.latent(vectors.block([count(t) for t in part])), self.points)
            weight = np.where(nearest(near, min(self.k, near.shape[1])), np.clip(near, 0, None), 0)
            total = weight.sum(axis=1)
            vote = (weight * self.labels).sum(axis=1)
            score[at : at + len(part)] = np.where(total > 0, vote / np.where(total > 0, total, 1), mean)[: len(part)]
        return np.clip(score, 0, 1)


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """Marks of the k largest of each row; of equal ones the first."""
    least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
    more, equal = near > least, near == least
    return more | equal & (np.cumsum(equal, axis=1) <= k - more.sum(axis=1, keepdims=True))


def latent_axes(x: np.ndarray, rank: int, seed: int = 5) -> np.ndarray:
    """Leading right singular vectors by subspace iteration."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(seed).standard_normal((x.shape[1], rank + 8)).astype(np.float32)
    for _ in range(5):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    return (q @ np.linalg.svd(x @ q, full_matrices=False)[2].T)[:, :rank].astype(np.float32)


def learn(docs: DataFrame, labels: DataFrame, size: int = LABELLED, rank: int = RANK, k: int = NEIGHBOURS) -> Model:
    """``labels(doc_id, quality)`` are those that may be learned from."""
    known = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.avg("quality").alias("quality"))
    sample = known.orderBy(vectors.spread(), "doc_id").limit(size)
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").join(F.broadcast(sample), "doc_id")  # at most `size` rows
    label, counts = vectors.learned_from(rows, "quality", count)
    if not len(counts):
        return Model(np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0), k)
    idf = vectors.idf_of(counts)
    x = weighted(counts, idf).astype(np.float32)
    axes = latent_axes(x, rank)
    return Model(idf, np.ascontiguousarray(axes.T, float), vectors.unit_rows(x.astype(float) @ axes), label.astype(float), k)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = shared.value(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, score double")
