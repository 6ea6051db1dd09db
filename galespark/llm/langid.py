"""Language identification by the nearest of several centroids per language.

A text becomes the TF-IDF vector of its byte bigrams and trigrams (ASCII folded
to lower case, everything in ASCII but letters to a space). The training sample
of each language is clustered by spherical k-means; a document goes to the
language of the centroid with the largest cosine, and is rejected where even
that one is farther away than documents of that language are: the least cosine
is ``SLACK`` times the ``QUANTILE`` of what each half of the sample reaches on
centroids of the other half. It is lowered in proportion for texts with fewer
than ``ENOUGH`` different n-grams, which say little; ``limit`` holds for all.

The classifier is fitted on a sample bounded by ``PER_LANGUAGE`` documents (in
expectation) of each language; it is applied to every whole text.

Defined results: null texts and texts without a letter are ``und`` with score 0
and rejected; with nothing to learn from everything is ``und``; ties go to the
first language by name; repeated rows give repeated results; an empty table
gives an empty result; further columns are kept by ``identify``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

from galespark.llm import vectors
from galespark.llm.names import widened

PER_LANGUAGE, CENTROIDS, ROUNDS = 300, 4, 12
LIMIT = 0.95  # cosine distance from which a document of any length is in no known language
QUANTILE, SLACK, ENOUGH = 0.05, 0.55, 128
UNKNOWN = "und"
FOLD = bytes(
    b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256)
)


def count(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    return vectors.ngram_counts(b" " + b" ".join(words) + b" ")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # unit rows
    owner: np.ndarray  # language of each centroid
    least: np.ndarray  # cosine that documents of each language reach

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine, and the cosine that the text should have."""
        names, score, least = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        rows = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        for at in range(0, len(rows), vectors.BLOCK):
            part = rows[at : at + vectors.BLOCK]
            counts = vectors.block([count(texts[i]) for i in part])
            near = vectors.product(vectors.tf_idf(counts, self.idf), self.centroids)[: len(part)]
            best = near.argmax(axis=1)
            least[part] = self.least[self.owner[best]] * np.minimum(1, (counts[: len(part)] > 0).sum(axis=1) / ENOUGH)
            score[part] = np.clip(near[np.arange(len(part)), best], 0, 1)
            for i, b in zip(part, best):
                names[i] = self.languages[self.owner[b]]
        return names, score, least


def clusters(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from a farthest-point start; unit centroids."""
    centre = vectors.unit_rows(x.mean(axis=0, keepdims=True))
    while len(centre) < min(k, len(x)):
        far = (x @ centre.T).max(axis=1).argmin()
        centre = np.vstack([centre, x[far : far + 1]])
    for _ in range(rounds):
        own = (x @ centre.T).argmax(axis=1)
        centre = np.vstack([x[own == c].mean(axis=0) if (own == c).any() else centre[c] for c in range(len(centre))])
        centre = vectors.unit_rows(centre)
    return centre


def reached(x: np.ndarray, k: int) -> float:
    """Low quantile of the cosines of rows to the centroids of the other half; 0 where a half is empty."""
    if len(x) < 2:
        return 0.0
    halves = x[::2], x[1::2]
    best = [(a @ clusters(b, k).T).max(axis=1) for a, b in (halves, halves[::-1])]
    return float(np.quantile(np.concatenate(best), QUANTILE))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, k: int = CENTROIDS) -> Model:
    """``docs`` are the rows that may be learned from."""
    known = docs.filter("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # a row per language
    if not sizes:
        return Model([], np.zeros(0), np.zeros((0, 0)), np.zeros(0, int), np.zeros(0))
    share = F.coalesce(*(F.when(F.col("lang") == name, F.lit(min(1.0, per_language / n))) for name, n in sizes.items()))
    label, counts = vectors.learned_from(known.filter(vectors.spread() < share), "lang", count)
    languages, idf = sorted(set(label)), vectors.idf_of(counts)
    x = vectors.tf_idf(counts, idf)
    own = [clusters(x[label == name], k) for name in languages]
    least = SLACK * np.array([reached(x[label == name], k) for name in languages])
    return Model(languages, idf, np.vstack(own).astype(float), np.repeat(np.arange(len(own)), [len(c) for c in own]), least)


VERDICT = ("lang_pred", "lang_score", "lang_rejected")


def identify(docs: DataFrame, model: Model, limit: float = LIMIT, names: tuple[str, str, str] = VERDICT) -> DataFrame:
    """``docs`` with the language, its score and whether it is rejected, under
    ``names``; columns that have these names before are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few centroids per language
    rest = docs.drop(*names)
    added = [StructField(n, k) for n, k in zip(names, (StringType(), DoubleType(), BooleanType()))]
    at = rest.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score, least = shared.value(b.column(at).to_pylist())
            rejected = (np.array(names, object) == UNKNOWN) | (score < np.maximum(1 - limit, least))
            new = [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[f"c{i}" for i in range(b.num_columns)] + ["p", "s", "r"])

    return widened(rest, run, added)
