"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Texts become hashed counts of byte and shape n-grams and of repeated words (square root, idf, length 1), projected on
the leading right singular vectors of a sample (latent semantic analysis). The labelled vectors
are broadcast, and the cosines of every document with every labelled vector are computed exactly,
in blocks. The K nearest vote with their label, weighted by similarity; a prior worth one vote at
cosine PRIOR_AT closes gaps.

The classifier is fitted on a bounded sample: the SAMPLE labelled ids of least hash, never more. The
broadcast is SAMPLE x RANK floats and the projection 2**BITS x RANK.

Defined cases: empty or null text, and text too short for an n-gram, scores the prior (the share
of label 1 in the sample; 0.5 without labels); of several labels of one id the largest counts, null
labels never; of several texts of one id one counts (the least by its features); neighbours that tie
for the K-th place are any of them; very long texts are scored whole; null ids are scored and never
learned from; other columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import fold, table
from .features import hashed_counts, randomized_svd, unit_rows
from .texthash import Words, chunks, text_buffer, trimmed

BITS = 12
RANK = 64
SAMPLE = 8000
K = 25
POWER = 8.0
PRIOR_AT = 0.5
REPEAT_WEIGHT = 4.0
DIMS = (1 << BITS) + 3
GRAMS = [("byte", 3), ("shape", 2), ("shape", 4)]


def counts(buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of n-gram counts, then of how often a word equals the one 1, 2 or 3 before it."""
    words = Words(buffer, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), words.counts)
    again = [np.bincount(owner[k:][(words.hash[k:] == words.hash[:-k]) & (owner[k:] == owner[:-k])], minlength=len(offsets) - 1) for k in (1, 2, 3)]
    grams = np.sqrt(hashed_counts(buffer, offsets, GRAMS, BITS))
    return np.concatenate([grams, REPEAT_WEIGHT * np.sqrt(np.stack(again, 1)).astype(np.float32)], 1)


@trimmed
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, limit=1 << 20, rows=256):
        x = counts(*text_buffer(batch.column("text"))).astype(np.float16)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])


class NeighbourModel:
    """Projection, labelled vectors and labels."""

    def __init__(self, x: np.ndarray, label: np.ndarray):
        self.label = label.astype(np.float32)
        self.prior = float(label.mean()) if len(label) else 0.5
        if not len(label):
            return
        self.idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
        x = unit_rows(x * self.idf)
        self.base = randomized_svd(x, RANK).astype(np.float32)
        self.points = unit_rows(x @ self.base)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.label):
            return np.full(len(x), self.prior)
        q = unit_rows(unit_rows(x * self.idf) @ self.base)
        cosine = q @ self.points.T
        k = min(K, len(self.label))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** POWER
        prior = PRIOR_AT**POWER
        return np.clip(((weight * self.label[near]).sum(1) + prior * self.prior) / (weight.sum(1) + prior), 0, 1)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> NeighbourModel:
    """Fit on (doc_id, text) and (doc_id, quality)."""
    ship(docs.sparkSession)
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    # `sample` rows of two numbers at most: fit to broadcast whatever the size of the table.
    picked = known.orderBy(F.xxhash64("doc_id", F.lit("quality sample")), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").where("text is not null")
    featured = rows.mapInArrow(_features, "doc_id long, quality int, x binary")
    got = featured.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toArrow()
    order = np.argsort(np.array(got.column("doc_id").to_pylist(), np.int64), kind="stable")
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(-1, DIMS)[order].astype(np.float32)
    return NeighbourModel(x, np.array(got.column("quality").to_pylist(), np.int64)[order])


def _score(model: NeighbourModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=1 << 20, rows=256):
            score = model.score(counts(*text_buffer(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return trimmed(run)


def score(docs: DataFrame, model: NeighbourModel) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id long, score double")


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(fold("doc_id", 3) != 1))
    scored = score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
