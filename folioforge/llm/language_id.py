"""Language identification: family first, then one-versus-one linear SVMs within the family.

Features are square roots of hashed counts of lower-cased byte n-grams over the whole text,
scaled to length 1. Families are learned: languages whose mean vectors are close are merged
(average linkage) until about the square root of their number is left. One-versus-rest linear
SVMs tell families apart; within a family every pair of languages has an SVM of its own, and
the language with the most support wins, ties to the first in order.

The classifier is fitted on a bounded sample: about SAMPLE documents in all, drawn by a hash of
the identifier, evenly over languages; each language gives its document of least hash in any case,
so none is lost however many there are. The model is broadcast (languages x 2**BITS floats).

Defined cases: null text or text without a letter gives `und` with score 0; without any
labelled document everything is `und`; one language is predicted with score 1; equal support goes
to the first language in order; null ids are scored and never learned from; rows that repeat are
scored and learned from each; very long texts are read whole; an empty table gives no rows. A column
named _letter, _lang_pred or _lang_score must not be in the input of `predict`; others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import fold, table
from .features import hashed_counts, linear_svm, unit_rows
from .texthash import chunks, text_buffer, trimmed

BITS = 12
SAMPLE = 2000
GRAMS = [("lower", 2), ("lower", 3), ("lower", 4)]
UNKNOWN = "und"


def vectors(buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return unit_rows(np.sqrt(hashed_counts(buffer, offsets, GRAMS, BITS)))


@trimmed
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, limit=1 << 20, rows=256):
        x = vectors(*text_buffer(batch.column("text"))).astype(np.float16)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "lang", "x"])


def families_of(means: np.ndarray, count: int) -> list[list[int]]:
    groups = [[i] for i in range(len(means))]
    near = unit_rows(means) @ unit_rows(means).T
    while len(groups) > max(1, count):
        link = [(-near[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups[:i])]
        _, i, j = min(link)
        groups[j] = sorted(groups[j] + groups[i])
        del groups[i]
    return sorted(groups)


class HierarchicalModel:
    def __init__(self, x: np.ndarray, lang: np.ndarray):
        self.langs = sorted(set(lang.tolist()))
        y = np.searchsorted(self.langs, lang)
        self.families: list[list[int]] = []
        if not self.langs:
            return
        means = np.stack([x[y == i].mean(0) for i in range(len(self.langs))])
        self.families = families_of(means, round(len(self.langs) ** 0.5))
        home = np.zeros(len(self.langs), int)
        for f, members in enumerate(self.families):
            home[members] = f
        many = len(self.families) > 1
        self.family_w = np.stack([linear_svm(x, np.where(home[y] == f, 1, -1)) for f in range(len(self.families))]).astype(np.float32) if many else None
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        for members in self.families:
            for k, a in enumerate(members):
                for b in members[k + 1 :]:
                    rows = np.flatnonzero((y == a) | (y == b))
                    self.pairs[a, b] = linear_svm(x[rows], np.where(y[rows] == a, 1, -1)).astype(np.float32)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and its score for each row of features."""
        n = len(x)
        x1 = np.concatenate([x, np.ones((n, 1), x.dtype)], 1)
        family, trust = np.zeros(n, int), np.ones(n)
        if self.family_w is not None:
            margin = x1 @ self.family_w.T
            family = margin.argmax(1)
            odds = np.exp(2 * (margin - margin.max(1, keepdims=True)))
            trust = odds.max(1) / odds.sum(1)
        best, score = np.zeros(n, int), np.zeros(n)
        for f, members in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            if not len(rows):
                continue
            support = np.zeros((len(rows), len(members)))
            for k, a in enumerate(members):
                for m in range(k + 1, len(members)):
                    p = 1 / (1 + np.exp(-2 * (x1[rows] @ self.pairs[a, members[m]]).astype(float)))
                    support[:, k] += p
                    support[:, m] += 1 - p
            support = support / (len(members) - 1) if len(members) > 1 else np.ones((len(rows), 1))
            best[rows], score[rows] = np.array(members)[support.argmax(1)], support.max(1) * trust[rows]
        return best, np.clip(score, 0, 1)


def train(docs: DataFrame, sample: int = SAMPLE) -> HierarchicalModel:
    """Fit on rows of (doc_id, text, lang); null languages, texts and ids are left out."""
    ship(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null and doc_id is not null")
    hashed = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(hashed).alias("least")).collect()  # a row for each language
    if not counts:
        return HierarchicalModel(np.zeros((0, 1 << BITS)), np.zeros(0, object))
    each = max(1, sample // len(counts))
    upto = docs.sparkSession.createDataFrame([(r.lang, max(r.least, int(min(1.0, each / r.n) * (1 << 30)) - 1)) for r in counts], "lang string, upto long")
    picked = rows.join(F.broadcast(upto), "lang").where(hashed <= F.col("upto")).select("doc_id", "lang", "text")
    got = picked.mapInArrow(_features, "doc_id long, lang string, x binary").toArrow()
    lang = np.array(got.column("lang").to_pylist(), object)
    order = np.lexsort((np.array(got.column("doc_id").to_pylist()), lang))
    column = got.column("x")
    del got
    x = np.empty((len(lang), 1 << BITS), np.float32)
    for to, row in enumerate(order.tolist()):
        x[to] = np.frombuffer(column[row].as_buffer(), np.float16)
    del column
    return HierarchicalModel(x, lang[order])


def _predict(model: HierarchicalModel):
    names = np.array([*model.langs, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=1 << 20, rows=256):
            letter = batch.column("_letter").to_numpy(zero_copy_only=False).astype(bool)
            if model.langs:
                best, score = model.predict(vectors(*text_buffer(batch.column("text"))))
                best, score = np.where(letter, best, -1), np.where(letter, score, 0.0)
            else:
                best, score = np.full(len(letter), -1), np.zeros(len(letter))
            at = batch.schema.get_field_index("_letter")
            rest = [batch.column(i) for i in range(batch.num_columns) if i != at]
            kept = [n for n in batch.schema.names if n != "_letter"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(names[best], pa.string()), pa.array(score)], names=[*kept, "_lang_pred", "_lang_score"])

    return trimmed(run)


def predict(docs: DataFrame, model: HierarchicalModel) -> DataFrame:
    """Add _lang_pred and _lang_score to the rows' own columns (one of them is text)."""
    letter: Column = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    schema = T.StructType([*docs.schema.fields, T.StructField("_lang_pred", T.StringType()), T.StructField("_lang_score", T.DoubleType())])
    return docs.withColumn("_letter", letter).mapInArrow(_predict(model), schema)


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold("doc_id", 5) != 0).select("doc_id", "text", "lang"))
    scored = predict(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"))
