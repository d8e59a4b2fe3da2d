"""Exact top-k inner products by norm-bucketed retrieval (Teflioudi et al., SIGMOD 2015).

Query vectors come in blocks of at most BLOCK, each broadcast in turn; ROUND blocks share a job,
whose answers are written before the next, so that neither plan nor broadcasts grow with the queries.
A task sorts the vectors of an Arrow batch by length and cuts them into buckets. For a query with running
k-th best score t, bucket vectors need a cosine of at least t / (|q| * longest); a bucket
where that exceeds 1 is skipped. Else the bucket's local threshold chooses the pruning:
high, only vectors whose value in the query's largest coordinate is feasible for that angle
(coordinate); low, only the prefix that is long enough (length). Products of what is left are
computed exactly in integers. Each task sends k rows a query at most; a ranked window merges.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part,
nor do rows without an id; shorter vectors count as padded with zeros, however long others are; a
query's own id is no candidate; repeated rows are candidates each; an id with several vectors asks
with each of them, and its k rows are the best over all; ties go to the smaller id; fewer than k
candidates give fewer rows and an empty table none; components beyond 64 bits count as the nearest
64-bit number, and so do products; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import stored, table
from .texthash import trimmed

BLOCK = 1 << 14
ROUND = 8
BUCKET_ROWS = 512
#: Queries whose products with a bucket are computed at a time.
STRIP = 2048
COORDINATE_FROM = 0.8
_EXACT = float(1 << 53)
_MOST = (1 << 63) - 1


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    sizes = np.diff(column.offsets.to_numpy())
    width = max(width, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _whole(score: np.ndarray) -> np.ndarray:
    """Scores as 64-bit numbers; those beyond are the nearest."""
    return (np.clip(score, -_MOST, _MOST) if score.dtype == object else score).astype(np.int64)


class NormBuckets:
    """Running top k of a block of queries over batches of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, vectors, k
        self.norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        unit = vectors / np.maximum(self.norm, 1e-300)[:, None]
        self.focus = np.abs(unit).argmax(1) if unit.shape[1] else np.zeros(len(ids), int)
        self.angle = np.arccos(np.clip(unit[np.arange(len(ids)), self.focus], -1, 1)) if unit.shape[1] else np.zeros(len(ids))
        self.best_q = np.zeros(0, np.int64)
        self.best_id, self.best_score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = np.full(len(ids), -np.inf)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        width = max(vectors.shape[1], self.q.shape[1])
        q, v = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (self.q, vectors))
        norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
        order = np.argsort(-norm, kind="stable")
        ids, v, norm = ids[order], v[order], norm[order]
        bound = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(width, 1)
        kind = np.float64 if bound < _EXACT else object
        q, v = q.astype(kind), v.astype(kind)
        for at in range(0, len(ids), BUCKET_ROWS):
            self._bucket(q, ids[at : at + BUCKET_ROWS], v[at : at + BUCKET_ROWS], norm[at : at + BUCKET_ROWS])

    def _bucket(self, q: np.ndarray, ids: np.ndarray, v: np.ndarray, norm: np.ndarray) -> None:
        longest = norm[0] * (1 + 1e-9)
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(self.norm * longest > 0, self.floor / (self.norm * longest), np.where(self.floor > 0, np.inf, -np.inf))
        live = np.flatnonzero(local <= 1)
        by_coordinate = live[local[live] >= COORDINATE_FROM]
        by_length = live[local[live] < COORDINATE_FROM]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(by_length):
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where((self.norm[by_length] > 0) & (self.floor[by_length] > 0), self.floor[by_length] / self.norm[by_length] * (1 - 1e-9), 0)
            prefix = int(np.searchsorted(-norm, -least.min(), side="right"))
            for at in range(0, len(by_length), STRIP):
                rows = by_length[at : at + STRIP]
                score = q[rows] @ v[:prefix].T
                a, b = np.nonzero((score >= self._least(rows)[:, None]).astype(bool))
                found.append((rows[a], b, _whole(score[a, b])))
        if len(by_coordinate):
            spread = np.arccos(np.clip(local[by_coordinate], -1, 1)) + 1e-7
            low = np.cos(np.minimum(math.pi, self.angle[by_coordinate] + spread))
            high = np.cos(np.maximum(0, self.angle[by_coordinate] - spread))
            for at in range(0, len(by_coordinate), STRIP):
                rows, some = by_coordinate[at : at + STRIP], slice(at, at + STRIP)
                value = v[:, self.focus[rows]].astype(np.float64).T / np.maximum(norm, 1e-300)[None, :]
                a, b = np.nonzero((value >= low[some, None] - 1e-9) & (value <= high[some, None] + 1e-9))
                score = (q[rows[a]] * v[b]).sum(1)
                keep = (score >= self._least(rows)[a]).astype(bool)
                found.append((rows[a][keep], b[keep], _whole(score[keep])))
        if not found:
            return
        who, which, score = (np.concatenate(x) for x in zip(*found, strict=True))
        other = self.ids[who] != ids[which]
        self._merge(who[other], ids[which[other]], score[other])

    def _least(self, rows: np.ndarray) -> np.ndarray:
        """The floor of queries, a little lower where a double does not hold it exactly."""
        floor = self.floor[rows]
        return np.where(np.abs(floor) < _EXACT, floor, floor - np.abs(floor) * 1e-9)

    def _merge(self, who: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(who):
            return
        who, ids, score = np.concatenate([self.best_q, who]), np.concatenate([self.best_id, ids]), np.concatenate([self.best_score, score])
        order = np.lexsort((ids, -score, who))
        who, ids, score = who[order], ids[order], score[order]
        first = np.searchsorted(who, who, side="left")
        rank = np.arange(len(who)) - first
        keep = rank < self.k
        self.best_q, self.best_id, self.best_score = who[keep], ids[keep], score[keep]
        full = rank == self.k - 1
        self.floor[who[full]] = score[full]


def _search(ids: np.ndarray, vectors: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = NormBuckets(ids, vectors, k)
        for batch in batches:
            if batch.num_rows:
                state.add(batch.column("id").to_numpy(zero_copy_only=False), _matrix(batch.column("v")))
        yield pa.RecordBatch.from_arrays([pa.array(ids[state.best_q]), pa.array(state.best_id), pa.array(state.best_score)], names=["query_id", "vec_id", "score"])

    return trimmed(run)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, block: int = BLOCK) -> DataFrame:
    """The k candidates of highest score for each query row, ties to the smaller id."""
    ship(vectors.sparkSession)
    rows, asked = quantised(vectors, id_col, vec_col, scale), quantised(queries, id_col, vec_col, scale).distinct()
    blocks = max(1, math.ceil(asked.count() / block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    parts, done = [], []
    for b in range(blocks):
        if len(parts) == ROUND:
            done.append(stored(_union(parts), "top-k"))
            parts = []
        got = asked.where(F.col("block") == b).select("id", "v").orderBy("id").toArrow().combine_chunks()
        ids = got.column("id").to_numpy()
        column = got.column("v").combine_chunks()
        matrix = _matrix(column) if len(ids) else np.zeros((0, 0), np.int64)
        parts.append(rows.mapInArrow(_search(ids, matrix, k), "query_id long, vec_id long, score long"))
    merged = _union(done + parts)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _union(parts: list[DataFrame]) -> DataFrame:
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
