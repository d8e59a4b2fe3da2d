"""Removal of repeated byte strings by longest-previous-factor arrays (Crochemore and Ilie, 2008).

A byte goes if a string of `width` bytes that covers it also starts earlier: in a document with a
smaller id, or before in the same one. Places where that can happen are found by anchors and dealt
to shards (`repeats`); in a shard the contexts lie in document order, their windows are put in
suffix order to the depth of a window, and the previous and next smaller positions of each in that
order give the longest earlier match. The first occurrence always stays.

Defined cases: null text counts as empty; a null id is last in order (of texts without an id, and of
several texts of one id, the order is that of a hash of the text); rows that repeat id and text are
one document and get the same result; texts may be as long as a row can be; a text under `width`
bytes stays whole; other columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .repeats import Spec, keyed, repeated_spans, rewritten, sha256, unpack

WIDTH = 100
GRAM = 24


def _ranks(buffer: np.ndarray, depth: int) -> dict[int, np.ndarray]:
    """Ranks of all suffixes by their first 8, 16, 32 ... bytes, up to `depth` (prefix doubling)."""
    n = len(buffer)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = buffer
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : n + j]
    levels, h = {8: np.unique(key, return_inverse=True)[1].astype(np.int64)}, 8
    while 2 * h <= depth:
        rank = levels[h]
        ahead = np.zeros(n, np.int64)
        ahead[: max(n - h, 0)] = rank[h:] + 1
        levels[2 * h] = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        h *= 2
    return levels


def previous_factors(buffer: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """For each start (ascending) the longest match with an earlier start, up to `depth` bytes.

    Values under `depth` are lower bounds: the search along the suffix order ends once no match of
    `depth` bytes is left. Every start has `depth` bytes after it.
    """
    if depth < 8:
        raise ValueError("depth is 8 bytes at least")
    levels = _ranks(buffer, depth)
    top = max(levels)
    n = len(buffer)
    order = np.argsort(levels[top][starts] * (n + 1) + levels[top][starts + depth - top], kind="stable")
    at = starts[order]
    i, j = at[:-1], at[1:]
    common = np.zeros(len(i), np.int64)
    for h in sorted(levels, reverse=True):
        fits = common + h <= depth
        a, b = np.minimum(i + common, n - 1), np.minimum(j + common, n - 1)
        common += h * (fits & (levels[h][a] == levels[h][b]))
    live = common < depth
    for _ in range(7):
        a, b = np.minimum(i + common, n - 1), np.minimum(j + common, n - 1)
        live &= (common < depth) & (buffer[a] == buffer[b])
        common += live
    best = np.zeros(len(at), np.int64)
    for values, links in ((at, common), (at[::-1], common[::-1])):
        found = _nearest_smaller(values, links, depth)
        best = np.maximum(best, found if values is at else found[::-1])
    out = np.empty(len(at), np.int64)
    out[order] = best
    return out


def _nearest_smaller(at: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix with the nearest smaller position on the left, by pointer jumping.

    All positions between a row and its pointer are larger than the row's own; a pointer to a larger
    one may therefore be followed once more.
    """
    n = len(at)
    pointer = np.arange(n) - 1
    low = np.concatenate([[0], common])
    while True:
        rows = np.flatnonzero((pointer >= 0) & (low >= depth))
        rows = rows[at[pointer[rows]] > at[rows]]
        if not len(rows):
            break
        via = pointer[rows]
        low[rows], pointer[rows] = np.minimum(low[rows], low[via]), pointer[via]
    return np.where(pointer >= 0, low, 0)


def lpf_engine(contexts: pa.Array, d: np.ndarray, at: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """Rows and window numbers that start earlier; rows are sorted by anchor, document (id and hash) and place."""
    parts = contexts.to_pylist()
    buffer = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts], np.int64)
    first = np.cumsum(size) - size
    _, more = unpack(at)
    row = np.repeat(np.arange(len(parts)), more + 1)
    window = np.arange(len(row)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
    again = previous_factors(buffer, first[row] + window, spec.width) >= spec.width
    return row[again], window[again]


def _finish(text: str, spans) -> tuple:
    data = text.encode()
    if spans is None:
        return len(data), 0, 0, sha256(data)
    start, end = spans
    edges = [0, *np.stack([start, end], 1).reshape(-1).tolist(), len(data)]
    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    return len(data), len(data) - len(kept), len(start), sha256(kept)


_finish.names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    base = keyed(docs, id_col, text_col)
    spans = repeated_spans(base, Spec("byte", width, gram, True), lpf_engine)
    return rewritten(base, spans, _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, md5(array_slice(b, i, i + 99)) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS i FROM d)),
f AS (SELECT h, min({'d': doc_id, 'i': i}) AS m FROM w GROUP BY h),
r AS (SELECT w.doc_id, w.i FROM w JOIN f USING (h) WHERE w.doc_id <> f.m.d OR w.i <> f.m.i),
n AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM n),
s AS (SELECT doc_id, min(i) AS a, max(i) + 99 AS z FROM g GROUP BY doc_id, k),
l AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(z - a + 1) AS BIGINT) AS n_removed, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS ends FROM s GROUP BY doc_id)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN n_spans IS NULL THEN b ELSE list_reduce(list_transform(range(1, n_spans + 2),
    lambda k: array_slice(b, coalesce(ends[k - 1], 0) + 1, coalesce(starts[k], octet_length(b) + 1) - 1)), lambda x, y: x || y) END) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)
"""
