"""Removal of repeated word windows by suffix automata of reference shards.

A word goes if a window of `width` words that covers it also starts in a document with a smaller
id. Places where that can happen are found by anchors and dealt to shards (`repeats`). A shard's
suffix automaton grows document by document: a document's contexts are first streamed through it,
which gives matching statistics (the longest match that ends at each word), and added afterwards,
so matches are with smaller ids only. Spans of at least `width` matched words are removed.

The automata are not broadcast: those of a whole corpus have no size bound, and every document
against every shard is quadratic. Anchors send each context to the one shard that can match it.

Defined cases: null text has no words; a null id is larger than any id; rows that repeat id and
text, and ids that come with several texts, do not remove each other; texts may be as long as a row
can be; a text under `width` words stays whole; other columns, whatever their names, are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .repeats import Spec, keyed, repeated_spans, rewritten, sha256

WIDTH = 50
GRAM = 8
_SPACE = dict.fromkeys(map(ord, " \t\n\v\f\r"), " ")


class SuffixAutomaton:
    """Suffix automaton of several strings over any hashable symbols."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, symbols: list) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in symbols:
            if c in nxt[last]:
                q = nxt[last][c]
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._clone(last, q, c)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[p] + 1 == length[q] else self._clone(p, q, c)
            last = cur

    def _clone(self, p: int, q: int, c) -> int:
        nxt, link, length = self.next, self.link, self.length
        twin = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = twin
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = twin
            p = link[p]
        return twin

    def statistics(self, symbols: list) -> list[int]:
        """Length of the longest match that ends at each symbol."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for c in symbols:
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            to = nxt[state].get(c)
            if to is not None:
                state, size = to, size + 1
            else:
                size = 0
            out.append(size)
        return out


def automaton_engine(contexts: pa.Array, d: np.ndarray, at: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """Rows and window numbers that start in a document with a smaller id."""
    parts = contexts.to_pylist()
    order = np.lexsort((at, d)).tolist()
    shard = SuffixAutomaton()
    rows, windows, waiting, now = [], [], [], None
    for r in order:
        if d[r] != now:
            for symbols in waiting:
                shard.add(symbols)
            waiting, now = [], d[r]
        symbols = np.frombuffer(parts[r], np.uint64).tolist()
        hit = [i - spec.width + 1 for i, m in enumerate(shard.statistics(symbols)) if m >= spec.width]
        rows += [r] * len(hit)
        windows += hit
        waiting.append(symbols)
    return np.array(rows, np.int64), np.array(windows, np.int64)


def _finish(text: str, spans) -> tuple:
    words = [w for w in text.translate(_SPACE).split(" ") if w]
    if spans is None:
        return len(words), 0, sha256(" ".join(words).encode())
    start, end = spans
    edges = [0, *np.stack([start, end], 1).reshape(-1).tolist(), len(words)]
    kept = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
    return len(words), len(words) - len(kept), sha256(" ".join(kept).encode())


_finish.names = ("n_words", "n_removed", "kept_sha256")


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    base = keyed(docs, id_col, text_col)
    spans = repeated_spans(base, Spec("word", width, gram, False), automaton_engine)
    return rewritten(base, spans, _finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
f AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
r AS (SELECT doc_id, i FROM win JOIN f USING (h) WHERE m < doc_id),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
c AS (
  SELECT p.doc_id, word, p.i, coalesce(max(CASE WHEN r.i IS NULL THEN 0 ELSE 1 END)
           OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.i = p.i),
k AS (
  SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept
  FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)
"""
