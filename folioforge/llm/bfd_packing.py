"""Packing token sequences by best-fit decreasing.

Documents are tokenised (ids, then an end id), cut into full windows where they are longer
than a window, and the remainders packed best-fit decreasing over the whole corpus. Best fit
only sees sizes, and there are at most `window` of them, so the global plan is computed on the
histogram of sizes: runs of equal pieces go to runs of equally filled windows, found by a
segment tree over the remaining capacity. Plan and histogram are bounded by the window, not by
the data. Every piece then finds its place from its rank among the pieces of its size, which
is a per-task count plus the counts of the tasks before; no group is collected. The table of those
counts grows with the tasks, so it is joined by a sort-merge join on (size, task), never broadcast.

A word's ids do not depend on its neighbours, since the tokenizer drops white space: each
task tokenises each distinct piece of a word once and gathers the ids of whole texts from that.

Defined cases: null or empty text is the end id alone; repeated rows are packed each; a null
doc_id stays null; a very long text is cut into as many windows as it fills; other columns, whatever
their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import stored, table
from .texthash import Words, chunks, lower_ascii, span_hash, text_buffer, trimmed

WINDOW = 2048
END_ID = 1
#: Distinct pieces whose ids a task holds at most before it starts anew.
CACHE_PIECES = 600_000

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, nth long"


#: Byte classes of the fast path: separators, letters, digits, other ASCII, and bytes that need the whole tokenizer.
_SPACE, _LETTER, _DIGIT, _OTHER, _SLOW = range(5)
_KIND = np.full(256, _SLOW, np.uint8)
_KIND[33:127] = _OTHER
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _SPACE
_KIND[[0x27, 0x3C]] = _SLOW  # an apostrophe may start a contraction, "<" a special token


def _kinds(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte and the bytes in lower case; letters of the Latin-1 supplement take two bytes."""
    kind, low = _KIND[buffer], lower_ascii(buffer)
    lead = np.flatnonzero(buffer == 0xC3)
    after = buffer[lead + 1]  # a valid text never ends on a lead byte
    sign = (after == 0x97) | (after == 0xB7)
    letter, capital = lead[~sign] + 1, lead[(after <= 0x9E) & ~sign] + 1
    kind[letter] = kind[letter - 1] = _LETTER
    low[capital] += 0x20
    return kind, low


class WordTokens:
    """Token ids of texts from the ids of their distinct pieces.

    The tokenizer drops white space and cuts words into runs of letters, single digits and runs of
    other signs. Words of plain ASCII and Latin-1 letters are cut and lower-cased here, and only the
    merges of each distinct piece are left to the tokenizer's model; any other word goes through the
    whole tokenizer.
    """

    def __init__(self, tokenizer_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(tokenizer_file)
        self.plain = Tokenizer(self.whole.model)
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), byte_level])
        size = self.whole.get_vocab_size()
        self.closes = np.array([(self.whole.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self._reset()

    def _reset(self) -> None:
        self.key = np.zeros(0, np.uint64)
        self.start = self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _cut(self, buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start, end and hash of all pieces, whether each is plain, and the bytes in lower case."""
        words = Words(buffer, offsets, hashes=False)
        kind, low = _kinds(buffer)
        depth = np.zeros(len(buffer) + 1, np.int64)
        np.cumsum(kind == _SLOW, out=depth[1:])
        plain = depth[words.end] == depth[words.start]
        at = kind[1:] != kind[:-1]
        at |= kind[1:] == _DIGIT
        begins = np.zeros(len(buffer), bool)
        begins[1:] = at & (kind[1:] != _SPACE)
        for a, b in zip(words.start[~plain].tolist(), words.end[~plain].tolist(), strict=True):
            begins[a:b] = False
            low[a:b] = buffer[a:b]
        begins[words.start] = True
        start = np.flatnonzero(begins)
        home = np.searchsorted(words.start, start, side="right") - 1
        end = np.minimum(np.append(start[1:], len(buffer)), words.end[home])
        ok = plain[home]
        return start, end, span_hash(low, start, end) ^ ok.astype(np.uint64), ok, low

    def _learn(self, low: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray, plain: np.ndarray) -> None:
        raw = low.tobytes()
        new_ids, new_size, new_key = [], [], []
        rows = np.flatnonzero(plain)
        if len(rows):
            size = end[rows] - start[rows]
            step = np.repeat(np.cumsum(size) - size, size)
            within = np.arange(int(size.sum())) - step
            joined = np.full(int(size.sum()) + len(rows), 0x20, np.uint8)
            place = np.repeat(np.cumsum(size + 1) - (size + 1), size) + within
            joined[place] = low[np.repeat(start[rows], size) + within]
            ids = np.array(self.plain.encode_batch_fast([joined.tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.closes[ids])
            new_ids.append(ids)
            new_size.append(np.diff(np.concatenate([[-1], last])))
            new_key.append(key[rows])
        rest = np.flatnonzero(~plain)
        if len(rest):
            texts = [raw[a:b].decode() for a, b in zip(start[rest].tolist(), end[rest].tolist(), strict=True)]
            found = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            new_ids += found
            new_size.append(np.array([len(x) for x in found], np.int64))
            new_key.append(key[rest])
        size = np.concatenate(new_size)
        first = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, *new_ids])
        keys = np.concatenate([self.key, *new_key])
        order = np.argsort(keys, kind="stable")
        self.key, self.start, self.size = keys[order], np.concatenate([self.start, first])[order], np.concatenate([self.size, size])[order]

    def encode(self, buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by END_ID, and their offsets."""
        if not len(buffer):
            return np.full(len(offsets) - 1, END_ID, np.uint32), np.arange(len(offsets))
        start, end, hashed, plain, low = self._cut(buffer, offsets)
        key, first, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        if len(self.key) > CACHE_PIECES:
            self._reset()
        at = np.searchsorted(self.key, key)
        known = at < len(self.key)
        known[known] = self.key[at[known]] == key[known]
        if not known.all():
            fresh = first[~known]
            self._learn(low, key[~known], start[fresh], end[fresh], plain[fresh])
        where = np.searchsorted(self.key, key)[inverse]
        from_, size = self.start[where], self.size[where]
        ends = np.concatenate([[0], np.cumsum(size)])
        of_doc = np.searchsorted(start, offsets)
        per_doc = ends[of_doc[1:]] - ends[of_doc[:-1]] + 1
        bounds = np.concatenate([[0], np.cumsum(per_doc)])
        out = np.full(bounds[-1], END_ID, np.uint32)
        body = np.ones(bounds[-1], bool)
        body[bounds[1:] - 1] = False
        out[body] = self.ids[np.repeat(from_ - ends[:-1], size) + np.arange(ends[-1])]
        return out, bounds


def _pieces(tokenizer_file: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(tokenizer_file)
        task = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for batch in chunks(batches, limit=1 << 20):
            buffer, offsets = text_buffer(batch.column("text"))
            ids, bounds = tokens.encode(buffer, offsets)
            n = np.diff(bounds)
            parts = -(-n // window)
            doc = np.repeat(np.arange(len(n)), parts)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
            length = np.minimum(window, n[doc] - start)
            raw = memoryview(ids).cast("B")
            low = (4 * (bounds[doc] + start)).tolist()
            crc = np.fromiter((zlib.crc32(raw[a : a + 4 * m]) for a, m in zip(low, length.tolist(), strict=True)), np.int64, len(doc))
            order = np.argsort(length, kind="stable")
            by_size = length[order]
            nth = np.empty(len(doc), np.int64)
            nth[order] = np.arange(len(doc)) - np.searchsorted(by_size, by_size) + seen[by_size]
            seen += np.bincount(length, minlength=window + 1)
            who = batch.column("doc_id").take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([who, *map(pa.array, (start, length, crc, n[doc])), pa.array(np.full(len(doc), task, np.int32)), pa.array(nth)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth"])

    return trimmed(run)


class OpenWindows:
    """Segment tree over remaining capacities: the least capacity >= a size that has an open window."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = np.zeros(2 * self.leaves, np.int64)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def push(self, capacity: int, first: int, n: int) -> None:
        if capacity and n:
            self.runs[capacity].append((first, n))
            self._add(capacity, n)

    def _add(self, capacity: int, n: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += n
            node //= 2

    def tightest(self, size: int) -> int:
        node = size + self.leaves
        if self.count[node]:
            return size
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return 0

    def pop(self, capacity: int, n: int) -> tuple[int, int]:
        first, have = self.runs[capacity].pop()
        take = min(n, have)
        if take < have:
            self.runs[capacity].append((first + take, have - take))
        self._add(capacity, -take)
        return first, take


def best_fit_decreasing(counts: np.ndarray, window: int) -> np.ndarray:
    """Rows (size, rank from, rank to, first window, offset) that place counts[s] pieces of each size s."""
    windows, opened, plan = OpenWindows(window), 0, []
    for size in range(window, 0, -1):
        rank, left = 0, int(counts[size])
        while left:
            capacity = windows.tightest(size)
            if capacity:
                first, n = windows.pop(capacity, left)
                plan.append((size, rank, rank + n, first, window - capacity))
                windows.push(capacity - size, first, n)
                rank, left = rank + n, left - n
                continue
            each = window // size  # a new window takes this many: it stays the tightest until it is full
            full, rest = divmod(left, each)
            for start, n, depth in ((opened, full, each), (opened + full, int(rest > 0), rest)):
                for j in range(depth if n else 0):
                    plan.append((size, rank, rank + n, start, j * size))
                    rank += n
                windows.push(window - depth * size, start, n)
                opened += n
            left = 0
    return np.array(sorted(plan), np.int64).reshape(-1, 5)


def _place(plan: np.ndarray, window: int):
    sizes = plan[:, 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                rows = np.flatnonzero(length == size)
                a, b = np.searchsorted(sizes, size), np.searchsorted(sizes, size, side="right")
                at = a + np.searchsorted(plan[a:b, 1], rank[rows], side="right") - 1
                sequence[rows], offset[rows] = plan[at, 3] + rank[rows] - plan[at, 1], plan[at, 4]
            columns = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return trimmed(run)


def pack(docs: DataFrame, tokenizer_file: str, window: int = WINDOW) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stored(rows.mapInArrow(_pieces(tokenizer_file, window), _PIECES), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("length").orderBy("task")
    by_task = stored(by_task.withColumn("before", F.sum("n").over(upto) - F.col("n")), "piece-counts")
    counts = np.zeros(window + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `window` rows
        counts[row.length] = row.n
    plan = best_fit_decreasing(counts, window)
    ranked = pieces.join(by_task.drop("n").hint("merge"), ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(_place(plan, window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
