"""Repeated windows of a corpus: which windows of W units also start earlier.

Shared by the byte operator (suffix order) and the word operator (suffix automata). A unit is a
byte or a word. The steps, none of which compares a document with the whole corpus:

1. Anchors (winnowing, Schleimer et al., SIGMOD 2003): every window names its k-gram of least
   hash, the leftmost of ties. Equal windows name equal anchors, so they meet under the anchor's
   hash. A run of windows with one anchor is one row with the hash of the run's context (all units
   the run's windows cover): about 2 / (W - k + 2) rows a unit.
2. Rows sorted by (anchor, context, document, place) are streamed in constant memory. A row whose
   whole context came before is decided: its windows all repeat. A map task decides what repeats
   within its batch, so a context of a third of all rows reaches its anchor once a batch. An anchor with one context is
   decided too: nothing repeats. What is left, one row for each distinct context, is open.
3. The contexts of open rows are cut out of the texts and sent to their anchor's shard, where an
   exact engine (suffix order, or suffix automaton) finds the windows that start earlier.
4. An anchor with more than HOT open contexts is not one shard: its contexts are cut again by the
   anchors of longer grams, halfway to a window and then of three quarters. Equal windows still meet,
   and each part has a shard of its own. Only what even then is more than HOT contexts of one gram is
   decided window by window, each window being its own key of 128 bits.

Documents are ordered by id, null last, and then by a 64-bit hash of the text, which is a key column
of its own: texts that share an id, or have none, stay apart. Rows that repeat id and text are one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import stored
from .grouping import by_key, whole_groups
from .texthash import _WORDS, Words, byte_values, chunks, mix64, signed, text_buffer, trimmed, window_hash

#: Open contexts of one anchor that one shard takes at most, and contexts of a shard: an automaton
#: holds far more for each of its units than a suffix order does.
HOT = {"byte": 20_000, "word": 2_000}
SHARD = {"byte": 4_096, "word": 1_024}
#: Marks a place whose windows are known to repeat.
DECIDED = np.int64(-(1 << 63))
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Spec:
    unit: str  # "byte" or "word"
    width: int  # units of a window
    gram: int  # units of an anchor
    own: bool  # whether an earlier start in the same document counts


def units(batch_text: pa.Array, unit: str) -> tuple[np.ndarray, np.ndarray]:
    buffer, offsets = text_buffer(batch_text)
    if unit == "byte":
        return byte_values(buffer), offsets
    words = Words(buffer, offsets)
    return words.hash, words.first


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` values in a row (van Herk and Gil-Werman)."""
    n = len(x) - width + 1
    if width == 1:
        return x
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def least_places(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of every `width` values in a row, the leftmost of equal ones.

    It depends on these values alone, not on what else is in the array. Low bits give way to the place
    at first; windows where that changes the order are looked at again.
    """
    mask = np.uint64((1 << max(1, int(len(x)).bit_length())) - 1)
    place = (sliding_min((x & ~mask) | np.arange(len(x), dtype=np.uint64), width) & mask).astype(np.int64)
    wrong = np.flatnonzero(x[place] != sliding_min(x, width))
    if len(wrong):
        place[wrong] = wrong + np.lib.stride_tricks.sliding_window_view(x, width)[wrong].argmin(1)
    return place


def anchor_runs(values: np.ndarray, first: np.ndarray, spec: Spec) -> tuple[np.ndarray, ...]:
    """Document, first window, windows - 1, anchor hash and context hash of each run."""
    n = len(values)
    none = np.zeros(0, np.int64)
    if n < spec.width:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    gram = window_hash(values, spec.gram)
    span = spec.width - spec.gram + 1
    least = least_places(gram, span)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.flatnonzero(np.arange(len(least)) + spec.width <= first[owner[: len(least)] + 1])
    if not len(start):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    place = least[start]
    head = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    a, b = start[head], start[np.concatenate([head[1:], [len(start)]]) - 1]
    up, down = _WORDS.get(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    context = mix64((total[b + spec.width] - total[a]) * down[a] ^ (b - a + 1).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    doc = owner[a]
    return doc, a - first[doc], b - a, gram[place[head]], context


def _anchors(spec: Spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            values, first = units(batch.column("text"), spec.unit)
            doc, at, more, anchor, context = anchor_runs(values, first, spec)
            d, h = (batch.column(c).to_numpy()[doc] for c in ("d", "h"))
            f, c, place = signed(anchor), signed(context), pack(at, more)
            order = np.lexsort((place, h, d, c, f))
            f, c, d, h, place = f[order], c[order], d[order], h[order], place[order]
            again = _came_before(f, c, d, h, place, spec.own)
            # What this batch decides need not meet its anchor: it is dealt by its place instead.
            f = np.where(again, signed(mix64((place ^ d ^ h).view(np.uint64))), f)
            place = np.where(again, place | DECIDED, place)
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(c), pa.array(d), pa.array(h), pa.array(place)], names=["f", "c", "d", "h", "at"])

    return trimmed(run)


def _came_before(f: np.ndarray, c: np.ndarray, d: np.ndarray, h: np.ndarray, at: np.ndarray, own: bool) -> np.ndarray:
    """Of rows sorted by (f, c, d, h, at), those whose (f, c) an earlier place (or document) has."""
    n = len(f)
    new = np.ones(n, bool)
    new[1:] = (f[1:] != f[:-1]) | (c[1:] != c[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return (d != d[first]) | (h != h[first]) | (at != at[first]) if own else d != d[first]


def pack(at: np.ndarray, more: np.ndarray) -> np.ndarray:
    """First window (40 bits) and windows - 1 (8) in one number."""
    return (at << 8) | more


def unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (at >> 8) & ((1 << 40) - 1), at & 255


class Streamed:
    """Decides rows that come sorted by (group, key, document's id and hash, place), batch by batch.

    A row is `later` if its key came before from another place (or, unless `own`, another
    document). Rows that are not later are `open` if their group has a second key.
    """

    def __init__(self, own: bool):
        self.own = own
        self.last: tuple[int, int, int, int, int] | None = None  # group, key, and document (id, hash) and place of the key's first row
        self.several = False
        self.pending: list[np.ndarray] = []

    def add(self, f: np.ndarray, c: np.ndarray, d: np.ndarray, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (f, d, h, at) that are later, and that are open."""
        n = len(f)
        new_f, new_c = np.ones(n, bool), np.ones(n, bool)
        new_f[1:] = f[1:] != f[:-1]
        new_c[1:] = new_f[1:] | (c[1:] != c[:-1])
        lf, lc, ld, lh, la = self.last or (0, 0, 0, 0, 0)
        if self.last is not None:
            new_f[0] = f[0] != lf
            new_c[0] = new_f[0] or c[0] != lc
        first = np.maximum.accumulate(np.where(new_c, np.arange(n), -1))
        held = first < 0
        fd, fh, fa = np.where(held, ld, d[first]), np.where(held, lh, h[first]), np.where(held, la, at[first])
        later = (d != fd) | (h != fh) | (at != fa) if self.own else d != fd
        group = np.cumsum(new_f)
        several = np.zeros(group[-1] + 1, bool)
        several[group[new_c & ~new_f]] = True
        rows = np.stack([f, d, h, at], 1)
        opened = [rows[~later & several[group]]]
        if self.several and group[0] == 0:
            several[0] = True
            opened = [rows[~later & several[group]]]
        if self.pending:
            if several[0]:
                opened += self.pending
            if several[0] or group[-1] > 0:
                self.pending = []
        end = group[-1]
        self.several = bool(several[end])
        if not self.several:
            self.pending.append(rows[~later & (group == end)])
        k = first[-1]
        self.last = (int(f[-1]), int(c[-1]), int(fd[-1]), int(fh[-1]), int(fa[-1])) if k < 0 else (int(f[k]), int(c[k]), int(d[k]), int(h[k]), int(at[k]))
        return rows[later], np.concatenate(opened)


def _label(spec: Spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Streamed(spec.own)
        for batch in batches:
            if not batch.num_rows:
                continue
            f, c, d, h, at = (batch.column(x).to_numpy() for x in ("f", "c", "d", "h", "at"))
            known = at < 0
            later = np.stack([f, d, h, at & ~DECIDED], 1)[known]
            opened = np.zeros((0, 4), np.int64)
            if not known.all():
                more, opened = state.add(*(x[~known] for x in (f, c, d, h, at)))
                later = np.concatenate([later, more])
            for rows, flag in ((later, False), (opened, True)):
                if len(rows):
                    yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, i]) for i in range(4)), pa.array(np.full(len(rows), flag))], names=["f", "d", "h", "at", "open"])

    return trimmed(run)


def _cut(spec: Spec):
    """The contexts of each document's open rows, as bytes of its units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            buffer, offsets = text_buffer(batch.column("text"))
            if spec.unit == "byte":
                data, first, size = buffer, offsets, 1
            else:
                words = Words(buffer, offsets)
                data, first, size = words.hash, words.first, 8
            raw = memoryview(np.ascontiguousarray(data)).cast("B")
            rows = batch.column("rows")
            per = np.diff(rows.offsets.to_numpy())
            doc = np.repeat(np.arange(batch.num_rows), per)
            flat = rows.flatten()
            f, at = flat.field("f").to_numpy(), flat.field("at").to_numpy()
            hot = flat.field("hot").to_numpy(zero_copy_only=False)
            start, more = unpack(at)
            low = ((first[doc] + start) * size).tolist()
            high = ((first[doc] + start + more + spec.width) * size).tolist()
            context = pa.array([raw[a:b].tobytes() for a, b in zip(low, high, strict=True)], pa.binary())
            d, h = (pa.array(batch.column(c).to_numpy()[doc]) for c in ("d", "h"))
            yield pa.RecordBatch.from_arrays([pa.array(f), d, h, pa.array(at), pa.array(hot), context], names=["f", "d", "h", "at", "hot", "context"])

    return trimmed(run)


def span_rows(d: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(d), pa.array(h), pa.array((start << 24) | (end - start))], names=["d", "h", "span"])


def _decided(spec: Spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, more = unpack(batch.column("at").to_numpy())
            yield span_rows(batch.column("d").to_numpy(), batch.column("h").to_numpy(), start, start + more + spec.width)

    return trimmed(run)


def _shards(spec: Spec, engine: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["f"], SHARD[spec.unit]):
            d, h, at = (table.column(x).to_numpy() for x in ("d", "h", "at"))
            start, _ = unpack(at)
            row, window = engine(table.column("context").combine_chunks(), d, at, spec)
            yield span_rows(d[row], h[row], start[row] + window, start[row] + window + spec.width)

    return trimmed(run)


def _recut(spec: Spec):
    """Contexts cut anew by the anchors of the spec's grams; keys depend on the old and the new anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column("context").to_pylist()
            raw = b"".join(parts)
            size = 1 if spec.unit == "byte" else 8
            values = byte_values(np.frombuffer(raw, np.uint8)) if size == 1 else np.frombuffer(raw, np.uint64)
            first = np.concatenate([[0], np.cumsum([len(p) // size for p in parts])])
            row, at, more, anchor, context = anchor_runs(values, first, spec)
            f, d, h, old = (batch.column(x).to_numpy()[row] for x in ("f", "d", "h", "at"))
            start, _ = unpack(old)
            low = ((first[row] + at) * size).tolist()
            high = ((first[row] + at + more + spec.width) * size).tolist()
            pieces = pa.array([raw[a:b] for a, b in zip(low, high, strict=True)], pa.binary())
            key = signed(mix64(mix64(f.view(np.uint64)) ^ anchor))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(signed(context)), pa.array(d), pa.array(h), pa.array(pack(start + at, more)), pieces], names=["f", "c", "d", "h", "at", "context"])

    return trimmed(run)


def _windows(spec: Spec):
    """Every window of a hot anchor's contexts as a key of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, h, at = (batch.column(x).to_numpy() for x in ("d", "h", "at"))
            start, more = unpack(at)
            for k, context in enumerate(batch.column("context").to_pylist()):
                values = byte_values(np.frombuffer(context, np.uint8)) if spec.unit == "byte" else np.frombuffer(context, np.uint64)
                one = window_hash(values, spec.width)
                two = window_hash(mix64(values + np.uint64(0x51)), spec.width, base="byte")
                place = start[k] + np.arange(more[k] + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(one)), pa.array(signed(two)), pa.array(np.full(len(one), d[k])), pa.array(np.full(len(one), h[k])), pa.array(pack(place, np.zeros(len(one), np.int64)))], names=["f", "c", "d", "h", "at"]
                )

    return trimmed(run)


def _window_spans(spec: Spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Streamed(spec.own)
        for batch in batches:
            if batch.num_rows:
                later, _ = state.add(*(batch.column(x).to_numpy() for x in ("f", "c", "d", "h", "at")))
                start, _ = unpack(later[:, 3])
                yield span_rows(later[:, 1], later[:, 2], start, start + spec.width)

    return trimmed(run)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, d, h, text): d is the id, null last, and h the text's hash, which tells apart the texts of one id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = F.col(id_col).cast("long")
    return docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(LAST)).alias("d"), F.xxhash64(text).alias("h"), text.alias("text"))


def repeated_spans(base: DataFrame, spec: Spec, engine: Callable) -> DataFrame:
    """(d, h, span) of all windows that start earlier; span is start << 24 | length."""
    ship(base.sparkSession)
    base = base.select("d", "h", "text")
    anchors = base.mapInArrow(_anchors(spec), "f long, c long, d long, h long, at long")
    labelled = stored(by_key(anchors, "f", then=("c", "d", "h", "at")).mapInArrow(_label(spec), "f long, d long, h long, at long, open boolean"), "anchors")
    spans = "d long, h long, span long"
    decided = labelled.where("not open").select("d", "h", "at").mapInArrow(_decided(spec), spans)
    opened = labelled.where("open").select("f", "d", "h", "at").distinct()
    many = opened.groupBy("f").count().where(F.col("count") > HOT[spec.unit]).select("f", F.lit(True).alias("hot"))
    opened = opened.join(many, "f", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    per_doc = opened.groupBy("d", "h").agg(F.collect_list(F.struct("f", "at", "hot")).alias("rows"))
    contexts = stored(base.join(per_doc, ["d", "h"]).dropDuplicates(["d", "h"]).mapInArrow(_cut(spec), "f long, d long, h long, at long, hot boolean, context binary"), "contexts")
    out = decided.unionByName(by_key(contexts.where("not hot").drop("hot"), "f", then=("d", "h", "at")).mapInArrow(_shards(spec, engine), spans))
    rest = contexts.where("hot").drop("hot")
    for share in (2, 4):
        if not rest.limit(1).count():
            return out
        finer = Spec(spec.unit, spec.width, spec.width - (spec.width - spec.gram) // share, spec.own)
        parts = stored(rest.mapInArrow(_recut(finer), "f long, c long, d long, h long, at long, context binary"), "contexts")
        # Of equal contexts only the first is open; where it is in the same document (or place), none came before.
        firsts = parts.groupBy("f", "c").agg(F.min(F.struct("d", "h", "at")).alias("first"))
        parts = parts.join(firsts, ["f", "c"])
        own = F.struct("d", "h", "at") != F.col("first") if spec.own else F.col("d") != F.col("first.d")
        out = out.unionByName(parts.where(own).select("d", "h", "at").mapInArrow(_decided(spec), spans))
        opened = parts.where(~own).select("f", "d", "h", "at", "context")
        many = opened.groupBy("f").count().where(F.col("count") > HOT[spec.unit]).select("f")
        out = out.unionByName(by_key(opened.join(many, "f", "left_anti"), "f", then=("d", "h", "at")).mapInArrow(_shards(spec, engine), spans))
        rest = stored(opened.join(many, "f", "left_semi"), "contexts")
    windows = rest.select("d", "h", "at", "context").mapInArrow(_windows(spec), "f long, c long, d long, h long, at long")
    return out.unionByName(by_key(windows, "f", "c", then=("d", "h", "at")).mapInArrow(_window_spans(spec), spans))


def merged(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans packed as start << 24 | length; spans that touch join."""
    spans = np.sort(spans)
    start = spans >> 24
    end = np.maximum.accumulate(start + (spans & 0xFFFFFF))
    head = np.concatenate([[True], start[1:] > end[:-1]])
    last = np.concatenate([np.flatnonzero(head)[1:] - 1, [len(spans) - 1]])
    return start[head], end[last]


def _rewrite(finish: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            spans = batch.column("spans")
            rows = [finish(text or "", merged(np.array(s, np.int64)) if s else None) for text, s in zip(batch.column("text").to_pylist(), spans.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in zip(*rows, strict=True))], names=["doc_id", *finish.names])

    return trimmed(run)


def rewritten(base: DataFrame, spans: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """One row per document from its text and its repeated spans."""
    per_doc = spans.groupBy("d", "h").agg(F.collect_list("span").alias("spans"))
    return base.join(per_doc, ["d", "h"], "left").select("doc_id", "text", "spans").mapInArrow(_rewrite(finish), schema)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
