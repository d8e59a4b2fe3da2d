"""Language-model scores by online logistic context mixing (after Mahoney's PAQ).

A text is a sequence of words (A-Z lower-cased) and an end. The SYMBOLS most frequent training
words that occur LEAST times or more, the end and an escape have a Huffman code; an escaped word is
spelled in bytes, with a code for each previous byte. Every code bit is predicted by three predictors, each a
count of zeros and ones in a context:

* of a word's code: the node alone; node and the last very frequent word, which tells the language;
  node and the previous word, hashed (the word names a place, and the nodes lie from there on);
* of a byte's code: node and the previous two, three and four bytes, hashed.

The predictions meet in the logistic domain. Their weights are gated: the node's depth and how
often the contexts were seen choose the weight set, and each document keeps a correction of its own
that is learned online, block by block, from the bits already coded. A table indexed by the mixed
prediction (adaptive probability map) refines the result.

Counts come from all training documents: tasks send their count tables, which are summed by slot
ranges. The table of hashed word contexts doubles with the training tokens, from 2**LEAST_SLOT_BITS
to 2**MOST_SLOT_BITS slots, so what is broadcast has a bound while what is gathered grows with the
input. The mixing weights and the map are fitted on all training documents as they are counted: a
chunk's bits are predicted from what its task counted before, and every one of them adds to a
table of fixed size (how often a weight set met rounded predictions and an outcome), which is summed.
So weights depend a little on how the input is split. The byte codes are those of all training words.

The base score needs the exact count of every word. The SYMBOLS most frequent ones are broadcast;
other words are sent as (word hash, row) to a join with the table of counts.

Defined cases: null text is the end alone; null ids are scored and never learned from; rows that
repeat are scored and learned from each; a very long text is scored whole; without training
documents every bit is even and the base is as its formula gives; other columns, whatever their
names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import fold, stored, table
from .grouping import by_key
from .texthash import Words, chunks, lower_ascii, mix64, text_buffer, trimmed

SYMBOLS = 1 << 18
#: Rarer words are spelled, so that the escape and the bytes are learned from words like unseen ones.
LEAST = 2
#: Slots (a power of two) of the word contexts, by the training tokens, and of each byte context.
LEAST_SLOT_BITS, MOST_SLOT_BITS = 16, 23
BYTE_SLOT_BITS = 20
PREDICTORS = 3
#: The most frequent words whose last occurrence is a context (0: none yet).
MARKERS = 15
#: Bits of a document between corrections at first; every GROW-th block is longer by as many.
BLOCK = 1024
GROW = 4
DEPTHS = 12
CHUNK = 384 << 10
RANGE = 1 << 16
FAN_IN = 256
#: Steps of a prediction in the table that the weights are fitted on: -8 to 8 by GRADE.
GRADES, GRADE = 11, 1.6
#: Of so many bits one is fitted on: all are.
STRIDE = 1
#: Bits that are fitted on at a time.
FIT_BITS = 1 << 16
SETS = 2 * DEPTHS * 9
#: What a fitted bit met: its depth, level * GRADES + grade in the second and third context, grade in the first, outcome.
SEEN = 3 * GRADES
MET = 2 * DEPTHS * SEEN**2 * GRADES * 2
#: Kinds of counts.
WORD_COUNT, END_COUNT, BYTE_COUNT = 0, 1, 2
#: Levels of a code's tree whose nodes are numbered side by side, so that a path meets few cache lines of a table.
LEVELS = 4
#: Symbols whose paths are laid out at a time.
PATHS = 1 << 14
#: Bytes of context of the predictors of a byte's code.
ORDERS = (2, 3, 4)
_SEPARATORS = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
#: How fast a document's own correction follows its bits.
RATE = 2.0
_LOG10_2 = np.log10(2.0)
STEPS = 64
_GRID = (np.arange(32 * STEPS + 1) + 0.5) / STEPS
#: Bits to code a one, then a zero, at twice a stretched probability from -16 on; and its squashed value from -8 on.
_COST = np.concatenate([np.logaddexp(0, -(_GRID - 16) / 2), np.logaddexp(0, (_GRID - 16) / 2)]) / np.log(2)
_SQUASH = (1 / (1 + np.exp(8 - _GRID[: 16 * STEPS + 1]))).astype(np.float32)


def huffman_lengths(counts: np.ndarray) -> np.ndarray:
    """Code length of each symbol; counts are positive."""
    n = len(counts)
    if n == 1:
        return np.ones(1, np.int64)
    # Two queues: leaves by weight, and inner nodes, which come in order of weight by themselves.
    order = np.argsort(counts, kind="stable")
    leaf, inner = counts[order].tolist(), []
    parent = np.zeros(2 * n - 1, np.int64)
    i = j = 0
    for node in range(n, 2 * n - 1):
        weight = 0
        for _ in range(2):
            if j >= len(inner) or (i < n and leaf[i] <= inner[j]):
                weight += leaf[i]
                parent[order[i]] = node
                i += 1
            else:
                weight += inner[j]
                parent[n + j] = node
                j += 1
        inner.append(weight)
    depth = np.zeros(2 * n - 1, np.int64)
    for node in range(2 * n - 3, -1, -1):
        depth[node] = depth[parent[node]] + 1
    return depth[:n]


def _times(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that occur, and how often; sorts the array in place."""
    at.sort()
    first = np.flatnonzero(np.concatenate([[len(at) > 0], at[1:] != at[:-1]]))
    return at.take(first), np.diff(first, append=len(at))


def _slots(context: np.ndarray, size: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Slots of the nodes of symbols in hashed contexts: a context names a place, and its nodes lie from there on."""
    place = mix64(context) >> np.uint64(64 - bits)
    slot = np.repeat(place.view(np.int64), size)
    slot += node
    slot &= (1 << bits) - 1
    return slot


class Code:
    """Canonical prefix code with its inner nodes numbered from the root, block of LEVELS levels by block."""

    def __init__(self, lengths: np.ndarray):
        self.length = lengths
        deepest = int(lengths.max())
        leaves = np.bincount(lengths, minlength=deepest + 1).tolist()
        low, inside, base = [0], [1], [0]  # of each level: first inner node's code, inner nodes, nodes above
        for d in range(1, deepest + 1):
            low.append(2 * low[-1] + leaves[d])
            base.append(base[-1] + inside[-1])
            inside.append(2 * inside[-1] - leaves[d])
        self.nodes = base[-1] + inside[-1]
        order = np.lexsort((np.arange(len(lengths)), lengths))
        rank = np.arange(len(order)) - np.searchsorted(lengths[order], lengths[order])
        self.code = np.empty(len(lengths), np.int64)
        self.code[order] = 2 * np.array([0, *low[:-1]])[lengths[order]] + rank
        self.shift = np.array(base) - np.array(low)  # from a prefix to its number in a count level by level
        self.low, self.inside = low, inside
        self._paths = None

    def _numbers(self) -> np.ndarray:
        """Number of each inner node, counted level by level."""
        keys = []
        for d, (low, n) in enumerate(zip(self.low, self.inside, strict=True)):
            prefix, below = low + np.arange(n), d % LEVELS
            root = (prefix >> below) + self.shift[d - below]
            keys.append((root << LEVELS) + (1 << below) + (prefix & (1 << below) - 1))
        out = np.empty(self.nodes, np.int64)
        out[np.argsort(np.concatenate(keys))] = np.arange(self.nodes)
        return out

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """For each symbol where its path starts; the steps of all paths: node << 8 | depth group << 1 | bit.

        Paths lie by length, so those of frequent symbols are together.
        """
        if self._paths is None:
            order = np.argsort(self.length, kind="stable")
            start = np.empty(len(order), np.int64)
            start[order] = np.cumsum(self.length[order]) - self.length[order]
            path, number = np.empty(int(self.length.sum()), np.int32), self._numbers()
            for some in (order[k : k + PATHS] for k in range(0, len(order), PATHS)):
                size = self.length[some]
                depth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                rest = np.repeat(size, size) - depth
                code = np.repeat(self.code[some], size)
                node = number.take((code >> rest) + self.shift[depth])
                path[start[some[0]] :][: len(node)] = node << 8 | np.minimum(depth, DEPTHS - 1) << 1 | (code >> (rest - 1)) & 1
            self._paths = start, path
        return self._paths

    def steps(self, symbols: np.ndarray) -> tuple[np.ndarray, ...]:
        """Code bits of each of a sequence of symbols; for every bit its node, and depth group << 1 | bit."""
        start, path = self.paths()
        size = self.length.take(symbols)
        at = np.repeat(start.take(symbols) - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        step = path.take(at)
        low = step.astype(np.uint8)
        step >>= 8
        return size, step.astype(np.int64), low

    def totals(self, weight: np.ndarray) -> np.ndarray:
        """Weight of zeros and of ones below each node."""
        _, path = self.paths()
        order = np.argsort(self.length, kind="stable")
        each = np.repeat(weight[order], self.length[order])
        return np.bincount((path >> 8).astype(np.int64) * 2 + (path & 1), each, 2 * self.nodes).reshape(-1, 2)

    def __getstate__(self):
        return self.__dict__ | {"_paths": None}


class ConditionalCode(Code):
    """A code for each previous byte, as one: symbol previous * 256 + byte, nodes numbered through."""

    def __init__(self, counts: np.ndarray):
        self.parts = [Code(huffman_lengths(row + 1)) for row in counts.reshape(256, 256)]
        self.length = np.concatenate([c.length for c in self.parts])
        self.nodes = sum(c.nodes for c in self.parts)
        self._paths = None

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        if self._paths is None:
            above = np.cumsum([0, *(c.nodes for c in self.parts)])
            steps = np.concatenate([c.paths()[1] + np.int32(n << 8) for c, n in zip(self.parts, above, strict=False)])
            first = np.cumsum([0, *(c.length.sum() for c in self.parts)])
            self._paths = np.concatenate([c.paths()[0] + n for c, n in zip(self.parts, first, strict=False)]), steps
        return self._paths


class Coder:
    """Turns texts into code bits with their contexts."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, escapes: int, ends: int, byte_counts: np.ndarray, slot_bits: int = 20):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.slot_bits = slot_bits
        self.weight = np.concatenate([self.counts, [ends + 1, escapes + 1]])
        self.code = Code(huffman_lengths(self.weight))
        self.letters = ConditionalCode(byte_counts)
        self.marker = np.zeros(len(words) + 2, np.int64)
        top = np.argsort(-self.counts, kind="stable")[:MARKERS]
        self.marker[top] = 1 + np.arange(len(top))
        self._index = None

    def __getstate__(self):
        return self.__dict__ | {"_index": None}

    @property
    def sizes(self) -> list[list[int]]:
        """Slots of each predictor's table, for words and for bytes; the node alone needs no counting."""
        return [[self.code.nodes, (MARKERS + 1) * self.code.nodes, 1 << self.slot_bits], [1 << BYTE_SLOT_BITS] * PREDICTORS]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Symbol of each word, the escape for those without one."""
        words, escape = self.words, len(self.words) + 1
        if not len(words):
            return np.full(len(hashes), escape)
        top = np.uint64(64 - 20)
        if self._index is None:  # where the words of each leading 20 bits start
            self._index = np.searchsorted(words >> top, np.arange((1 << 20) + 1, dtype=np.uint64)).astype(np.int32)
        lead = (hashes >> top).astype(np.int64)
        at, end = self._index.take(lead), self._index.take(lead + 1)
        out = np.full(len(hashes), escape)
        rows = np.flatnonzero(at < end)
        at, end, wanted = at[rows], end[rows], hashes[rows]
        while len(rows):
            same = words.take(at) == wanted
            out[rows[same]] = at[same]
            at += 1
            more = ~same & (at < end)
            rows, at, end, wanted = rows[more], at[more], end[more], wanted[more]
        return out

    def streams(self, words: Words, merged: bool = False) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
        """Symbols of the words; for words and bytes: code bits of each document, and of each bit the depth group << 1 | bit and slots.

        Merged, the bits of words are in no document's order: tokens equal in all contexts come once, those behind
        the same word side by side, and a fourth array says how often each bit occurs.
        """
        docs = len(words.first) - 1
        count = words.counts
        symbol = self.find(words.hash)
        # Words with an end behind each document.
        total = count + 1
        first = np.cumsum(total) - total
        doc = np.repeat(np.arange(docs), total)
        token = np.full(int(total.sum()), len(self.words))
        is_word = np.ones(len(token), bool)
        is_word[first + count] = False
        token[is_word] = symbol
        # The last marker before each token of its document, and the word before it.
        mark = self.marker.take(token)
        latest = np.zeros(len(token), np.int64)
        np.maximum.accumulate(np.where(mark > 0, np.arange(len(token)), -1)[:-1], out=latest[1:])
        latest = np.where(latest >= first[doc], mark[latest], 0)
        latest[first] = 0
        before = np.ones(len(token), np.int64)
        before[1:] = token[:-1] + 2
        before[first] = 1

        if merged:
            key, times = _times((before * (len(self.words) + 2) + token) * (MARKERS + 1) + latest)
            key, latest = np.divmod(key, MARKERS + 1)
            before, token = np.divmod(key, len(self.words) + 2)
        size, node, low = self.code.steps(token)
        per_doc = None if merged else np.bincount(doc, size, docs).astype(np.int64)
        more = [np.repeat(times, size)] if merged else []
        marked = np.repeat(latest * self.code.nodes, size)
        marked += node
        word_bits = (per_doc, low, [node, marked, _slots(before.view(np.uint64), size, node, self.slot_bits)], *more)

        gone = np.flatnonzero(symbol == len(self.words) + 1)
        size = words.end[gone] - words.start[gone] + 1  # and the space that ends it
        at = np.cumsum(size) - size
        within = np.arange(int(size.sum())) - np.repeat(at, size)
        letter = np.full(len(within), 32, np.int64)
        inside = within < np.repeat(size - 1, size)
        letter[inside] = words.buffer[(np.repeat(words.start[gone], size) + within)[inside]]
        # Hashes of the last 1, 2, 3 ... bytes of the word.
        past, far = [], np.zeros(len(letter), np.uint64)
        for k in range(max(ORDERS)):
            here = np.zeros(len(letter), np.uint64)
            here[k + 1 :] = letter[: len(letter) - k - 1] + 1 if len(letter) > k else 0
            here[within <= k] = 0
            far = (far ^ here) * np.uint64(0x9E3779B97F4A7C15)
            far ^= far >> np.uint64(29)
            past.append(far)
        owner = np.repeat(np.repeat(np.arange(docs), count)[gone], size)
        previous = np.full(len(letter), 32)
        previous[1:] = np.where(within[1:] > 0, letter[:-1], 32)
        size, node, low = self.letters.steps(previous * 256 + letter)
        slots = [_slots(past[k - 1], size, node, BYTE_SLOT_BITS) for k in ORDERS]
        return symbol, [word_bits, (np.bincount(owner, size, docs).astype(np.int64), low, slots)]


@trimmed
def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts (kind, h, c) of word hashes, of the end, and of bytes behind bytes (previous * 256 + byte; a space around words)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = ends = 0
    letters = np.zeros(256 * 256, np.int64)

    def flush():
        keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(keys)
        keys = keys.take(order)
        first = np.flatnonzero(np.concatenate([[len(keys) > 0], keys[1:] != keys[:-1]]))
        return keys.take(first), np.add.reduceat(n.take(order), first) if len(first) else n

    for batch in chunks(batches):
        buffer, offsets = text_buffer(batch.column("text"))
        low = lower_ascii(buffer)
        words = Words(low, offsets)
        keys, n = _times(words.hash.copy())
        ends += batch.num_rows
        if len(words.hash):
            pair = np.full(len(low), 32, np.uint16)
            pair[1:] = low[:-1]
            pair[words.start] = 32
            pair <<= 8
            pair |= low
            pairs = np.bincount(pair, minlength=len(letters)).reshape(256, 256)
            pairs[:, _SEPARATORS] = 0
            pairs[:, 32] = np.bincount(low[words.end - 1], minlength=256)
            letters += pairs.reshape(-1)
        held.append((keys, n))
        rows += len(keys)
        if rows > 1_500_000:
            held = [flush()]
            rows = len(held[0][0])
            if rows > 1_000_000:
                yield _pairs(WORD_COUNT, *held[0])
                held, rows = [], 0
    if held:
        yield _pairs(WORD_COUNT, *flush())
    if ends:
        yield _pairs(END_COUNT, np.zeros(1, np.uint64), np.array([ends]))
        used = np.flatnonzero(letters)
        yield _pairs(BYTE_COUNT, used.astype(np.uint64), letters[used])


def _pairs(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)], names=["kind", "h", "c"])


def _grade(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    x = np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4)))
    return (np.clip(x, -8, 8) / np.float32(GRADE) + np.float32(GRADES / 2)).astype(np.int64)


def _met(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grades and levels of zeros and ones (uint32) that lie side by side."""
    count = pairs.view(np.uint32).astype(np.float32)
    n = count[::2] + count[1::2]
    level = (n > 0).view(np.uint8) + (n >= 12)
    count += np.float32(0.4)
    x = np.divide(count[1::2], count[::2], out=n)
    np.log(x, out=x)
    np.maximum(x, -8, out=x)
    np.minimum(x, 8, out=x)
    x /= np.float32(GRADE)
    x += np.float32(GRADES / 2)
    return x.astype(np.int32), level


class Counter:
    """A task's count tables, and how often each weight set met rounded predictions and an outcome."""

    def __init__(self, coder: Coder):
        self.coder = coder
        self.tables = [[np.zeros(2 * n, np.uint32) if kind or k else None for k, n in enumerate(sizes)] for kind, sizes in enumerate(coder.sizes)]
        # The node's counts are known in full: the bit's own occurrence is taken off.
        alone = coder.code.totals(coder.weight).astype(np.float32)
        taken = [np.maximum(alone - np.eye(2, dtype=np.float32)[bit], 0) for bit in range(2)]
        grade = [_grade(x[:, 0], x[:, 1]).astype(np.uint8) for x in taken]
        self.own_grade = grade[0] | grade[1] << 4
        self.met = np.zeros(MET, np.int64)

    def add(self, streams: list[tuple[np.ndarray, ...]]) -> None:
        for kind, (_, low, slots, *more) in enumerate(streams):
            if not len(low):
                continue
            times = more[0] if more else np.ones(len(low), np.int64)
            for first in range(0, len(low), FIT_BITS):
                some = slice(first, first + FIT_BITS, STRIDE)
                self._fit(kind, low[some], [s[some] for s in slots], times[some])
            times = times.astype(np.uint32) if more else np.uint32(1)
            bit = (low & 1).astype(np.int64)
            for table_, slot in zip(self.tables[kind], slots, strict=True):
                if table_ is not None:
                    at = slot * 2
                    at += bit
                    np.add.at(table_, at, times)

    def _fit(self, kind: int, low: np.ndarray, slots: list[np.ndarray], times: np.ndarray) -> None:
        bit = low & 1
        at = (low >> 1).astype(np.int32)
        at += np.int32(kind * DEPTHS)
        for table_, slot in zip(self.tables[kind][1:], slots[1:], strict=True):
            grade, level = _met(table_.view(np.uint64).take(slot))
            level *= np.uint8(GRADES)
            grade += level.astype(np.int32)
            at *= np.int32(SEEN)
            at += grade
        if self.tables[kind][0] is None:
            grade = self.own_grade.take(slots[0]) >> (bit << 2) & 15
        else:
            grade, _ = _met(self.tables[kind][0].view(np.uint64).take(slots[0]))
        at *= np.int32(GRADES)
        at += grade.astype(np.int32)
        at *= np.int32(2)
        at += bit.astype(np.int32)
        np.add.at(self.met, at.astype(np.int64), times)

    def rows(self, salt: int) -> Iterator[pa.RecordBatch]:
        for place, table_ in enumerate([*(t for kind in self.tables for t in kind if t is not None), self.met]):
            yield _sparse(place, np.concatenate([table_, np.zeros(-len(table_) % RANGE, table_.dtype)]), salt)


def _count(coder: Coder, salts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(coder)
        for batch in chunks(batches, limit=CHUNK):
            buffer, offsets = text_buffer(batch.column("text"))
            counter.add(coder.streams(Words(lower_ascii(buffer), offsets), merged=True)[1])
        yield from counter.rows(TaskContext.get().partitionId() % salts)

    return trimmed(run)


_TABLE = "place int, part int, salt int, used binary, counts binary, large binary"


def _sparse(place: int, counts: np.ndarray, salt: int, first: int = 0) -> pa.RecordBatch:
    """A row for each part that is not empty: which counts are not zero, these in a byte, and those of 255 or more."""
    rows: list[tuple] = []
    for part, x in enumerate(counts.reshape(-1, RANGE), first):
        used = x > 0
        if used.any():
            values = x[used]
            rows.append((place, part, salt, np.packbits(used).tobytes(), np.minimum(values, 255).astype(np.uint8).tobytes(), values[values >= 255].astype(np.int64).tobytes()))
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["place", "part", "salt", "used", "counts", "large"])


def _dense(used: bytes, counts: bytes, large: bytes) -> np.ndarray:
    values = np.frombuffer(counts, np.uint8).astype(np.int64)
    values[values == 255] = np.frombuffer(large, np.int64)
    out = np.zeros(RANGE, np.int64)
    out[np.unpackbits(np.frombuffer(used, np.uint8)).view(bool)] = values
    return out


@trimmed
def _sum_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of rows that come sorted by (place, part): one sum is held at a time, however many tables come."""
    now, total = None, None
    for batch in batches:
        for place, part, *rest in zip(*(batch.column(c).to_pylist() for c in ("place", "part", "used", "counts", "large")), strict=True):
            if (place, part) != now:
                if now:
                    yield _sparse(now[0], total, 0, now[1])
                now, total = (place, part), np.zeros(RANGE, np.int64)
            total += _dense(*rest)
    if now:
        yield _sparse(now[0], total, 0, now[1])


def _stretch(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.clip(np.log((ones + 0.4) / (zeros + 0.4)), -8, 8).astype(np.float32)


def _level(n: np.ndarray) -> np.ndarray:
    """How often a context was seen: never, a few times, often."""
    return (n > 0).astype(np.int64) + (n >= 12)


def _cells(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """A byte each: a stretched probability in steps of 1/4 from -8 on and, in the low two bits, how often it was seen."""
    step = np.minimum(((_stretch(zeros, ones) + 8) * 4).astype(np.uint8), 63)
    return step << 2 | _level(zeros + ones).astype(np.uint8)


class Mixer:
    """Gated weights, the refining table, and the predictors' tables in the logistic domain."""

    def __init__(self, coder: Coder, rows: Iterator = ()):
        """`rows` are those of the summed tables."""
        self.coder = coder
        empty = _cells(np.zeros(1), np.zeros(1))[0]
        self.cells = [[np.full(n, empty, np.uint8) for n in sizes] for sizes in coder.sizes]
        alone = coder.code.totals(coder.weight)
        self.cells[0][0] = _cells(alone[:, 0], alone[:, 1])
        targets = [t for kind, tables in enumerate(self.cells) for k, t in enumerate(tables) if kind or k]
        met = np.zeros(-(-MET // RANGE) * RANGE, np.int64)
        for row in rows:
            counts = _dense(row.used, row.counts, row.large)
            if row.place == len(targets):
                met[row.part * RANGE : (row.part + 1) * RANGE] = counts
            else:
                part = targets[row.place][row.part * RANGE // 2 : (row.part + 1) * RANGE // 2]
                part[:] = _cells(counts[::2], counts[1::2])[: len(part)]
        self.weight = np.full((SETS, PREDICTORS), 0.4, np.float32)
        self.refined = np.tile(np.linspace(-8, 8, 33, dtype=np.float32), (2 * DEPTHS, 1))
        self.fitted = 0  # bits that the weights are fitted on
        self.fit(met[:MET])

    def fit(self, met: np.ndarray, rounds: int = 20) -> None:
        """Learn weights (Newton steps for each set) and table from what the tasks met."""
        met = met.reshape(-1, 2)
        used = np.flatnonzero(met.any(1))
        if not len(used):
            return
        ones, n = met[used, 1].astype(float), met[used].sum(1).astype(float)
        self.fitted = int(n.sum())
        x, rest = np.zeros((len(used), PREDICTORS)), used
        gate = 0
        for k, steps, times in ((0, GRADES, 0), (2, SEEN, 1), (1, SEEN, 3)):
            rest, seen = np.divmod(rest, steps)
            level, grade = np.divmod(seen, GRADES)
            x[:, k] = (grade - GRADES // 2) * GRADE
            gate += level * times
        gate += rest * 9
        weight, start = np.full((SETS, PREDICTORS), 0.4), 0.4
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-(x * weight[gate]).sum(1)))
            miss, slope = ones - n * p, n * p * (1 - p)
            pull = np.stack([np.bincount(gate, miss * x[:, k], SETS) for k in range(PREDICTORS)], 1) - 20 * (weight - start)
            curve = np.stack([np.stack([np.bincount(gate, slope * x[:, k] * x[:, j], SETS) for j in range(PREDICTORS)], 1) for k in range(PREDICTORS)], 1)
            weight += np.clip(np.linalg.solve(curve + 20 * np.eye(PREDICTORS), pull[:, :, None])[:, :, 0], -0.3, 0.3)
        self.weight = weight.astype(np.float32)
        mixed = np.clip((x * weight[gate]).sum(1), -8, 8)
        cell = gate // 9 * 33 + np.rint((mixed + 8) * 2).astype(np.int64)
        ones, n = np.bincount(cell, ones, self.refined.size), np.bincount(cell, n, self.refined.size)
        start = 1 / (1 + np.exp(-self.refined.reshape(-1)))
        p = (ones + 20 * start) / (n + 20)
        self.refined = np.clip(np.log(p / (1 - p)), -8, 8).astype(np.float32).reshape(self.refined.shape)

    def cost(self, docs: int, streams: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        """Bits of each document."""
        out = np.zeros(docs)
        for kind, (per_doc, low, slots) in enumerate(streams):
            if not len(low):
                continue
            weight = np.ascontiguousarray(self.weight.reshape(2, -1, PREDICTORS)[kind].T)
            refined = self.refined[kind * DEPTHS : (kind + 1) * DEPTHS].reshape(-1)
            found = [t.take(slot) for t, slot in zip(self.cells[kind], slots, strict=True)]
            # Blocks of each document in turn: all first blocks, then all second ones ...
            edges = np.concatenate([[0], np.cumsum(per_doc)])
            own = np.zeros((PREDICTORS, docs), np.float32)
            live = np.flatnonzero(per_doc)
            done = 0
            for b in itertools.count():
                length = BLOCK * (1 + b // GROW)
                start = edges[live] + done
                done += length
                more = start < edges[live + 1]
                live, start = live[more], start[more]
                if not len(live):
                    break
                size = np.minimum(edges[live + 1] - start, length)
                first = np.cumsum(size) - size
                rows = np.repeat(start - first, size)
                rows += np.arange(len(rows))
                ones = low.take(rows)
                depth = ones >> 1
                ones &= 1
                cells = [c.take(rows) for c in found]
                gate = depth * np.uint8(9)
                gate += (cells[1] & 3) * np.uint8(3)
                gate += cells[2] & 3
                gate = gate.astype(np.int64)
                mixed, x = None, []
                for k in range(PREDICTORS):
                    value = (cells[k] >> 2).astype(np.float32)
                    value /= np.float32(4)
                    value -= np.float32(7.875)
                    x.append(value)
                    w = weight[k].take(gate)
                    if b:
                        w += np.repeat(own[k, live], size)
                    w *= value
                    mixed = w if mixed is None else np.add(mixed, w, out=mixed)
                np.maximum(mixed, -8, out=mixed)
                np.minimum(mixed, 8, out=mixed)
                at = depth.astype(np.int32)
                at *= np.int32(33)
                at += ((mixed + np.float32(8.25)) * np.float32(2)).astype(np.int32)
                final = refined.take(at)  # with the mixed one, twice the mean of both
                final += mixed
                final += np.float32(16)
                final *= np.float32(STEPS)
                # Both tables are read at the same step, so the two outcomes of a bit sum to 1.
                step = final.astype(np.int32)
                step += (ones ^ 1).astype(np.int32) * np.int32(len(_COST) // 2)
                out[live] += np.add.reduceat(_COST.take(step), first)
                if (edges[live + 1] - start > length).any():  # another block will follow
                    mixed += np.float32(8)
                    mixed *= np.float32(STEPS)
                    miss = ones - _SQUASH.take(mixed.astype(np.int32))
                    scale = RATE / (size + 64).astype(np.float32)
                    for k in range(PREDICTORS):
                        x[k] *= miss
                        own[k, live] += scale * np.add.reduceat(x[k], first)
        return out


def _score(mixer: Mixer, base_of: np.ndarray, end_base: float, end_known: bool):
    """Rows with the model's score, the base of the broadcast words, and the other words."""
    coder = mixer.coder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId(), 0
        for batch in chunks(batches, limit=CHUNK):
            buffer, offsets = text_buffer(batch.column("text"))
            words = Words(lower_ascii(buffer), offsets)
            n = batch.num_rows
            symbol, streams = coder.streams(words)
            cost = mixer.cost(n, streams)
            doc = np.repeat(np.arange(n), words.counts)
            known = symbol < len(coder.words)
            base = np.bincount(doc[known], base_of[symbol[known]], n) + end_base
            seen = np.bincount(doc[known], minlength=n) + int(end_known)
            rest_doc, rest = doc[~known], words.hash[~known]
            order = np.lexsort((rest, rest_doc))
            rest_doc, rest = rest_doc[order], rest[order]
            new = np.ones(len(rest), bool)
            new[1:] = (rest[1:] != rest[:-1]) | (rest_doc[1:] != rest_doc[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(rest)))
            ends = np.searchsorted(rest_doc[at], np.arange(n + 1)).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(rest[at].view(np.int64)), pa.array(times.astype(np.int32))], ["h", "n"])
            row = (np.int64(task) << 34) + done + np.arange(n)
            done += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(row), batch.column("doc_id"), batch.column("held_out"), pa.array(words.counts + 1), pa.array(seen), pa.array(base), pa.array(-cost * _LOG10_2), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(ends), items)],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "bytes", "rest"],
            )

    return trimmed(run)


def _summed(texts: DataFrame, coder: Coder, salts: int) -> DataFrame:
    """Count tables of all map tasks, summed by part; in two steps where there are many tasks."""
    parts = texts.mapInArrow(_count(coder, salts), _TABLE)
    if salts > 1:
        parts = by_key(parts, "place", "part", "salt").mapInArrow(_sum_tables, _TABLE)
    return stored(by_key(parts, "place", "part").mapInArrow(_sum_tables, _TABLE), "lm-tables")


def slot_bits(tokens: int) -> int:
    """Bits of a slot of the hashed word contexts: about two slots for each training token, within bounds."""
    return min(MOST_SLOT_BITS, max(LEAST_SLOT_BITS, int(tokens).bit_length() + 1))


def score_texts(docs: DataFrame, folds: int = 10, held: int = 0, symbols: int = SYMBOLS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row.

    bits_per_byte counts a byte for the end, so that it is defined for empty texts.
    """
    ship(docs.sparkSession)
    part = fold("doc_id", folds)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (part == held).alias("held_out"), ((part != held) & (part >= 0)).alias("learn"))
    learn = rows.where("learn").select("doc_id", "text")

    counted = stored(learn.select("text").mapInArrow(_word_counts, "kind int, h long, c long").groupBy("kind", "h").agg(F.sum("c").alias("c")), "lm-words")
    vocabulary = counted.where(F.col("kind") == WORD_COUNT).select("h", "c")
    sums = vocabulary.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    byte_counts, ends = np.zeros(256 * 256, np.int64), 0
    for row in counted.where(F.col("kind") != WORD_COUNT).collect():  # 65,537 rows at most
        if row.kind == END_COUNT:
            ends = row.c
        else:
            byte_counts[row.h] = row.c
    tokens, distinct = (sums.n or 0) + ends, sums.v + int(ends > 0)
    top = vocabulary.where(F.col("c") >= LEAST).orderBy(F.desc("c"), "h").limit(symbols).toArrow()
    words, counts = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    del top
    coder = Coder(words, counts, int(tokens - ends - counts.sum()), ends, byte_counts, slot_bits(tokens))

    texts = learn.select("text")
    salts = max(1, texts.rdd.getNumPartitions() // FAN_IN)
    mixer = Mixer(coder, _summed(texts, coder, salts).toLocalIterator())  # tables of bounded size

    floor = tokens + 0.1 * (distinct + 1)
    log_base = lambda c: np.log10((c + 0.1) / floor)
    run = _score(mixer, log_base(coder.counts.astype(float)), float(log_base(ends)), ends > 0)
    scored = stored(rows.drop("learn").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, bytes long, rest array<struct<h:long,n:int>>"), "lm-scores")
    rest = scored.select("row", F.explode("rest").alias("w")).select("row", F.col("w.h").alias("h"), F.col("w.n").alias("times"))
    rest = rest.join(vocabulary, "h", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + F.lit(0.1)) / F.lit(float(floor)))).alias("more"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("found"),
    )
    return scored.drop("rest").join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
        (-F.col("score") / F.log10(F.lit(2.0)) / (F.col("bytes") + 1)).alias("bits_per_byte"),
    )


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
