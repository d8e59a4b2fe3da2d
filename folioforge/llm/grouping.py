"""Whole groups from sorted Arrow batches, and components of small graphs in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_key(df: DataFrame, *keys: str, then: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a key side by side within one partition."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *then)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least_rows: int = 4096) -> Iterator[pa.Table]:
    """Tables that end where a key ends, of about `least_rows` rows or one longer group."""
    held: list[pa.RecordBatch] = []
    rows, wanted = 0, least_rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < wanted:
            continue
        table = pa.Table.from_batches(held)
        last = last_start(table, keys)
        if last:
            yield table.slice(0, last).combine_chunks()
        held = table.slice(last).to_batches()
        rows = table.num_rows - last
        wanted = max(least_rows, 2 * rows)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First row of each group, and the number of rows."""
    n = table.num_rows
    change = np.zeros(max(n - 1, 0), bool)
    for k in keys:
        x = table.column(k).to_numpy()
        change |= x[1:] != x[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [n]]).astype(np.int64)


def last_start(table: pa.Table, keys: list[str]) -> int:
    return int(starts(table, keys)[-2])


def pairs_within(sizes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of rows within groups that start at `first`."""
    rows = np.arange(int(sizes.sum()))
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    after = np.repeat(sizes, sizes) - 1 - (rows - start)
    left = np.repeat(rows, after)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)
    shift = np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
    return left + shift[left], right + shift[right]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each node's component, for edges a-b over 0..n-1."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


PREFIX_BITS = 20


def prefix_filter(df: DataFrame, column: str) -> np.ndarray:
    """A filter of fixed size (2**PREFIX_BITS flags) of the leading bits of a binary column's values."""
    top = F.conv(F.hex(F.substring(column, 1, 3)), 16, 10).cast("int")
    found = df.select(F.shiftright(top, 24 - PREFIX_BITS).alias("p")).distinct()
    flags = np.zeros(1 << PREFIX_BITS, bool)
    flags[found.toArrow().column("p").to_numpy()] = True  # at most 2**PREFIX_BITS rows
    return flags


def leading_bits(keys: list[bytes]) -> np.ndarray:
    """The leading bits of binary values, as `prefix_filter` has them."""
    values = np.frombuffer(b"".join(k[:3] for k in keys), np.uint8).reshape(-1, 3).astype(np.int64)
    return (values[:, 0] << 16 | values[:, 1] << 8 | values[:, 2]) >> (24 - PREFIX_BITS)
