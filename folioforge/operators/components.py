"""Connected components of an edge table by alternating large-star and small-star.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014). Each half round
is one aggregate and one equi-join; the edge table is written to the shared checkpoint folder
after every round, so lineage stays short and a lost executor costs one round. As soon as no more than
FEW_EDGES edges are left, they are settled at once in numpy (4 MB sent to the driver at most).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import work_folder

#: Edges between long nodes that the driver settles by itself.
FEW_EDGES = 1 << 18


def least_members(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each node's component, for edges a-b over 0..n-1."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
        still = label[a] != label[b]
        a, b = a[still], b[still]
    return label


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the smaller) neighbours of every node on the least of its neighbourhood."""
    if large:
        around = _both(edges)
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = around.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u")
        hung = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return hung.where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.

    Rows with a null end are ignored; a loop makes a node of its own; no edges give no rows.
    """
    pairs = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("u"), F.col(dst).alias("v"))
    loops = pairs.where("u = v").select("u", "v")
    now = _checkpointed(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state.n, state.h) == before:
            break
        before = (state.n, state.h)
        if 0 < state.n <= FEW_EDGES and {kind for _, kind in now.dtypes} == {"bigint"}:
            now = _settled(now)
            break
        now = _checkpointed(_star(_star(now, large=True), large=False))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("u"), "v").unionByName(loops.join(_both(now).select("u"), "u", "left_anti"))
    return now.unionByName(roots.distinct()).select(F.col("u").alias("node"), F.col("v").alias("component"))


def _settled(edges: DataFrame) -> DataFrame:
    """All nodes but the least of each component, with that least one; of few edges."""
    held = edges.toArrow()
    ids, code = np.unique(np.concatenate([held.column(c).to_numpy() for c in ("u", "v")]), return_inverse=True)
    root = least_members(len(ids), code[: held.num_rows], code[held.num_rows :])
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return _checkpointed(edges.sparkSession.createDataFrame(pa.table({"u": ids[moved], "v": ids[root[moved]]})))


def _checkpointed(df: DataFrame) -> DataFrame:
    work_folder(df.sparkSession)
    return df.checkpoint(eager=True)
