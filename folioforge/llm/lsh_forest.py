"""Join of documents whose word 5-gram sets have a Jaccard similarity of 0.8 or more, by an LSH forest.

Documents of equal word sequences (128 bits of SHA-256 say so) share a node.

1. Each node gets TREES labels of MAX_DEPTH MinHash values of 16 bits: a leaf in each of TREES prefix
   tries (Bawa, Condie, Ganesan: LSH Forest, WWW 2005).
2. The leaves of a tree are sorted by label, which is the trie's order: a trie node of depth d is a
   run of rows that share d values. Matching starts at full depth, and prefixes are shortened step by
   step. Each node stops where its own target recall is reached: the depth d with
   1 - (1 - s**d)**TREES >= recall, s being the least similarity that a link of a set of its size can
   have. The shortest such prefix deals subtrees to tasks; in a task the ascent is made run by run
   (`ascend`). Only pairs whose sketches agree in at least SKETCH_AGREE places are joined; a pair at
   the threshold fails that with probability 1e-12. What is joined already is not compared again.
3. Groups of nodes that met become components; within these *all* pairs are verified exactly on
   their shingle sets, so a pair that no tree found is found as long as its ends are connected.
   Large subtrees and components are cut into blocks, and every pair of blocks is a task's work. Of a
   large subtree, rows whose sketch agrees with that of one pivot are joined to it before, and of
   these only the ones that the triangle inequality allows near another row go on.
4. Verified links give each document its class and its number of links. Pairs never become rows:
   a task sends one row a node with its count of links and its local root.

Copies count as links of each other by multiplicity without being expanded.

Defined cases: texts of fewer than five words are one shingle; texts without words and nulls link
to nothing (class of their own); very long texts are read whole; class_id is the least doc_id of the
class (null if it has none); rows that repeat count as documents each; other columns, whatever their
names, are not read, or pass through `one_of_each`; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import checkpoint_dir, stored, table
from .grouping import by_key, leading_bits, pairs_within, prefix_filter, roots, starts, whole_groups
from .lsm_dedup import BloomFilter
from .texthash import _WORDS, Words, chunks, mix64, signed, text_buffer, trimmed, window_hash

SHINGLE = 5
THRESHOLD = 0.8
TREES = 24
MAX_DEPTH = 8
RECALL = 0.99999
SKETCH_AGREE = 48
SKETCH = 96
#: Members of a subtree, and shingles and nodes of a component, that one task compares with another such block.
BUCKET_BLOCK = 2048
SET_BLOCK = 1 << 20
NODE_BLOCK = 256
#: Sets of more shingles count as if any similarity from the threshold on were possible.
SIZES = 2048


def forest_depth(threshold: float, trees: int = TREES, most: int = MAX_DEPTH, recall: float = RECALL) -> int:
    """Longest prefix that still finds a pair at the threshold with the target recall."""
    depth = most
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def needed_depths(threshold: float, recall: float = RECALL) -> np.ndarray:
    """For sets of 0 to SIZES shingles the prefix length at which a node's links are found with the recall."""
    out = np.full(SIZES + 1, forest_depth(threshold, recall=recall))
    p = round(threshold * 1000)
    for n in range(1, SIZES):
        common = n - np.arange(n - -(-p * n // 1000) + 1)  # shared with the other set
        union = np.maximum(common * 1000 // p, n)  # the largest that is still similar enough
        out[n] = forest_depth(float((common / union).min()), recall=recall)
    return out


def word_keys(words: Words) -> list[bytes]:
    """128 bits of the SHA-256 of each document's words, joined by one space; `words_key` has the same in the JVM."""
    size = words.end - words.start + 1
    at = np.repeat(words.start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    joined = words.buffer[np.minimum(at, len(words.buffer) - 1)] if len(at) else np.zeros(0, np.uint8)
    joined[np.cumsum(size) - 1] = 0x20
    first = np.concatenate([[0], np.cumsum(size)])[words.first].tolist()
    raw = memoryview(joined)
    return [hashlib.sha256(raw[a : max(a, b - 1)]).digest()[:16] for a, b in zip(first[:-1], first[1:], strict=True)]


def words_key(text: Column) -> Column:
    """128 bits of the SHA-256 of a text's words, joined by one space; of nothing for a null text."""
    words = F.btrim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.substring(F.unhex(F.sha2(words, 256)), 1, 16)


def _shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all documents and the offsets of each document's."""
    count = words.counts
    per = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros(bounds[-1], np.uint64)
    long = np.repeat(count >= SHINGLE, per)
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], per) + np.repeat(words.first[:-1], per)
    if long.any():
        out[long] = window_hash(words.hash, SHINGLE)[at[long]]
    if not long.all():
        out[~long] = sequence_hash(words)[(count > 0) & (count < SHINGLE)]
    return out, bounds


def sequence_hash(words: Words) -> np.ndarray:
    """Hash of each document's whole sequence of words."""
    up, down = _WORDS.get(len(words.hash) + 1)
    total = np.zeros(len(words.hash) + 1, np.uint64)
    np.cumsum(words.hash * up[:-1], out=total[1:])
    h = (total[words.first[1:]] - total[words.first[:-1]]) * down[words.first[:-1]]
    return mix64(h + words.counts.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


_SALT = mix64(np.arange(1, TREES * MAX_DEPTH + 1, dtype=np.uint64))


def signatures(shingles: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """`count` MinHash values (uint32) of each document; all have a shingle at least."""
    out = np.empty((len(bounds) - 1, count), np.uint32)
    low, high = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(count):
        a, b = np.uint32(int(_SALT[i]) & 0xFFFFFFFF | 1), np.uint32(int(_SALT[i]) >> 32 | 1)
        out[:, i] = np.minimum.reduceat(low * a + high * b, bounds[:-1])
    return out


@trimmed
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        words = Words(*text_buffer(batch.column("text")))
        full = np.flatnonzero(words.counts > 0)
        shingles, bounds = _shingles(words)
        labels, sketch = [None] * batch.num_rows, [None] * batch.num_rows
        if len(full):
            values = signatures(shingles, np.unique(bounds), TREES * MAX_DEPTH) * np.uint32(0x9E3779B1)
            label = (values >> np.uint32(16)).astype(">u2")
            byte = (values[:, :SKETCH] >> np.uint32(24)).astype(np.uint8)
            for k, i in enumerate(full.tolist()):
                labels[i], sketch[i] = label[k].tobytes(), byte[k].tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(word_keys(words), pa.binary()), pa.array(words.counts), pa.array(np.diff(bounds)), pa.array(labels, pa.binary()), pa.array(sketch, pa.binary())],
            names=["doc_id", "key", "n_words", "n_shingles", "labels", "sketch"],
        )


def shared_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of labels, row by row."""
    return np.cumprod(a == b, axis=1).sum(1)


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(-1) >= SKETCH_AGREE


def ascend(labels: np.ndarray, need: np.ndarray, sketch: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the rows of a subtree, which come in the order of their labels.

    From full depth up, the rows of each trie node that still look for partners at that depth are
    compared if deeper nodes have not joined them: with the first of them, then among all.
    """
    n = len(labels)
    beside = shared_values(labels[:-1], labels[1:])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    root = np.arange(n)
    for depth in range(labels.shape[1], shortest - 1, -1):
        cut = np.concatenate([[0], np.flatnonzero(beside < depth) + 1, [n]])
        for low, high in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            rows = low + np.flatnonzero(need[low:high] <= depth)
            if len(rows) < 2 or (root[rows] == root[rows[0]]).all():
                continue
            same = rows[_agree(sketch[rows], sketch[rows[0]])]
            left.append(np.full(len(same), rows[0]))
            right.append(same)
            root = roots(n, np.concatenate(left), np.concatenate(right))
            for at in range(0, len(rows), 64):
                some, rest = rows[at : at + 64], rows[at:]
                rest = rest[~np.isin(root[rest], root[some])] if (root[some] == root[some[0]]).all() else rest
                if not len(rest):
                    continue
                a, b = np.nonzero(_agree(sketch[some][:, None, :], sketch[rest][None, :, :]))
                pairs = np.unique(np.stack([root[some[a]], root[rest[b]]], 1), axis=0)
                pairs = pairs[pairs[:, 0] != pairs[:, 1]]
                if len(pairs):
                    left.append(pairs[:, 0])
                    right.append(pairs[:, 1])
                    root = roots(n, np.concatenate(left), np.concatenate(right))
    return np.concatenate(left), np.concatenate(right)


def _meet(shortest: int):
    """Edges that join the nodes of each subtree."""
    keys = ["tree", "bucket", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, keys):
            at = starts(group, keys)
            node, need = group.column("node").to_numpy(), group.column("need").to_numpy()
            sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(node), SKETCH)
            labels = np.frombuffer(b"".join(group.column("label").to_pylist()), ">u2").reshape(len(node), MAX_DEPTH)
            size = np.diff(at)
            found = []
            few = size <= 64
            # Small subtrees together: their pairs, where the common prefix is long enough for both.
            for rows in np.array_split(np.flatnonzero(few & (size > 1)), max(1, int(size[few].sum()) // 2000)):
                if len(rows):
                    picked = np.concatenate([np.arange(at[r], at[r + 1]) for r in rows])
                    a, b = pairs_within(size[rows], np.cumsum(size[rows]) - size[rows])
                    a, b = picked[a], picked[b]
                    same = (shared_values(labels[a], labels[b]) >= np.maximum(need[a], need[b])) & _agree(sketch[a], sketch[b])
                    found.append((a[same], b[same]))
            for r in np.flatnonzero(~few).tolist():
                low, high = at[r], at[r + 1]
                order = low + np.lexsort(labels[low:high].T[::-1])
                a, b = ascend(labels[order], need[order], sketch[order], shortest)
                found.append((order[a], order[b]))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                ids, code = np.unique(node, return_inverse=True)
                root = roots(len(ids), code[a], code[b])
                moved = np.flatnonzero(root != np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], names=["src", "dst"])

    return trimmed(run)


@trimmed
def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add how many places of a row's sketch differ from its pivot's."""
    for batch in batches:
        if batch.num_rows:
            own, pivot = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("sketch", "pivot_sketch"))
            rest = [c for c in batch.schema.names if c != "pivot_sketch"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array((own != pivot).sum(1).astype(np.int32))], names=[*rest, "distance"])


def _pivoted(large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the rows of large subtrees: edges to one pivot each, and the rows that may meet others than it.

    Sketches differ in a metric: a row at distance x of the pivot and one at distance y differ in y - x
    places at least. So of the rows joined to the pivot only those with x >= y - (SKETCH - SKETCH_AGREE)
    for the nearest row that is not joined need to be compared with such rows.
    """
    most = SKETCH - SKETCH_AGREE
    pivots = large.groupBy("tree", "bucket").agg(F.min_by(F.struct(F.col("node").alias("pivot"), F.col("sketch").alias("pivot_sketch")), "node").alias("p")).select("tree", "bucket", "p.*")
    joined = large.join(pivots, ["tree", "bucket"])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema.fields if f.name != "pivot_sketch")
    measured = stored(joined.mapInArrow(_distances, f"{schema}, distance int"), "forest-pivots")
    edges = measured.where((F.col("distance") <= most) & (F.col("node") != F.col("pivot"))).select(F.col("node").alias("src"), F.col("pivot").alias("dst"))
    far = measured.where(F.col("distance") > most).groupBy("tree", "bucket").agg(F.min("distance").alias("nearest"))
    rest = measured.join(far, ["tree", "bucket"]).where(F.col("distance") >= F.col("nearest") - most).drop("n", "pivot", "distance", "nearest")
    sizes = rest.groupBy("tree", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return edges, rest.join(sizes, ["tree", "bucket"])


def _sets(flags: np.ndarray):
    """Shingle sets of the texts whose key may be wanted, one for each key of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = Words(*text_buffer(batch.column("text")))
            keys = word_keys(words)
            wanted = np.flatnonzero(flags[leading_bits(keys)] & (words.counts > 0))
            wanted = np.array(sorted({keys[i]: i for i in reversed(wanted.tolist())}.values()), np.int64)
            shingles, bounds = _shingles(words)
            sets = [np.unique(shingles[bounds[i] : bounds[i + 1]]).tobytes() for i in wanted.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in wanted.tolist()], pa.binary()), pa.array(sets, pa.binary())], names=["key", "shingles"])

    return trimmed(run)


def linked_pairs(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of sets with an exact Jaccard similarity of the threshold or more."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    _, code, df = np.unique(flat, return_inverse=True, return_counts=True)
    shared = df > 1
    column = np.cumsum(shared) - 1
    keep = shared[code]
    owner, code = owner[keep], column[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    width = int(shared.sum())
    common = np.zeros((n, n), np.float32)
    step = max(1, (4 << 20) // n)
    for low in range(0, width, step):
        a, b = np.searchsorted(code, [low, low + step])
        part = np.zeros((n, min(step, width - low)), np.float32)
        part[owner[a:b], code[a:b] - low] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    total = size[:, None] + size[None, :] - common
    # In whole numbers: common / total >= p / q.
    linked = common * 1000 >= total * round(threshold * 1000)
    return np.nonzero(np.triu(linked, 1))


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["component", "i", "j"]
        for table_ in whole_groups(batches, keys, least_rows=512):
            at = starts(table_, keys)
            node, copies, block = (table_.column(c).to_numpy() for c in ("node", "copies", "block"))
            i, j = (table_.column(c).to_numpy() for c in ("i", "j"))
            raw = table_.column("shingles")
            out_node, out_root, out_links = [], [], []
            for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if high - low < 2:
                    continue
                sets = [np.frombuffer(raw[r].as_py(), np.uint64) for r in range(low, high)]
                a, b = linked_pairs(sets, threshold)
                if i[low] != j[low]:  # pairs within a block belong to that block's own group
                    cross = block[low + a] != block[low + b]
                    a, b = a[cross], b[cross]
                n = high - low
                links = np.bincount(a, copies[low + b], n) + np.bincount(b, copies[low + a], n)
                root = roots(n, a, b)
                rows = np.flatnonzero(links > 0)
                out_node.append(node[low + rows])
                out_root.append(node[low + root[rows]])
                out_links.append(links[rows].astype(np.int64))
            if out_node:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_node, out_root, out_links)], names=["node", "root", "links"])

    return trimmed(run)


def _in_blocks(df: DataFrame, key: str, blocks: str) -> DataFrame:
    """Every pair of the key's blocks as (i, j), each with the rows of both."""
    df = df.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col(blocks)).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    return df.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _forest_edges(nodes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Edges between nodes that met in some tree."""
    shortest = forest_depth(threshold, recall=recall)
    need = F.element_at(F.array(*[F.lit(int(d)) for d in needed_depths(threshold, recall)]), (F.least("n_shingles", F.lit(SIZES)) + 1).cast("int"))
    label = F.substring(F.col("labels"), F.col("tree") * 2 * MAX_DEPTH + 1, F.lit(2 * MAX_DEPTH))
    leaves = nodes.select("node", "labels", need.alias("need"), F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    leaves = leaves.select("node", "need", "tree", label.alias("label")).withColumn("bucket", F.substring("label", 1, 2 * shortest))
    shared = leaves.groupBy("tree", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = leaves.join(shared, ["tree", "bucket"]).join(nodes.select("node", "sketch"), "node")
    edges = None
    if shared.where(F.col("n") > BUCKET_BLOCK).limit(1).count():
        edges, rest = _pivoted(members.where(F.col("n") > BUCKET_BLOCK))
        members = members.where(F.col("n") <= BUCKET_BLOCK).unionByName(rest)
    members = members.withColumn("blocks", F.ceil(F.col("n") / BUCKET_BLOCK))
    dealt = by_key(_in_blocks(members, "bucket", "blocks").select("tree", "bucket", "i", "j", "label", "node", "need", "sketch"), "tree", "bucket", "i", "j", then=("label", "node"))
    met = dealt.mapInArrow(_meet(shortest), "src long, dst long")
    return (met if edges is None else met.unionByName(edges)).distinct()


def classified(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, key (of its words), class_id, class_size, n_links, and whether it represents its class.

    The representative is a document of the class's least doc_id; there, of the least key.
    """
    checkpoint_dir(docs.sparkSession)
    rows = _slim(docs)
    schema = "doc_id long, key binary, n_words long, n_shingles long, labels binary, sketch binary"
    signed_docs = stored(rows.mapInArrow(_sign, schema), "forest")
    first = [F.first(c).alias(c) for c in ("n_words", "n_shingles", "labels", "sketch")]
    nodes = signed_docs.where("n_words > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), *first)
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "forest-nodes")

    edges = stored(_forest_edges(nodes, threshold, recall), "forest-edges")
    groups = stored(connected_components(edges).join(nodes.select("node", "key", "copies", "n_words"), "node"), "forest-groups")

    sets = rows.mapInArrow(_sets(prefix_filter(groups, "key")), "key binary, shingles binary").groupBy("key").agg(F.first("shingles").alias("shingles"))
    load = groups.groupBy("component").agg(F.greatest(F.ceil(F.sum("n_words") / SET_BLOCK), F.ceil(F.count(F.lit(1)) / NODE_BLOCK)).alias("blocks"))
    placed = groups.join(load, "component").join(sets, "key")
    placed = _in_blocks(placed, "component", "blocks").select("component", "i", "j", "block", "node", "copies", "shingles")
    checked = by_key(placed, "component", "i", "j", then=("node",))
    links = stored(checked.mapInArrow(_verify(threshold), "node long, root long, links long"), "forest-links")

    classes = connected_components(links.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "key", "least", "copies")
    linked = classes.join(counted, "node").join(known, "node")
    by_least = F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("least"), F.col("key").alias("key"))
    whole = linked.groupBy("component").agg(F.min(by_least).alias("rep"), F.sum("copies").alias("class_copies"))
    linked = linked.join(whole, "component").select("node", "links", "rep", "class_copies")
    known = known.join(linked, "node", "left")
    alone = F.col("links").isNull()
    known = known.select(
        F.col("key").alias("_key"),
        F.when(alone, F.col("least")).otherwise(F.col("rep.least")).alias("class_id"),
        F.coalesce("class_copies", "copies").cast("long").alias("class_size"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        (alone | (F.col("key") == F.col("rep.key"))).alias("in_rep"),
    )
    known = known.where("class_size > 1")  # all others are alone
    same = (F.col("key") == F.col("_key")) & (F.col("n_words") > 0)
    out = signed_docs.select("doc_id", "key", "n_words").join(known, same, "left")
    alone = F.col("class_size").isNull()
    return out.select(
        "doc_id",
        "key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (alone | (F.col("in_rep") & F.col("doc_id").eqNullSafe(F.col("class_id")))).alias("represents"),
    )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_links."""
    return classified(docs, threshold, recall).select("doc_id", "class_id", "class_size", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The input rows of the documents that represent their class, in all columns, one for each class.

    Rows are told apart by doc_id and words, so null and repeated ids lose nothing but near copies.
    Only rows whose words may be in a class of several are shuffled: a filter excludes the others.
    """
    several = classified(docs).where("class_size > 1").groupBy("doc_id", "key").agg(F.max("represents").alias("represents"))
    several = stored(several, "forest-classes")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), words_key(F.col("text")).alias("_key"))
    probed = BloomFilter(several, several.count(), "key").probe(rows, F.col("_key"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("key"))
    met = probed.where("_maybe").join(several, same, "left")
    single = met.where("represents is null").select("_row")
    kept = met.where("represents").groupBy("_id", "_key").agg(F.first("_row").alias("_row")).select("_row")
    return probed.where("not _maybe").select("_row").unionByName(single).unionByName(kept).select("_row.*")


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END AS g
  FROM d),
x AS (SELECT doc_id, len(g) AS k, unnest(g) AS g FROM s),
c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.k) AS ka, any_value(b.k) AS kb
  FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
p AS (SELECT a, b FROM c WHERE 1000 * common >= 800 * (ka + kb - common)),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
walk(node, seen) AS (SELECT a, a FROM e UNION SELECT walk.node, e.b FROM walk JOIN e ON e.a = walk.seen),
k AS (SELECT node AS doc_id, min(seen) AS class_id, count(*) AS class_size FROM walk GROUP BY node),
l AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(class_size, 1) AS class_size, coalesce(n_links, 0) AS n_links
FROM documents LEFT JOIN k USING (doc_id) LEFT JOIN l USING (doc_id)
"""
