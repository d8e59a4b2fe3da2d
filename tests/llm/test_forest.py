import hashlib
import random
import re

import numpy as np
import pytest

from folioforge.llm import lsh_forest
from folioforge.llm.lsh_forest import forest_depth, near_duplicates


def sets_of(text):
    words = (text or "").split()
    if not words:
        return None
    if len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    n = len(rows)
    links, label = [0] * n, list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            if sets[a] and sets[b] and 1000 * len(sets[a] & sets[b]) >= 800 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                label[max(find(a), find(b))] = min(find(a), find(b))
    members = {}
    for x in range(n):
        members.setdefault(find(x), []).append(rows[x][0])
    return sorted((rows[x][0], min(members[find(x)]), len(members[find(x)]), links[x]) for x in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 4, 5, 40, 200, 400]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 9])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), "  ".join(copy)))
    rows += [(len(rows) + i, rows[0][1].replace("  ", "\n")) for i in range(5)]
    rows += [(900, ""), (901, None), (902, " \t"), (903, "x " * 9000)]
    return rows


@pytest.mark.parametrize("blocks", [False, True])
def test_matches_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(lsh_forest, "BUCKET_BLOCK", 2)
        monkeypatch.setattr(lsh_forest, "SET_BLOCK", 300)
        monkeypatch.setattr(lsh_forest, "NODE_BLOCK", 2)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, node double").repartition(3)
    got = sorted(tuple(r) for r in near_duplicates(docs).select("doc_id", "class_id", "class_size", "n_links").collect())
    assert got == brute(rows)


def test_empty_and_null_ids(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = {tuple(r) for r in near_duplicates(docs).select("doc_id", "class_id", "class_size", "n_links").collect()}
    assert got == {(None, 3, 2, 1), (3, 3, 2, 1), (None, None, 1, 0)}


def test_depth_meets_recall():
    d = forest_depth(0.8)
    assert 1 - (1 - 0.8**d) ** lsh_forest.TREES >= lsh_forest.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** lsh_forest.TREES
    need = lsh_forest.needed_depths(0.8)
    for n in (1, 2, 3, 4, 5, 6, 7, 50):
        similar = [i / (n + m - i) for m in range(1, 2 * n + 2) for i in range(1, min(n, m) + 1) if 1000 * i >= 800 * (n + m - i)]
        assert need[n] == forest_depth(min(similar))
    assert need[3] == lsh_forest.MAX_DEPTH and need[-1] == d and need.min() == d


def naive_components(n, edges):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("seed", range(4))
def test_ascent_joins_what_shares_long_enough_prefixes(seed):
    rng = np.random.default_rng(seed)
    n, shortest = 150, 2
    labels = rng.integers(0, 2, (n, 6)).astype(">u2")
    labels[:, :2] = 7  # one subtree of the shortest prefix
    labels = labels[np.lexsort(labels.T[::-1])]
    need = rng.integers(shortest, 7, n)
    base = rng.integers(0, 256, (12, lsh_forest.SKETCH))
    sketch = np.where(rng.random((n, lsh_forest.SKETCH)) < 0.3, rng.integers(0, 256, (n, lsh_forest.SKETCH)), base[rng.integers(0, 12, n)]).astype(np.uint8)
    a, b = lsh_forest.ascend(labels, need, sketch, shortest)
    want = []
    for i in range(n):
        for j in range(i):
            shared = next((k for k in range(6) if labels[i, k] != labels[j, k]), 6)
            if shared >= max(need[i], need[j]) and (sketch[i] == sketch[j]).sum() >= lsh_forest.SKETCH_AGREE:
                want.append((i, j))
    got = naive_components(n, list(zip(a.tolist(), b.tolist(), strict=True)))
    assert len(want) > 20
    full = naive_components(n, want)
    # All wanted pairs are joined; what else is joined has agreeing sketches (a chain of wanted pairs or of first rows).
    assert all(got[i] == got[j] for i, j in want)
    assert all((sketch[i] == sketch[j]).sum() >= lsh_forest.SKETCH_AGREE or full[i] == full[j] or got[i] == got[j] for i, j in zip(a.tolist(), b.tolist(), strict=True))


def test_words_decide_a_node(spark):
    texts = ["a b  c", " a\tb c ", "a b", "ab c", "", None, "a b c d", "\n", "é\x0bü", "a\x1fb"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", lsh_forest.words_key(lsh_forest.F.col("text")).alias("k")).collect()
    want = [hashlib.sha256(" ".join(re.findall("[^ \t\n\v\f\r]+", t or "")).encode()).digest()[:16] for t in texts]
    assert {r.i: bytes(r.k) for r in rows} == dict(enumerate(want))
    assert lsh_forest.word_keys(lsh_forest.Words(*lsh_forest.text_buffer(lsh_forest.pa.array(texts)))) == want
    assert lsh_forest.word_keys(lsh_forest.Words(*lsh_forest.text_buffer(lsh_forest.pa.array(["", None])))) == [hashlib.sha256(b"").digest()[:16]] * 2


def test_measured_recall(spark):
    """Pairs a little above the threshold: how many of the links brute force finds are found."""
    rng = random.Random(12)
    rows = []
    for _ in range(250):
        base = [f"w{rng.randrange(5000)}" for _ in range(104)]
        other = list(base)
        for at in rng.sample(range(0, 100, 6), 2):  # each edit breaks five of 100 shingles
            other[at] = "edit"
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    want = brute(rows)
    got = {r.doc_id: r.n_links for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    links = sum(r[3] for r in want)
    assert links >= 400 and sum(got.values()) / links >= 0.99


@pytest.mark.parametrize("pivots", [False, True])
def test_one_of_each_keeps_what_is_no_copy(spark, monkeypatch, pivots):
    if pivots:
        monkeypatch.setattr(lsh_forest, "BUCKET_BLOCK", 3)
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    base = text(60)
    copies = [base + f" tail{i}" for i in range(12)]
    rows = [(None, c) for c in copies[:6]] + [(5, copies[6]), (5, "another text under the same id " + text(20)), (9, copies[7]), (9, copies[7])]
    rows += [(None, t) for t in (text(30), text(30))] + [(20, "single one here"), (20, "single one here"), (21, ""), (22, None)]
    docs = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, node int, h1 string").repartition(3)
    got = lsh_forest.one_of_each(docs)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [rows[6], rows[7], rows[10], rows[11], rows[12], rows[14], rows[15]]))
    assert lsh_forest.one_of_each(docs.limit(0)).count() == 0
