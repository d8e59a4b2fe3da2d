import collections
import hashlib
import math
import random

import pytest

from pyspark.sql import functions as F

from folioforge.llm.lsm_dedup import DigestIndex, distinct_rows, exact_dedup
from folioforge.llm import lsm_dedup, pareto_mix
from folioforge.llm.pareto_mix import mix, mix_rows, sized, source_targets, word_count

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_dedup(rows):
    norm = [(t or "").translate(LOWER) for _, t in rows]
    ids = collections.defaultdict(list)
    for (i, _), t in zip(rows, norm, strict=True):
        ids[t].append(i)
    out = []
    for (i, _), t in zip(rows, norm, strict=True):
        keep = max((x for x in ids[t] if x is not None), default=None)
        out.append((i, keep, len(ids[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "Abc É"), (2, "aBC É"), (3, "abc é"), (4, None), (5, ""), (6, "x" * 300_000), (7, "X" * 300_000), (8, "one"), (None, "ONE"), (None, "lone"), (9, "rep"), (9, "rep"), (10, " one")]


def test_exact_dedup_matches_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "z", 3) for i, t in ROWS], "doc_id long, text string, digest string, n int").repartition(3)
    got = sorted((tuple(r) for r in exact_dedup(docs).collect()), key=repr)
    assert got == brute_dedup(ROWS)
    assert exact_dedup(docs.limit(0)).count() == 0
    kept = sorted((r.doc_id, r.digest, r.n) for r in distinct_rows(docs).where("doc_id is not null").collect())
    assert [k[0] for k in kept] == [2, 3, 5, 7, 8, 9, 10] and distinct_rows(docs).columns == docs.columns
    assert distinct_rows(docs).where("doc_id is null").count() == 1


def test_index_grows_by_runs(spark):
    index = DigestIndex(spark, keep="min")
    index.flush(spark.createDataFrame([(5, "a"), (6, "b")], "doc_id long, text string").repartition(2))
    assert len(index.runs) == lsm_dedup.MEMTABLES and index.hits().count() == 0
    assert len(index.runs) == 1
    index.flush(spark.createDataFrame([(3, "A"), (9, "c")], "doc_id long, text string"))
    assert len(index.runs) == lsm_dedup.MEMTABLES + 1
    assert [(r.keep_id, r.n) for r in index.hits().collect()] == [(3, 2)]
    assert {(r.keep_id, r.n) for r in index.compact().collect()} == {(3, 2), (6, 1), (9, 1)}


def test_runs_are_sorted_and_merged_by_levels(spark, monkeypatch):
    monkeypatch.setattr(lsm_dedup, "FAN_IN", 2)
    rng = random.Random(1)
    rows = [(i, f"text {rng.randrange(300)}") for i in range(1000)]
    index = DigestIndex(spark, keep="max")
    index.flush(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    merged = index.compact()
    assert len(index.levels) == 4  # 8 runs, then 4, 2 and 1
    for part in merged.rdd.glom().collect():
        assert [bytes(r.digest) for r in part] == sorted(bytes(r.digest) for r in part)
    want = collections.defaultdict(list)
    for i, t in rows:
        want[hashlib.sha256(t.encode()).digest()].append(i)
    assert {bytes(r.digest): (r.keep_id, r.n) for r in merged.collect()} == {d: (max(x), len(x)) for d, x in want.items()}


@pytest.mark.parametrize("bits", [30, 15])
def test_filter_has_no_false_negatives(spark, monkeypatch, bits):
    monkeypatch.setattr(lsm_dedup, "MOST_BITS", bits)
    keys = spark.range(20_000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), "id")
    inside = keys.where("id < 10000")
    probed = lsm_dedup.BloomFilter(inside, 10_000).probe(keys, F.col("digest"))
    assert probed.where("id < 10000 and not _maybe").count() == 0
    false = probed.where("id >= 10000 and _maybe").count()
    assert false < 200 if bits == 30 else false > 0


def test_texts_of_one_digest_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(lsm_dedup.F, "sha2", lambda c, n, sha2=F.sha2: F.rpad(F.substring(sha2(c, n), 1, 1), n // 4, "0") if n == 256 else sha2(c, n))
    rows = [(i, f"text {i % 40}") for i in range(90)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "keep_id", "group_size", "kept").collect()
    want = brute_dedup(rows)
    assert sorted(tuple(r) for r in got) == sorted(w[:4] for w in want)
    kept = distinct_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id for r in kept.collect()} == {w[0] for w in want if w[3]}


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 500), ("d", 0)], "source string, source_size long")
    for few in (True, False):
        got = {r.source: r.target for r in source_targets(sizes, few=few).collect()}
        # Weights: a 3, b 1, c 2, d 3, null 1; a, c and d reach twice their size, the others share the rest.
        assert got == {"a": 200.0, "c": 20.0, "d": 0.0, None: 1000.0, "b": 1.5 * 1610 - 1220}
        assert source_targets(sizes.limit(0), few=few).count() == 0


def mix_corpus():
    rng = random.Random(8)
    rows = [(rng.choice([i, i, 7, None]) if i % 5 == 0 else i, rng.choice(["hot", "hot", "hot", "x", "y", None]), f"a{i} " * rng.choice([0, 5, 50, 50, 200])) for i in range(2000)]
    return rows + [(7, "x", None)] + [(9, "y", "same words here")] * 300 + [(None, "z", "w w w")] * 50


def brute_mix(rows):
    """(doc_id, text, source, copies) by plain loops."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    by = collections.defaultdict(list)
    for i, s, t in rows:
        by[s].append((i, t, len((t or "").split())))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    size = {s: sum(r[2] for r in by[s]) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    open_, capped = set(names), set()
    while True:
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)) / max(1, sum(weight[s] for s in open_))
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            break
        open_, capped = open_ - over, capped | over
    target = {s: 2.0 * size[s] if s in capped else level * weight[s] for s in names}
    out = []
    for s in names:
        certain = math.floor(target[s] / size[s]) if size[s] else 0
        rest = (target[s] / size[s] - certain) * size[s] if size[s] else 0
        left, k = sorted((r[2] for r in by[s] if r[2]), reverse=True), None
        need = rest
        while left and need > 0:
            k = need / sum(x * x for x in left)
            if k * left[0] <= 1:
                break
            big = left[0]
            need -= big * sum(x == big for x in left)
            left = [x for x in left if x != big]
        ranked = []
        for i, t, n in by[s]:
            if not n or not k or rest <= 0:
                out.append((i, t, s, certain))
                continue
            u = (int(md5(f"{'null' if i is None else i}:{md5(t or '')}:{pareto_mix.SEED}")[:13], 16) + 0.5) / 2**52
            p = k * n
            ranked.append((0.0 if p >= 1 else (u / (1 - u)) / (p / (1 - p)), (1 << 63) - 1 if i is None else i, n, md5(t or ""), i, t))
        before = 0
        for q in sorted(ranked, key=lambda q: q[:4]):
            out.append((q[4], q[5], s, certain + int(before < rest and 2 * (rest - before) >= q[2])))
            before += q[2]
    return sorted(out, key=repr), target


@pytest.mark.parametrize("few", [100_000, 0])
def test_mix_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(pareto_mix, "FEW", few)
    rows = mix_corpus()
    docs = spark.createDataFrame([(i, s, t, 1.0) for i, s, t in rows], "doc_id long, source string, text string, target double").repartition(6)
    want, target = brute_mix(rows)
    with_size = sized(docs.withColumnRenamed("target", "other"))
    got = mix(with_size)
    assert sorted(((r.doc_id, r.text, r.source, r.copies) for r in got.collect()), key=repr) == want
    assert all(abs(r.target - target[r.source]) < 1e-6 and r.taken == r.copies * r.size <= 2 * r.size for r in got.collect())
    whole = mix_rows(docs)
    assert whole.columns == docs.columns
    found = collections.Counter((r.doc_id, r.text, r.source) for r in whole.collect())
    expected = collections.Counter()
    for i, t, s, n in want:
        expected[i, t, s] += n
    assert found == +expected
    taken = {r.source: r.w for r in got.groupBy("source").agg(F.sum("taken").alias("w")).collect()}
    assert all(abs(taken[s] - target[s]) <= 100 for s in target)  # half of the largest document
    # Longer documents are likelier to be taken once more.
    once = got.where("source = 'hot' and size > 0").groupBy("size").agg(F.avg(F.col("copies")).alias("c")).orderBy("size").collect()
    assert [r.c for r in once] == sorted(r.c for r in once) and once[0].c < once[-1].c
    assert mix(with_size.limit(0)).count() == mix_rows(docs.limit(0)).count() == 0
