import math

import numpy as np

from folioforge.llm import norm_topk
from folioforge.llm.norm_topk import top_k


def brute(rows, k):
    ok = [(i, np.floor(np.array(v, float) * 256).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 50:
            continue
        scores = sorted(((-int(a @ b), i) for i, b in ok if i != q))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_matches_brute_force_with_skewed_norms(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    rows = []
    for i in range(1500):
        v = base[i % 40] + 0.05 * rng.normal(size=8)
        rows.append((i, [float(x) for x in v * rng.lognormal(0, 1)]))
    rows += [(2000 + i, rows[i][1]) for i in range(60)]  # ties
    rows += [(3000, None), (3050, [None] * 8), (3100, [float("nan")] * 8), (3150, [float("inf")] * 8), (None, [1.0] * 8), (3200, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(norm_topk, "BUCKET_ROWS", 64)
    got = sorted(tuple(r) for r in top_k(df, df.where("vec_id % 50 = 0"), 5, block=16).collect())
    assert got == brute(rows, 5)


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(df, df, 5).count() == 0
    one = spark.createDataFrame([(50, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert top_k(one, one, 5).count() == 0


def test_huge_components_saturate(spark):
    rows = [(50, [1e18, 1.0]), (1, [3e17, 2.0]), (2, [-1e18, 0.0]), (3, [1.0, 1.0]), (4, [2e-3, 0.0]), (100, [5e14, -5e14]), (5, [4e14, 1e3])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    most = (1 << 63) - 1
    floor = {i: [max(-most - 1, min(most, math.floor(x * 256))) for x in v] for i, v in rows}
    want = []
    for q in (50, 100):
        scored = sorted((-max(-most, min(most, sum(a * b for a, b in zip(floor[q], floor[c], strict=True)))), c) for c in floor if c != q)
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:5])]
    got = sorted(tuple(r) for r in top_k(df, df.where("vec_id % 50 = 0"), 5).select("query_id", "rank", "vec_id", "score").collect())
    assert got == sorted(want)


def test_many_rounds_and_two_vectors_of_one_id(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(0, 400, 2)] + [(50, [9.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(norm_topk, "ROUND", 2)
    got = top_k(df, df.where("vec_id % 2 = 0"), 3, block=20).collect()
    ok = [(i, np.floor(np.array(v) * 256).astype(int)) for i, v in rows]
    want = {}
    for q, a in ok:
        want.setdefault(q, []).extend((-int(a @ b), i) for i, b in ok if i != q)
    assert sorted(tuple(r) for r in got) == sorted((q, r + 1, i, -s) for q, x in want.items() for r, (s, i) in enumerate(sorted(x)[:3]))


def test_query_columns(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)], 1) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = norm_topk.op5_query(spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert got.count() == 15
