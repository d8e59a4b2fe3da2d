import itertools
import random

from pyspark.sql import functions as F

from folioforge.functions import signatures as S
from folioforge.operators import actions, classify, exact, index, near, runs
from folioforge.operators.components import connected_components


def test_page_indices(spark):
    df = spark.createDataFrame([(n,) for n in (0, 5, 12, 13, 20, 100)], "n int")
    got = {r.n: r.p for r in df.select("n", S.page_indices(F.col("n"), 12).alias("p")).collect()}
    assert got[0] == [] and got[5] == list(range(5)) and got[12] == list(range(12))
    assert got[13] == list(range(1, 11))
    assert got[20] == [2, 3, 4, 6, 7, 8, 10, 11, 12, 14, 15, 17]
    assert got[100] == [10, 17, 24, 31, 38, 45, 53, 60, 67, 74, 81, 89]
    assert [r.p for r in df.select(S.page_indices(F.col("n"), 1).alias("p")).collect()] == [[], [2], [6], [6], [10], [50]]


def test_hash_text(spark):
    df = spark.createDataFrame([(0,), (-1,), (1 << 40,), (-(1 << 63),)], "h long")
    rows = df.select("h", S.hash_to_hex(F.col("h")).alias("x")).withColumn("back", S.hex_to_hash(F.col("x"))).collect()
    assert all(r.h == r.back and len(r.x) == 16 for r in rows)


def test_set_distance_is_asymmetric(spark):
    def d(a, b):
        df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
        return tuple(df.select(S.set_distance(F.col("a"), F.col("b")).alias("d")).first().d)

    assert d([0], [1, 255]) == (1.0, 1.0)
    assert d([0, 0], [0, 65535]) == (0.0, 1.0)
    assert d([0, 65535], [0, 0]) == (8.0, 0.5)
    assert d([], [1]) == (float("inf"), 0.0)
    assert d([-1], [0]) == (64.0, 0.0)


def test_runs_break_at_gaps_and_repeats(spark):
    rows = [("a", n, i) for i, n in enumerate([1, 1, 2, 4, 5, 6, 9])] + [("b", 3, 0), ("b", 4, 1), ("b", 4, 2), ("b", 5, 3)]
    df = spark.createDataFrame(rows, "k string, n long, ord int")
    got = sorted(tuple(r) for r in runs.contiguous_runs(df, ["k"], "n", "ord").select("k", "start", "end", "n").collect())
    assert got == [("a", 1, 2, 2), ("a", 4, 6, 3), ("b", 3, 4, 2), ("b", 4, 5, 2)]


def test_merge_groups(spark):
    names = ["m_ep_1", "m_ep_2", "M_ep_3", "m_ep_4", "x 1", "x 3", "y_episode_1to2"]
    df = spark.createDataFrame([(p, n, i) for p in ("/a", "/b") for i, n in enumerate(names)], "parent string, name string, ord int")
    got = sorted((r.parent, r.merged_name, r.n) for r in runs.merge_groups(df, "parent", "name", "ord").collect())
    assert got == [("/a", "M_Ep_1To2", 2), ("/b", "M_Ep_1To2", 2)]


def works(spark, rows):
    return spark.createDataFrame(rows, "ord int, pages int, signature array<long>")


def test_candidates_equal_nested_loop(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 0, *range(1, 40)]), [rng.getrandbits(16)]) for i in range(80)]
    monkeypatch.setattr(near, "BROADCAST_WORKS", 3)
    got = sorted((r.ord_a, r.ord_b) for r in near.candidate_pairs(works(spark, rows), 5).collect())
    want = [(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] == 0 or b[1] == 0 or abs(a[1] - b[1]) <= 5]
    assert got == sorted(want)


def test_near_groups_are_transitive(spark):
    far = (1 << 40) - 1
    rows = [(1, 10, [0]), (2, 12, [0b1111111111]), (3, 15, [0xFFFFF]), (4, 11, [far]), (5, 0, [far]), (6, 30, []), (7, 10, [])]
    got = sorted(tuple(r) for r in near.near_groups(works(spark, rows), threshold=10).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]


def test_banded_pairs(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(63) for _ in range(20)]
    rows = [(i, base[i % 20] ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60))) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, h long")
    edges = near.banded_pairs(df, "k", "h", 4)
    got = {tuple(r) for r in connected_components(edges, "a", "b").collect()}
    plain = spark.createDataFrame([(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if (x ^ y).bit_count() <= 4] or [(0, 0)], "src int, dst int")
    assert got == {tuple(r) for r in connected_components(plain).collect()}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 400)] + [(500, 500), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "src int, dst int")
    assert {tuple(r) for r in connected_components(df).collect()} == {(x, find(x)) for x in parent}
    assert connected_components(df.limit(0)).count() == 0


def test_exact_keeper_and_quality(spark):
    df = spark.createDataFrame([("a (2).cbz", "x"), ("a.cbz", "x"), ("b copy.cbz", "x"), ("n", None), ("m", None), ("z", "y")], "path string, digest string")
    kept = exact.exact_keeper(df, "digest", F.col("path"), F.col("path"))
    assert {(r.path, r.is_keeper, r.n) for r in kept.collect()} == {("a (2).cbz", False, 3), ("a.cbz", True, 3), ("b copy.cbz", False, 3)}
    left = exact.survivors(df, kept.where("not is_keeper"), "path")
    assert {r.path for r in left.collect()} == {"a.cbz", "n", "m", "z"}
    q = spark.createDataFrame([("g", "b", 5, None, None, 9), ("g", "A", 5, None, None, 9), ("g", "c", 4, 9, 9, 99)], "g string, path string, pages int, w int, h int, size long")
    ranked = exact.quality_rank(q, "g", "pages", "w", "h", "size", "path")
    assert [r.path for r in ranked.orderBy("rank").collect()] == ["A", "b", "c"]
    chosen = exact.choose(ranked, spark.createDataFrame([("g", 3)], "g string, rank int"), "g")
    assert [r.path for r in chosen.where("is_keeper").collect()] == ["c"]


def test_folder_digest_needs_every_page(spark):
    rows = [("w", "10.jpg", b"b"), ("w", "2.jpg", b"a"), ("v", "1.jpg", None), ("v", "2.jpg", b"a")]
    df = spark.createDataFrame(rows, "work string, name string, content binary")
    import hashlib

    want = hashlib.sha256("".join(n + hashlib.sha256(c).hexdigest() for n, c in (("2.jpg", b"a"), ("10.jpg", b"b"))).encode()).hexdigest()
    assert {tuple(r) for r in exact.folder_digest(df, "work", "name", "content").collect()} == {("w", want, 2), ("v", None, 2)}


def test_suggestions(spark):
    rows = [(i, "A", [i % 2]) for i in range(5)] + [(10 + i, "B", [(1 << 12) - 1]) for i in range(3)] + [(20, "C", [0]), (21, "C", [0])]
    known = classify.profiles(spark.createDataFrame(rows, "k int, creator string, s array<long>"), "creator", "s", 3)
    un = spark.createDataFrame([(1, [0]), (2, [-1]), (3, [])], "path int, s array<long>")
    got = classify.suggestions(classify.scores(un, "path", "s", known), "path").collect()
    assert [(r.path, r.creator, r.avg_distance, r.sample_count, r.margin, r.confidence) for r in got] == [(1, "A", 0.0, 5, 12.0, "high")]
    only = classify.suggestions(classify.scores(un, "path", "s", known.where("creator = 'A'")), "path").collect()
    assert only[0].margin == float("inf")


def test_unique_names(spark):
    wanted = spark.createDataFrame([("/p", "a", 1), ("/p", "a", 2), ("/p", "b", 3), ("/q", "a", 4)], "parent string, name string, ord int")
    taken = spark.createDataFrame([("/p", "a"), ("/p", "a__4")], "parent string, name string")
    got = {(r.parent, r.name, r.ord): r.free_name for r in exact.unique_names(wanted, taken, "parent", "name", "ord").collect()}
    assert got[("/p", "b", 3)] == "b" and got[("/q", "a", 4)] == "a"
    assert len({got[("/p", "a", 1)], got[("/p", "a", 2)], "a", "a__4"}) == 4


def test_index_round_trip(spark, tmp_path):
    store = index.SnapshotStore(spark, f"file://{tmp_path}/index")
    assert store.load().count() == 0
    cols = "path string, content_fingerprint string, exact_hash string, exact_fp string, page_count int"
    store.save(index.upsert(store.load(), spark.createDataFrame([("a", "f1", "h", "f1", 3), ("b", "f1", "k", "f1", 0)], cols), "path"))
    store.save(index.upsert(store.load(), spark.createDataFrame([("a", "f2", None, None, None), ("c", "f9", None, None, 1)], cols), "path"))
    now = {r.path: r for r in store.load().collect()}
    assert now["a"].content_fingerprint == "f2" and now["a"].page_count == 3 and set(now) == {"a", "b", "c"}
    found = spark.createDataFrame([("a", "f2"), ("b", "f1"), ("d", "x")], "path string, fp string")
    hits = {r.path: (r.is_hit, r.cached) for r in index.lookup(found, store.load(), "path", "fp", "exact_hash", "exact_fp").collect()}
    assert hits["a"] == (False, None)  # the old hash was made from another fingerprint
    assert hits["b"] == (True, "k") and hits["d"][1] is None
    kept, removed = index.prune(store.load(), found, "path")
    assert {r.path for r in kept.collect()} == {"a", "b"} and removed.first().removed == 1
    assert store.load(rebuild=True).count() == 0
    assert index.remove(store.load(), found, "path").count() == 1


def test_trash_and_merge(spark, tmp_path):
    root, trash = tmp_path / "lib", tmp_path / "trash"
    (root / "s").mkdir(parents=True)
    places = []
    for _ in range(3):
        (root / "a.cbz").write_bytes(b"12345")
        plan = spark.createDataFrame([("exact", "g", "trash", str(root / "a.cbz"), None, 5, "accept")], "phase string, group_id string, kind string, src string, dst string, bytes long, decision string")
        assert actions.apply_trash(plan, str(trash), str(root)) == 0
        assert actions.apply_trash(plan, str(trash), str(root), dry_run=False) == 5
        places = sorted(p.name for p in trash.iterdir())
    assert places == ["a.cbz", "a__1.cbz", "a__1__2.cbz"]
    assert actions.report(plan).first().bytes_reclaimed == 5
    for k in (1, 2):
        (root / f"m {k}").mkdir()
        (root / f"m {k}" / "1.jpg").write_bytes(bytes([k]))
    assert actions.apply_merge([str(root / "m 2"), str(root / "m 1")], [2, 1], str(root / "m"), str(trash), str(root))
    assert sorted(p.name for p in (root / "m").iterdir()) == ["e01_1.jpg", "e02_1.jpg"] and not (root / "m 1").exists()


def test_numbered_is_a_global_order(spark):
    from folioforge.operators.ordering import numbered

    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(1000)) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, k string, v long").repartition(4)
    want, total = {}, 0
    for n, (i, _, v) in enumerate(sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[2], r[0])), 1):
        total += v
        want[i] = (n, total)
    for one in (True, False):
        got = numbered(df, [F.col("k").isNull(), F.col("k"), F.col("v"), F.col("i")], "place", {"v": "upto"}, one_task=one)
        assert {r.i: (r.place, r.upto) for r in got.collect()} == want
    assert numbered(df.limit(0), [F.col("v")], "place").count() == 0


def _random_works(spark, n, seed):
    rng = random.Random(seed)
    seeds = [rng.getrandbits(64) - (1 << 63) for _ in range(n // 3)]

    def signature():
        first = rng.choice(seeds)
        return [None if rng.random() < 0.03 else first ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for _ in range(rng.choice([1, 2, 2, 3, 0]))]

    rows = [(i, rng.choice([0, None, *range(1, 60)]), signature()) for i in range(n)]
    return spark.createDataFrame(rows, "ord long, pages int, signature array<long>")


def test_links_of_blocks_connect_what_all_pairs_connect(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_WORKS", 7)
    df = _random_works(spark, 150, 4).where("pages is not null").cache()
    pairs = near.near_pairs(df, threshold=4, good=3)
    expected = {tuple(r) for r in connected_components(pairs, "ord_a", "ord_b").collect()}
    assert len(expected) > 50
    assert {tuple(r) for r in near.near_groups(df, threshold=4, good=3).collect()} == expected


def test_near_works_send_a_tree_and_no_row_for_each_pair(spark):
    df = spark.range(3000).select(F.col("id").alias("ord"), F.lit(10).alias("pages"), F.array(F.lit(5).cast("long")).alias("signature"))
    assert near.near_links(df).count() < 5 * 3000 < near.near_pairs(df.where("ord < 300")).count()
    assert [tuple(r) for r in near.near_groups(df).groupBy("group_id").count().collect()] == [(0, 3000)]


def test_components_of_few_and_of_many_edges_agree(spark, monkeypatch):
    rng = random.Random(8)
    df = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(220)], "src long, dst long").cache()
    few = {tuple(r) for r in connected_components(df).collect()}
    monkeypatch.setattr("folioforge.operators.components.FEW_EDGES", 0)
    assert few == {tuple(r) for r in connected_components(df).collect()}
