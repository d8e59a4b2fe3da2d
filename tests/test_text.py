import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as X


def apply(spark, expression, values):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, x string")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


NAMES = {
    "[ARTIST] DUAL LOVE PART [English Version] (digital)": "[artist] Dual Love Part [eng]",
    "【Foo】BAR　baz (2)": "[foo] Bar Baz",
    "title_EP_03": "Title_ep_03",
    "a copy copy b": "A Copy B",
    "1to2 x": "1To2 X",
    "(version)": "(version)",
    "[digital]": "[digital]",
    "a: b?": "A B",
    "foo[xxx汉化]bar": "Foo Bar",
    "foo (broken": "Foo (Broken", "(broken x": "(broken x",
    "Manga（1）": "Manga (1)",
    "don't stop-now": "Don't Stop-now",
    "  spaced   out . ": "Spaced Out",
    "第3话 x 4": "第3话 X 4",
    "dl版 [DL版]": "Dl版",
}


def test_standard_names(spark):
    assert apply(spark, X.standard_name, list(NAMES)) == list(NAMES.values())


def test_title_words(spark):
    assert apply(spark, X.title_word, ["1to2", "'tis", "ÉCOLE", "é", "McDONALD"]) == ["1To2", "'Tis", "ÉCole", "é", "Mcdonald"]


def test_episode_parsing(spark):
    names = ["x_episode_1to2", "A 007", "a_EP_3", "漫画第3话", "Vol-12", "n#5", "plain", "B ２", "x_ep_2_ch_3"]
    got = apply(spark, X.parse_episode, names)
    assert [None if e is None else (e.prefix, e.suffix, e.episode) for e in got] == [
        None, ("A ", "", 7), ("a_EP_", "", 3), ("漫画第", "话", 3), ("Vol-", "", 12), ("n#", "", 5), None, ("B ", "", 2), ("x_ep_2_ch_", "", 3),
    ]


def test_merged_name(spark):
    got = apply(spark, lambda x: X.merged_name(x, F.lit(1), F.lit(2), F.lit("")), ["manga_a_episode_"])
    assert got == ["Manga_A_Episode_1To2"]


def test_creator_tags(spark):
    names = ["[chn][Mori] T", "[Ken] T", "[] [Mori] T", "（Mori） T", "T [Mori]", "[Mori", "  [ Mori ] T"]
    assert apply(spark, X.creator_tag, names) == ["Mori", None, None, "Mori", None, None, "Mori"]
    assert apply(spark, lambda x: X.creator_tag(x, whole_words=True), ["[Ken] T", "[en] T"]) == ["Ken", None]
    assert apply(spark, lambda x: X.tagged_name(x, F.lit("A")), ["[chn] [Mori] T", "[x]"]) == ["[A] T", "[A] [x]"]


def test_natural_order(spark):
    names = ["p10", "P2", "a", "p1", "1.jpg", "p02", "1²3.jpg"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(X.natural_key(F.col("n"))).collect()] == ["1.jpg", "1²3.jpg", "a", "p1", "P2", "p02", "p10"]


def test_sizes(spark):
    df = spark.createDataFrame([(1023,), (1024,), (-1536,), (None,), (5 << 40,)], "n long")
    assert [r.y for r in df.select(X.format_size(F.col("n")).alias("y")).collect()] == ["1023 B", "1.00 KB", "-1.50 KB", "0 B", "5.00 TB"]


def test_cleanliness(spark):
    got = apply(spark, lambda x: X.cleanliness(x, x), ["Vol.1 x", "a (2) copy.cbz", "Duplicate! b.zip", "copyright.cbz"])
    assert [tuple(r)[:3] for r in got] == [(0, 3, 0), (2, 10, 2), (1, 12, 1), (0, 9, 0)]


@pytest.mark.parametrize(("d", "r", "n", "m", "want"), [(8, 0.6, 5, 2.0, "high"), (8, 0.6, 4, 2.0, "medium"), (8, 0.6, 5, 1.4, "low"), (13, 1.0, 9, 9.0, "none"), (12, 0.34, 9, 9.0, "none")])
def test_confidence(spark, d, r, n, m, want):
    row = spark.range(1).select(X.confidence(F.lit(d), F.lit(r), F.lit(n), F.lit(m), 12).alias("c")).first()
    assert row.c == want
