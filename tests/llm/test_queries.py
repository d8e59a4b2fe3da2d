"""Every registered query of the subpackage over small tables: columns, types, folds, whole results."""

import random
import zlib

import pytest

from folioforge.llm.queries import oracle_sql, queries

from .test_models import text

COLUMNS = {
    "op1": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op3": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op4": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op6": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op7": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op8": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op9": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op10": "doc_id bigint, class_id bigint, class_size bigint, n_links bigint",
}
FOLDS = {"op1": (3, 1), "op4": (5, 0), "op8": (10, 0)}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with copies, ties, nulls, a long text and columns that clash with what operators add."""
    folder = tmp_path_factory.mktemp("tables")
    rng = random.Random(4)
    rows = [(i, text(rng, lang := rng.choice(["en", "de", "fr"]), rng.randint(0, 90)), lang, f"s{i % 4}") for i in range(150)]
    rows += [(200 + i, rows[i][1], rows[i][2], "hot") for i in range(30)]
    rows += [(300, None, "en", None), (301, "", None, "s1"), (302, "1 2 3", "de", "s1"), (303, "long " * 30_000, "en", "s2"), (None, rows[3][1], "en", "s3"), (None, "no id", "en", "s3"), (5, rows[5][1], rows[5][2], "s1")]
    clash = "size long, score double, node long, rank int, task int, text_length int"
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 1, 0.5, 7, 1, 2, 3) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {clash}")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], i % 2, 0) for i, r in enumerate(rows) if i % 3] + [(2, None, 0), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    vectors = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(110)] + [(200, None), (250, [None, 1.0])]
    spark.createDataFrame([(i, v, 1, 9) for i, v in vectors], "vec_id long, embedding array<float>, label int, score int").write.parquet(f"{folder}/embeddings.parquet")
    empty = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    return str(folder), str(empty), rows


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, tables, name):
    folder, empty, rows = tables
    op = name.split("_")[0]
    got = queries()[name](spark, folder)
    want = COLUMNS[op].split(", ")
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema][: len(want)] == want
    found = got.collect()
    if op not in ("op5", "op6"):
        assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in rows)
    if op == "op6":
        assert {r.doc_id for r in found} == {r[0] for r in rows}
    if op in FOLDS:
        n, k = FOLDS[op]
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % n == k) for r in found)
    if op == "op1":
        assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in found)
    assert queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", [n for n in oracle_sql() if n != "op10_lsh_forest_join"])
def test_query_equals_its_sql(spark, tables, name):
    import duckdb

    folder, _, rows = tables
    if name.startswith(("op7", "op9")):
        pytest.skip("its SQL takes ids as unique")
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    frame = queries()[name](spark, folder)
    want = con.sql(oracle_sql()[name])
    columns = sorted(frame.columns)
    assert sorted(want.columns) == columns
    key = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(str, map(key, frame.select(columns).collect()))) == sorted(map(str, map(key, want.select(*columns).fetchall())))
