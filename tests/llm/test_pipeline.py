import random

import corpus_pipeline
from folioforge.llm.bfd_packing import default_tokenizer
from folioforge.llm.lsh_forest import near_duplicates

from .test_models import text


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for i in range(80):
        lang = rng.choice(["en", "de", "fr"])
        rows.append((i, text(rng, lang, 60), lang, f"src{i % 3}"))
    rows += [(100 + i, rows[i][1].upper() if rows[i][2] == "en" else rows[i][1], rows[i][2], "src0") for i in range(10)]  # exact copies
    rows += [(200 + i, rows[20 + i][1] + " more words", rows[20 + i][2], "src1") for i in range(10)]  # near copies
    rows += [(300, "123 !!", None, "src2"), (301, None, "en", None)]
    docs = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids.append({r.doc_id for r in docs.collect()})
    assert ids[0] == {i for i, *_ in rows} - {300, 301}
    assert ids[1] == ids[0] - set(range(10))
    classes = {r.doc_id: r.class_id for r in near_duplicates(spark.read.parquet(f"{tmp_path}/1")).collect()}
    assert ids[2] == set(classes.values()) == ids[1] - set(range(200, 210))
    assert ids[3] <= ids[2] and ids[4] == ids[3]
    assert default_tokenizer().endswith("word_bpe_49k.json")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
