import io
import json
import struct
import zipfile
import zlib

import numpy as np
from pyspark.sql import functions as F

from folioforge.operators import index
from folioforge.sources import archives, index_json, tree
from folioforge.streaming.ingest import index_stream


def png(width, height):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    body = b"".join(b"\0" + bytes(range(width)) for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_tree(spark, tmp_path):
    for name in [".hidden/a.jpg", "_under/a.jpg", "ok/_b.jpg", "ok/._a.jpg", "ok/Thumbs.db", "ok/in.cbz", "ok/deep/c.jpg", "x/__MACOSX/a.jpg", "A.CBZ", "t/x.txt"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    (tmp_path / "link").symlink_to(tmp_path / "ok")
    entries = tree.list_tree(spark, str(tmp_path))
    found = {r.path.removeprefix(str(tmp_path)): (r.kind, r.n_pages) for r in tree.works(entries).collect()}
    assert found == {"/_under": ("folder", 1), "/ok": ("folder", 1), "/A.CBZ": ("archive", None)}
    needs = {r["name"]: r.needs_pages for r in tree.needs_page_conversion(tree.works(entries), tree.folder_pages(entries)).collect()}
    assert needs == {"_under": True, "ok": True, "A.CBZ": True}
    assert tree.list_tree(spark, str(tmp_path / "missing")).count() == 0


def test_archive_pages(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for n, w in (("2.png", 4), ("10.png", 7), ("__MACOSX/1.png", 1), ("x.txt", 1), ("._3.png", 1)):
            z.writestr(n, png(w, 3))
    df = spark.createDataFrame([("a.cbz", data.getvalue()), ("broken.cbz", b"no zip")], "path string, content binary")
    pages = archives.archive_pages(df)
    assert [(r.page_no, r.page_name, r.width, r.height) for r in pages.orderBy("page_no").collect()] == [(0, "10.png", 7, 3), (1, "2.png", 4, 3)]
    assert [tuple(r) for r in archives.metadata(pages).collect()] == [("a.cbz", 2, 7, 3)]


def test_perceptual_hash_is_stable():
    rng = np.random.default_rng(0)
    image = rng.random((60, 80)).cumsum(0).cumsum(1)
    a, b, c = (archives.perceptual_hash(x) for x in (image, image * 3 + 1, rng.random((60, 80))))
    assert a == b and ((a ^ c) & (1 << 64) - 1).bit_count() > 8


def test_index_import(spark, tmp_path):
    record = {"path": "/r/a", "exact_hash": "h", "content_fingerprint": "f", "perceptual_hashes": ["ffffffffffffffff", "0000000000000001"], "odd": 1}
    good = {"version": 1, "root": "/r", "updated_at": "2024-01-01T00:00:00+00:00", "comics": {"/r/a": record}}
    for name, doc in (("good", good), ("version", good | {"version": 2}), ("root", good | {"root": "/x"})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "broken.json").write_text("{")
    row = index_json.read_index(spark, f"{tmp_path}/good.json", "/r").first()
    assert row.perceptual_hashes == [-1, 1] and row.exact_fp == "f" and row.page_count == 0 and row.kind == "archive"
    for name in ("version", "root", "broken"):
        assert index_json.read_index(spark, f"{tmp_path}/{name}.json", "/r").count() == 0


def test_stream_appends_to_index(spark, tmp_path):
    lib = tmp_path / "lib"
    lib.mkdir()
    store = index.SnapshotStore(spark, f"file://{tmp_path}/index")
    store.save(spark.createDataFrame([("/old", "archive", 4)], "path string, kind string, page_count int").select(*[F.col(c.name) if c.name in ("path", "kind", "page_count") else F.lit(None).cast(c.dataType).alias(c.name) for c in index.SCHEMA]))
    for n, name in enumerate(("1.cbz", "2.ZIP", "3.txt")):
        (lib / name).write_bytes(b"x" * (n + 1))
        index_stream(spark, str(lib), store, str(tmp_path / "cp")).awaitTermination()
    rows = {r.path.rsplit("/", 1)[-1]: r for r in store.load().collect()}
    assert set(rows) == {"old", "1.cbz", "2.ZIP"} and rows["1.cbz"].exact_hash and rows["old"].page_count == 4
    path = rows["1.cbz"].path
    store.append(spark.createDataFrame([(path, 7)], "path string, page_count int"), 90)
    store.append(spark.createDataFrame([(path, 8)], "path string, page_count int"), 91)
    store.append(spark.createDataFrame([(path, 9)], "path string, page_count int"), 91)  # again
    now = store.load().where(F.col("path") == path).first()
    assert now.page_count == 9 and now.exact_hash == rows["1.cbz"].exact_hash
    store.compact()
    assert store.load().count() == 3 and store.load().where(F.col("path") == path).first().page_count == 9
