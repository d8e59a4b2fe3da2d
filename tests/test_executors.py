"""Names without collision, the index, scans, documents and what changes files."""

import io
import json
import random
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.operators import actions, convert, exact, index, runs
from folioforge.sources import archives, events, images, index_json, tree

from .test_sources import png


def fake(data, scale):
    """An encoder of images: the size shrinks with the area; what starts with `bad` can't be read."""
    return None if data.startswith(b"bad") else b"W" * max(1, round(len(data) * scale * scale))


def brute_names(wanted, taken):
    used = set(taken) | {(p, n) for p, n, _ in wanted}
    given, seen = {}, set(taken)
    for p, n, k in sorted(wanted, key=lambda w: w[2]):
        if (p, n) not in seen:
            given[p, n, k] = n
            seen.add((p, n))
            continue
        j = 2
        while (p, f"{n}__{j}") in used or (p, f"{n}__{j}") in seen:
            j += 1
        given[p, n, k] = f"{n}__{j}"
        seen.add((p, f"{n}__{j}"))
    return given


def test_unique_names_take_the_first_free_number(spark):
    rng = random.Random(5)
    names = ["a", "a__2", "a__3", "a__7", "b", "a__2__2", "c.d", "a__02"]
    wanted = [(rng.choice(["/p", "/q"]), rng.choice(names), k) for k in range(200)] + [("/r", "a", 900), ("/r", "a", 901), ("/r", "a__2", 902), ("/s", "a", 903)]
    taken = [("/p", "a"), ("/p", "a__4"), ("/p", "a__3__2"), ("/q", "b__2"), ("/q", "b__3"), ("/q", "a__02"), ("/s", "a"), ("/s", "a__5"), ("/t", "z")]
    frame = spark.createDataFrame(wanted, "parent string, name string, ord int")
    known = spark.createDataFrame(taken, "parent string, name string")
    got = {(r.parent, r.name, r.ord): r.free_name for r in exact.unique_names(frame, known, "parent", "name", "ord").collect()}
    assert got == brute_names(wanted, taken)
    assert got["/s", "a", 903] == "a__2" and [got["/r", n, k] for n, k in (("a", 900), ("a", 901), ("a__2", 902))] == ["a", "a__3", "a__2"]
    assert len({(p, x) for (p, _, _), x in got.items()} | set(taken)) == len(wanted) + len(taken)
    assert exact.unique_names(frame.limit(0), known, "parent", "name", "ord").count() == 0


def test_index_changes_and_damage(spark, tmp_path):
    cols = "path string, quick_fingerprint string, page_count int, width int, height int, updated_at timestamp"
    old = spark.createDataFrame([("a", "f", 3, 10, 20, None), ("b", "f", 0, 1, 2, None), ("c", "f", 4, None, None, None)], cols)
    changes = spark.createDataFrame([("a", 5), ("a", 7), ("a", None), ("d", 1)], "path string, page_count int")
    now = F.lit("2024-01-02 03:04:05").cast("timestamp")
    got = {r.path: r for r in index.upsert(old, changes, "path", now).collect()}
    assert len(got) == 4 and got["a"].page_count == 7 and got["a"].updated_at is not None and got["b"].updated_at is None and got["d"].page_count == 1
    assert {r.path for r in index.cached_paths(old).collect()} == {"a", "b", "c"}
    works = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "new"), ("e", "x"), ("g", "x")], "path string, fp string")
    found = spark.createDataFrame([("a", 9, 9, 9), ("b", 2, None, 8), ("c", 0, None, None), ("e", 6, 7, 8)], "path string, page_count int, width int, height int")
    rows = {r.path: tuple(r)[2:] for r in index.ensure_metadata(works, old, found, "path", "fp").collect()}
    assert rows == {"a": (3, 10, 20, True), "b": (2, 1, 8, False), "c": (4, None, None, False), "e": (6, 7, 8, False), "g": (0, None, None, False)}
    forced = {r.path: r.page_count for r in index.ensure_metadata(works, old, found, "path", "fp", force=True).collect()}
    assert forced["a"] == 9
    store = index.SnapshotStore(spark, f"file://{tmp_path}/store")
    store.save(old)
    name = store.save(old.limit(1))
    assert store.load().count() == 1 and not (tmp_path / "store/LATEST.new").exists()
    (tmp_path / "store" / name / "_SUCCESS").unlink()
    with pytest.raises(ValueError):
        store.load()
    assert store.load(rebuild=True).count() == 0


def test_index_document_round_trip(spark, tmp_path):
    rows = [("/l/b \"q\"", "folder", "q", "c", "h", "c", 3, 4, None, [-1, 1], "c", 12, None), ("/l/a", "archive", "q", "c", "old", "before", 0, None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, index.SCHEMA).withColumn("updated_at", F.lit("2024-05-06 07:08:09").cast("timestamp"))
    path = f"{tmp_path}/index.json"
    for _ in range(2):  # the second replaces the first
        index_json.write_index(frame, f"file://{path}", "/l")
    doc = json.loads((tmp_path / "index.json").read_text())
    assert doc["version"] == 1 and doc["root"] == "/l" and list(doc["comics"]) == ["/l/a", '/l/b "q"']
    assert doc["comics"]["/l/a"]["exact_hash"] is None and doc["comics"]['/l/b "q"']["perceptual_hashes"] == ["f" * 16, "0" * 15 + "1"]
    assert doc["comics"]["/l/a"]["updated_at"] == "2024-05-06T07:08:09.000000+00:00"
    back = {r.path: r for r in index_json.read_index(spark, path, "/l").collect()}
    assert back['/l/b "q"'].perceptual_hashes == [-1, 1] and back['/l/b "q"'].exact_hash == "h" and back["/l/a"].exact_hash is None


def make_tree(root):
    for name in ["x/1.png", "x/10.png", "x/2.png", "deep/er/y/1.webp", "deep/er/z.cbz", "x/sub/3.png", ".h/1.png", "n/t.txt"]:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(png(5, 4) if name.endswith("png") else b"1")


def test_scan_by_levels(spark, tmp_path):
    make_tree(tmp_path)
    entries, cached = tree.scan(spark, str(tmp_path))
    whole = {tuple(r) for r in tree.works(tree.list_tree(spark, str(tmp_path))).collect()}
    assert {tuple(r) for r in tree.works(entries).collect()} == whole and len(whole) == 3 and cached.count() == 0
    assert not any("/x/sub" in r.path and r.name == "3.png" for r in entries.collect())  # below a work
    stamp = (tmp_path / "x").stat().st_mtime_ns
    now = exact.quick_fingerprint(F.lit("folder"), F.lit(None), F.col("m"))
    known = spark.createDataFrame([(str(tmp_path / "x"), "folder", stamp, 3), (str(tmp_path / "deep/er/y"), "folder", 5, 1)], "path string, kind string, m long, page_count int").withColumn("quick_fingerprint", now)
    entries, cached = tree.scan(spark, str(tmp_path), known)
    assert [tuple(r) for r in cached.collect()] == [(str(tmp_path / "x"), 3)]  # unchanged: not listed; the other one is stale
    assert {r.path for r in tree.works(entries).collect()} == {r[0] for r in whole} - {str(tmp_path / "x")}
    assert tree.scan(spark, str(tmp_path / "missing"))[0].count() == 0


def test_folder_metadata_in_natural_order(spark, tmp_path):
    make_tree(tmp_path)
    (tmp_path / "x/1.png").write_bytes(png(7, 9))
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken/1.jpg").write_bytes(b"no image")
    pages = tree.folder_pages(tree.list_tree(spark, str(tmp_path)))
    got = {r.work.removeprefix(str(tmp_path)): (r.page_count, r.width, r.height) for r in archives.folder_metadata(pages).collect()}
    assert got["/x"] == (3, 7, 9) and got["/broken"] == (1, None, None)
    order = tree.numbered_pages(pages).where(F.col("work") == str(tmp_path / "x")).orderBy("page_no").collect()
    assert [(r.page_no, r["name"]) for r in order] == [(0, "1.png"), (1, "2.png"), (2, "10.png")]


def webp(kind, body):
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(body)) + b"WEBP" + kind + struct.pack("<I", len(body)) + body + b"\0" * 20


def test_dimensions_of_webp():
    assert archives.dimensions(webp(b"VP8X", b"\0" * 4 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"))) == (100, 50)
    assert archives.dimensions(webp(b"VP8L", b"\x2f" + ((299) | (199 << 14)).to_bytes(4, "little"))) == (300, 200)
    assert archives.dimensions(webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 640, 480))) == (640, 480)


def test_documents(spark):
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        for n in ("OEBPS/b.png", "OEBPS/a.png", "mimetype", "OEBPS/text.xhtml"):
            z.writestr(n, png(3, 2))
    jpeg = b"\xff\xd8\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 20) + b"\x03" * 11 + b"\xff\xd9"
    pdf = b"%PDF-1.4\n1 0 obj\n<< /Type /XObject /Subtype /Image /Filter /DCTDecode /DecodeParms << /K 1 >> /Length 5 >>\nstream\n" + jpeg + b"\nendstream\nendobj\n2 0 obj << /Filter /FlateDecode >>\nstream\nxx\nendstream"
    frame = spark.createDataFrame([("b.epub", book.getvalue()), ("p.PDF", pdf), ("r.cbr", b"Rar!"), ("e.pdf", b"")], "path string, content binary")
    got = {(r.work, r.page_no): (r.page_name, r.width, r.height) for r in archives.archive_pages(frame).collect()}
    assert got == {("b.epub", 0): ("OEBPS/a.png", 3, 2), ("b.epub", 1): ("OEBPS/b.png", 3, 2), ("p.PDF", 0): ("page_1.jpg", 20, 30)}


def test_budget_search():
    sizes = []

    def encode(scale):
        sizes.append(scale)
        return b"x" * int(10_000 * scale * scale)

    scale, data = convert.fit_budget(encode, 2500)
    assert len(data) <= 2500 and 0.45 < scale <= 0.5 and len(sizes) == 2 + convert.HALVINGS
    assert convert.fit_budget(encode, 10_000) == (1.0, b"x" * 10_000)
    assert convert.fit_budget(encode, 3) is None
    assert convert.page_budget_bytes(0) == 512 << 10 and convert.page_budget_bytes(100) == 1024 and convert.page_budget_bytes(10_000, 0.01) == 10_485
    assert convert.converted_bytes(b"x" * 100_000, fake, 0.02) is not None and convert.converted_bytes(b"bad", fake) is None


def test_pages_are_converted_in_tasks(spark, tmp_path):
    for name, data in (("1.jpg", b"one"), ("2.webp", b"two"), ("3.png", b"bad"), ("4.gif", b"four"), ("4.webp", b"other")):
        (tmp_path / name).write_bytes(data)
    pages = spark.createDataFrame([(str(tmp_path / n),) for n in ("1.jpg", "2.webp", "3.png", "4.gif", "gone.jpg")], "path string")
    for _ in range(2):  # a second run of a task changes nothing more
        got = {r.path.rsplit("/", 1)[-1]: (r.written and r.written.rsplit("/", 1)[-1], r.ok) for r in convert.convert_pages(pages, fake).collect()}
        assert got["1.jpg"] == ("1.webp", True) and got["2.webp"] == (None, True) and got["3.png"] == got["gone.jpg"] == (None, False)
    assert (tmp_path / "4.webp").read_bytes() == b"other" and (tmp_path / "4_2.webp").read_bytes() == b"WWWW"


def plan(spark, rows):
    return spark.createDataFrame(rows, "phase string, group_id string, kind string, src string, dst string, bytes long, decision string")


def test_apply_whole_plan(spark, tmp_path):
    lib, trash = tmp_path / "lib", tmp_path / "trash"
    for name, data in (("dup.cbz", b"1"), ("Art Book/2.jpg", b"two"), ("Art Book/10.webp", b"ten"), ("bad/1.jpg", b"bad"), ("s 1/1.webp", b"a"), ("s 2/1.webp", b"b"), ("s 2/10.webp", b"c"), ("S 1to2/x.webp", b"z"), ("solo/1.webp", b"q"), ("kept.cbz", b"k")):
        (lib / name).parent.mkdir(parents=True, exist_ok=True)
        (lib / name).write_bytes(data)
    with zipfile.ZipFile(lib / "zip.cbz", "w") as z:
        z.writestr("a/1.png", b"first")
        z.writestr("b/1.png", b"second")
    actions_ = plan(spark, [
        ("exact", "g", "trash", str(lib / "dup.cbz"), None, 1, "accept"), ("exact", "g", "keep", str(lib / "kept.cbz"), None, 1, "accept"),
        ("near", "h", "trash", str(lib / "kept.cbz"), None, 1, "skip"), ("near", "h", "trash", str(lib / "missing.cbz"), None, 1, "accept"),
        ("standardise", None, "convert", str(lib / "Art Book"), "Art [Book]", 0, "accept"), ("standardise", None, "convert", str(lib / "bad"), "Bad", 0, "accept"),
        ("standardise", None, "convert", str(lib / "zip.cbz"), "Zip", 0, "accept"),
        ("merge", "1", "merge", str(lib / "s 2"), "S 1to2", 2, "accept"), ("merge", "1", "merge", str(lib / "s 1"), "S 1to2", 1, "accept"),
        ("creator", "C", "rename", str(lib / "solo"), "[C] solo", 0, "accept"),
    ])
    assert {x[2] for x in actions.apply(actions_, str(trash), str(lib))} == {"would"} and (lib / "dup.cbz").exists()
    done = {(p, s.rsplit("/", 1)[-1]): o for p, s, o in actions.apply(actions_, str(trash), str(lib), dry_run=False, encode=fake)}
    assert {k for k, o in done.items() if o == "failed"} == {("near", "missing.cbz"), ("standardise", "bad")}
    assert sorted(p.name for p in lib.iterdir()) == ["Art [Book]", "S 1to2", "S 1to2__2", "Zip", "[C] solo", "bad", "kept.cbz"]
    assert sorted(p.name for p in (lib / "Art [Book]").iterdir()) == ["10.webp", "2.webp"] and sorted(p.name for p in (lib / "Zip").iterdir()) == ["1.webp", "1_2.webp"]
    assert sorted(p.name for p in (lib / "S 1to2__2").iterdir()) == ["e01_1.webp", "e02_1.webp", "e02_10.webp"]
    assert (lib / "bad/1.jpg").read_bytes() == b"bad" and not (lib / "bad/1.webp").exists()
    assert (trash / "dup.cbz").exists() and (trash / "Art Book/2.jpg").exists() and (trash / "zip.cbz").exists() and (trash / "s 1").is_dir()


def test_merge_rolls_back(tmp_path, monkeypatch):
    for k in (1, 2):
        (tmp_path / f"m {k}").mkdir()
        (tmp_path / f"m {k}/1.jpg").write_bytes(b"1")
    moves = []

    def move(a, b, real=actions.shutil.move):
        moves.append(a)
        if len(moves) == 2:
            raise OSError("disk")
        return real(a, b)

    monkeypatch.setattr(actions.shutil, "move", move)
    assert not actions.apply_merge([str(tmp_path / "m 1"), str(tmp_path / "m 2")], [1, 2], str(tmp_path / "M"), str(tmp_path / "trash"))
    assert (tmp_path / "m 1/1.jpg").exists() and (tmp_path / "m 2/1.jpg").exists() and not (tmp_path / "M").exists()


def test_merge_members_follow_runs(spark):
    names = ["m_ep_1", "m_ep_1", "m_ep_2", "m_ep_4", "m_ep_5", "m_ep_5", "m_ep_6", "x 1"]
    df = spark.createDataFrame([("/a", n, i, f"/a/{i}") for i, n in enumerate(names)], "parent string, name string, ord int, path string")
    got = sorted((r.place, r.episode, r.folder) for r in runs.merge_members(df, "parent", "name", "ord", "path").collect())
    assert got == [(1, 1, "/a/1"), (1, 2, "/a/2"), (2, 4, "/a/3"), (2, 5, "/a/4"), (3, 5, "/a/5"), (3, 6, "/a/6")]
    planned = actions.merge_actions(runs.merge_members(df, "parent", "name", "ord", "path"))
    total = actions.report(planned, df).first()
    assert total.merged == 3 and total.discovered == 8 and total.suggestions == 0


def test_log(spark, tmp_path):
    rows = [("warning", "a.b", "two\nlines"), ("info", "a", None)]
    frame = spark.createDataFrame(rows, "level string, name string, message string").withColumn("time", F.lit("2024-05-06 07:08:09.5").cast("timestamp"))
    for _ in range(2):
        events.write_log(frame, str(tmp_path / "log"))
    assert sorted({r.value for r in spark.read.text(str(tmp_path / "log")).collect()}) == ["2024-05-06 07:08:09 [INFO] a: ", "2024-05-06 07:08:09 [WARNING] a.b: two lines"]
    assert spark.read.text(str(tmp_path / "log")).count() == 4


def filtered_png(pixels, colour, kinds):
    """A PNG whose rows use the given filters in turn."""
    import zlib

    height, width, channels = pixels.shape

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    body, above = b"", np.zeros(width * channels, int)
    for y in range(height):
        row, kind = pixels[y].reshape(-1).astype(int), kinds[y % len(kinds)]
        left = np.concatenate([np.zeros(channels, int), row[:-channels]])
        corner = np.concatenate([np.zeros(channels, int), above[:-channels]])
        near = left + above - corner
        order = np.stack([abs(near - left), abs(near - above), abs(near - corner)])
        guess = [0 * row, left, above, (left + above) // 2, np.choose(order.argmin(0), [left, above, corner])][kind]
        body += bytes([kind]) + bytes(((row - guess) % 256).tolist())
        above = row
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour,channels", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png_decoder(colour, channels):
    pixels = np.random.default_rng(colour).integers(0, 256, (23, 17, channels)).astype(np.uint8)
    got = images.png_grey(filtered_png(pixels, colour, [0, 1, 2, 3, 4]))
    want = pixels[:, :, 0] if channels < 3 else pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114])
    assert np.allclose(got, want)
    assert images.png_grey(b"no image") is None and images.png_grey(filtered_png(pixels, colour, [0])[:60]) is None


def test_signatures_of_folders(spark, tmp_path):
    rng = np.random.default_rng(3)
    pages = [rng.integers(0, 256, (8, 8, 1)).repeat(6, 0).repeat(6, 1).astype(np.uint8) for _ in range(15)]
    for work, shift in (("a b+c", 0), ("copy", 3)):
        (tmp_path / work).mkdir()
        for k, p in enumerate(pages):
            (tmp_path / work / f"{k + 1}.png").write_bytes(filtered_png(np.clip(p.astype(int) + shift, 0, 255).astype(np.uint8), 0, [4]))
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken/1.png").write_bytes(b"x")
    numbered = tree.numbered_pages(tree.folder_pages(tree.list_tree(spark, str(tmp_path))))
    found = images.read_images(spark, str(tmp_path))
    assert {r.path for r in found.collect()} == {str(p) for p in tmp_path.rglob("*.png")} - {str(tmp_path / "broken/1.png")}
    got = {r.work.rsplit("/", 1)[-1]: r for r in images.folder_signatures(numbered, found, 5).collect()}
    assert len(got["a b+c"].signature) == 5 and got["a b+c"].page_count == 15 and got["broken"].signature == []
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 6 for a, b in zip(got["a b+c"].signature, got["copy"].signature, strict=True))
    # Spark's reader and our own decoder agree.
    one = (tmp_path / "copy/3.png").read_bytes()
    mine = archives.perceptual_hash(images.png_grey(one))
    assert images.hashed_images(found).where(F.col("path") == str(tmp_path / "copy/3.png")).first().phash == mine
