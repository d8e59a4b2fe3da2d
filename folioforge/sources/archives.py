"""Pages of archives, documents and images: members, dimensions, perceptual hashes, WebP output.

Zip archives and EPUB books need the standard library only; the pages of a PDF are the JPEG images
that it embeds, in their order in the file. Rar members and image decoding need packages that may be
missing; such works then get no pages and a null signature.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import natural_key
from ..shipping import ship
from .images import png_grey
from .tree import JUNK_NAMES, PAGE_SUFFIXES

MEMBERS = "work string, page_no int, page_name string, length long, width int, height int, sha256 string, phash long"


def is_member_page(name: str) -> bool:
    clean = name.replace("\\", "/")
    base = clean.rsplit("/", 1)[-1]
    if clean.endswith("/") or base.startswith("._") or base.lower() in JUNK_NAMES or "/__MACOSX/" in f"/{clean}":
        return False
    return "." in base[1:] and "." + base.rsplit(".", 1)[-1].lower() in PAGE_SUFFIXES


def dimensions(data: bytes) -> tuple[int | None, int | None]:
    """Width and height from the header of a PNG, GIF, BMP, JPEG or WebP file."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if data[12:16] == b"VP8L" and data[20] == 0x2F:
            bits = int.from_bytes(data[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        if data[12:16] == b"VP8 " and data[23:26] == b"\x9d\x01\x2a":
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            at += 2 + size
    return None, None


def decode_grey(data: bytes) -> np.ndarray | None:
    """Grey values of an image: of a plain PNG always, of others if an image library is installed and can read it."""
    try:
        from PIL import Image
    except ImportError:
        return png_grey(data)
    try:
        return np.asarray(Image.open(io.BytesIO(data)).convert("L"), float)
    except Exception:  # noqa: BLE001 - any unreadable page is skipped, not its work
        return None


def _shrink(grey: np.ndarray, size: int) -> np.ndarray:
    rows = np.linspace(0, grey.shape[0], size + 1).astype(int)
    cols = np.linspace(0, grey.shape[1], size + 1).astype(int)
    total = np.pad(grey.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    r0, r1 = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1).clip(max=grey.shape[0])
    c0, c1 = cols[:-1], np.maximum(cols[1:], cols[:-1] + 1).clip(max=grey.shape[1])
    box = total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]
    return box / np.maximum(np.outer(r1 - r0, c1 - c0), 1)


def perceptual_hash(grey: np.ndarray, bits: int = 8) -> int:
    """Signs of the lowest frequencies of a 4 bits x 4 bits image against their median (Zauner 2010), as a signed 64-bit number."""
    n = 4 * bits
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (basis @ _shrink(grey, n) @ basis.T)[:bits, :bits]
    flags = (low > np.median(low)).reshape(-1)
    value = int("".join("1" if f else "0" for f in flags), 2)
    return value - (1 << 64) if value >= 1 << 63 else value


def zip_pages(content: bytes) -> list[tuple[str, bytes]]:
    """Readable image members of a zip archive by lower-cased name; none if it is damaged."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, TypeError):
        return []
    pages = []
    for name in sorted((n for n in archive.namelist() if is_member_page(n)), key=str.lower):
        try:
            pages.append((name, archive.read(name)))
        except Exception:  # noqa: BLE001 - an unreadable member is skipped
            continue
    return pages


def rar_pages(content: bytes) -> list[tuple[str, bytes]]:
    """Image members of a rar archive, if a reader is installed."""
    try:
        import rarfile
    except ImportError:
        return []
    try:
        archive = rarfile.RarFile(io.BytesIO(content))
        return [(n, archive.read(n)) for n in sorted((n for n in archive.namelist() if is_member_page(n)), key=str.lower)]
    except (rarfile.Error, OSError):
        return []


_PDF_IMAGE = re.compile(rb"<<(?:[^<>]|<<[^<>]*>>)*/DCTDecode(?:[^<>]|<<[^<>]*>>)*>>\s*stream\r?\n", re.S)


def pdf_pages(content: bytes) -> list[tuple[str, bytes]]:
    """JPEG images that a PDF embeds without further filters, in their order in the file."""
    pages = []
    for found in _PDF_IMAGE.finditer(content):
        end = content.find(b"endstream", found.end())
        data = content[found.end() : end].rstrip(b"\r\n") if end > 0 else b""
        if data[:2] == b"\xff\xd8":
            pages.append((f"page_{len(pages) + 1}.jpg", data))
    return pages


def document_pages(name: str, content: bytes) -> list[tuple[str, bytes]]:
    """(page name, bytes) of an archive or document, by the suffix of its name."""
    kind = name.rsplit(".", 1)[-1].lower()
    return {"cbr": rar_pages, "pdf": pdf_pages}.get(kind, zip_pages)(content)


def _members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    for frame in frames:
        rows = []
        for work, content in zip(frame["path"], frame["content"], strict=True):
            for no, (name, data) in enumerate(document_pages(work, content)):
                grey = decode_grey(data)
                rows.append((work, no, name, len(data), *dimensions(data), hashlib.sha256(data).hexdigest(), None if grey is None else perceptual_hash(grey)))
        out = pd.DataFrame(rows, columns=["work", "page_no", "page_name", "length", "width", "height", "sha256", "phash"])
        yield out.astype({c: "Int64" for c in ("page_no", "length", "width", "height", "phash")})


def archive_pages(files: DataFrame) -> DataFrame:
    """Pages of archives and documents given as (path, content), in the order of `document_pages`."""
    ship(files.sparkSession)
    return files.select("path", "content").mapInPandas(_members, MEMBERS)


@F.pandas_udf(T.LongType())
def phash(content: pd.Series) -> pd.Series:
    """Perceptual hash of an image file; null where it can't be decoded."""
    found = [None if c is None else decode_grey(bytes(c)) for c in content]
    return pd.Series([None if g is None else perceptual_hash(g) for g in found], dtype="Int64")


def metadata(pages: DataFrame) -> DataFrame:
    """(work, page_count, width, height): the size is that of the first page."""
    return pages.groupBy("work").agg(F.count(F.lit(1)).cast("int").alias("page_count"), F.min_by("width", "page_no").alias("width"), F.min_by("height", "page_no").alias("height"))


def encode_webp(data: bytes, scale: float = 1.0, quality: int = 95) -> bytes | None:
    """WebP bytes of an image file at a linear scale, if an image library is installed and can read it."""
    try:
        from PIL import Image
    except ImportError:
        return None
    try:
        image = Image.open(io.BytesIO(data))
        image = image.convert("L" if image.mode in ("1", "L") else "RGB")
        if scale < 0.999:
            image = image.resize([max(1, round(s * scale)) for s in image.size], Image.Resampling.LANCZOS)
        out = io.BytesIO()
        image.save(out, "WEBP", quality=quality, method=6)
    except (OSError, ValueError):
        return None
    return out.getvalue()


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def file_dimensions(path: pd.Series) -> pd.DataFrame:
    """Width and height of image files from their headers; null where a file can't be read."""
    rows = []
    for name in path:
        try:
            with open(name, "rb") as file:
                rows.append(dimensions(file.read()))
        except (OSError, TypeError):
            rows.append((None, None))
    return pd.DataFrame(rows, columns=["width", "height"]).astype("Int32")


def folder_metadata(pages: DataFrame) -> DataFrame:
    """(work, page_count, width, height) of folders from their pages (work, path, name): the first page in natural order has the size."""
    ship(pages.sparkSession)
    counted = pages.groupBy("work").agg(F.count(F.lit(1)).cast("int").alias("page_count"), F.min_by("path", natural_key(F.col("name"))).alias("first"))
    size = file_dimensions(F.col("first"))
    return counted.withColumn("size", size).select("work", "page_count", "size.width", "size.height")
