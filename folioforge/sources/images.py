"""Pages decoded by Spark's own image reader: sizes and perceptual hashes of folders' pages without an image library.

The JVM reads JPEG, PNG, GIF and BMP files; what it can't read (WebP among others) gives no row here and
counts as a page that can't be decoded. PNG members of archives are decoded by `png_grey`.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.signatures import page_indices
from ..shipping import ship


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """(path, width, height, channels, data) of the images under a folder that can be decoded."""
    ship(spark)
    found = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(root).select("image.*")
    path = F.url_decode(F.regexp_replace(F.regexp_replace("origin", r"\+", "%2B"), "^file:(//)?", ""))
    return found.select(path.alias("path"), "width", "height", F.col("nChannels").alias("channels"), "data")


def grey_values(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Brightness of pixels that come as blue, green, red (and alpha), or as one value."""
    pixels = np.frombuffer(data, np.uint8)[: width * height * channels].reshape(height, width, channels).astype(float)
    return pixels[:, :, 0] if channels == 1 else pixels[:, :, :3] @ np.array([0.114, 0.587, 0.299])


def _hash_pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .archives import perceptual_hash

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("data", "width", "height", "channels")]
        hashes = [perceptual_hash(grey_values(*row)) for row in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("width"), batch.column("height"), pa.array(hashes, pa.int64())], names=["path", "width", "height", "phash"])


def hashed_images(images: DataFrame) -> DataFrame:
    """(path, width, height, phash) of decoded images."""
    return images.mapInArrow(_hash_pixels, "path string, width int, height int, phash long")


def folder_signatures(pages: DataFrame, images: DataFrame, num_pages: int = 12) -> DataFrame:
    """(work, page_count, signature): hashes of the sampled pages of each folder in the order of pages.

    `pages` has (work, path, page_no). Sampled pages that can't be decoded are left out; a work without any
    has an empty signature.
    """
    counted = pages.groupBy("work").agg(F.count(F.lit(1)).cast("int").alias("page_count"))
    wanted = counted.select("work", "page_count", F.explode_outer(page_indices(F.col("page_count"), num_pages)).alias("page_no"))
    picked = wanted.join(pages.select("work", "page_no", "path"), ["work", "page_no"])
    hashed = hashed_images(images.join(picked.select("path"), "path", "left_semi")).select("path", "phash")
    rows = picked.join(hashed, "path", "left").groupBy("work", "page_count")
    found = rows.agg(F.array_sort(F.collect_list(F.when(F.col("phash").isNotNull(), F.struct("page_no", "phash")))).alias("p"))  # num_pages at most
    return found.select("work", "page_count", F.transform("p", lambda x: x["phash"]).alias("signature"))


def png_grey(data: bytes) -> np.ndarray | None:
    """Brightness of a PNG with 8 bits a channel and without interlacing; None for others."""
    if data[:8] != b"\x89PNG\r\n\x1a\n" or len(data) < 33:
        return None
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", data[16:29])
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlaced or channels is None:
        return None
    at, packed, palette = 8, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed += data[at + 8 : at + 8 + size]
        elif kind == b"PLTE":
            palette = np.frombuffer(data[at + 8 : at + 8 + size], np.uint8).reshape(-1, 3)
        at += size + 12
    try:
        raw = np.frombuffer(zlib.decompress(packed), np.uint8)[: height * (width * channels + 1)].reshape(height, -1)
    except (zlib.error, ValueError):
        return None
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.uint8)
    for y in range(height):
        out[y] = above = _unfiltered(int(raw[y, 0]), raw[y, 1:], above, channels)
    pixels = out.reshape(height, width, channels)
    if palette is not None and colour == 3:
        pixels = palette[np.minimum(pixels[:, :, 0], len(palette) - 1)]
    colours = pixels.astype(float)
    return colours[:, :, 0] if colours.shape[2] < 3 else colours[:, :, :3] @ np.array([0.299, 0.587, 0.114])


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, channels: int) -> np.ndarray:
    """A row of bytes from its difference to the left, upper, mean or Paeth neighbour (PNG specification, 9.2)."""
    if kind == 0:
        return row.copy()
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, channels), axis=0, dtype=np.uint8).reshape(-1)
    out = np.zeros(len(row) + channels, np.int64)
    up = np.concatenate([np.zeros(channels, np.int64), above.astype(np.int64)])
    for i, value in enumerate(row.tolist(), channels):
        left, high, corner = out[i - channels], up[i], up[i - channels]
        if kind == 3:
            guess = (left + high) // 2
        else:
            near = left + high - corner
            guess = min((left, high, corner), key=lambda n, p=near: abs(p - n))
        out[i] = (value + guess) & 255
    return out[channels:].astype(np.uint8)
