"""Standardising works on disk: pages to one format within a size budget, archives to folders, names.

An encoder is a function (image bytes, scale) -> bytes, or None where the image can't be read; the
default one makes WebP and needs an image library. Pages are converted as rows, by any executor that
sees the library's files; folders are renamed and archives moved to the trash by the driver, which
does the same work for one folder at a time in `standardise`. A source goes to the trash only after
its result is complete.
"""

from __future__ import annotations

import contextlib
import os
import shutil
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

from ..shipping import ship
from ..sources.archives import document_pages, encode_webp
from ..sources.tree import ARCHIVE_SUFFIXES, JUNK_NAMES, PAGE_SUFFIXES
from .actions import trash_path

TARGET = ".webp"
#: Smallest linear scale, and how often the interval of scales is halved.
LEAST_SCALE, HALVINGS = 0.05, 5

Encoder = Callable[[bytes, float], bytes | None]


def fit_budget(encode: Callable[[float], bytes], most: int) -> tuple[float, bytes] | None:
    """The scale and bytes of an image that fits `most` bytes, None if none was found.

    Full size comes first. Else the search halves the scales between the least one and the one at which
    the area would shrink to 95 % (squared) of the budget; sizes are taken to grow with the scale.
    """
    full = encode(1.0)
    if len(full) <= most:
        return 1.0, full
    low, data = LEAST_SCALE, encode(LEAST_SCALE)
    if len(data) > most:
        return None
    high = max(LEAST_SCALE, min(1.0, (most / len(full)) ** 0.5 * 0.95))
    for _ in range(HALVINGS):
        middle = (low + high) / 2
        tried = encode(middle)
        if len(tried) <= most:
            low, data = middle, tried
        else:
            high = middle
    return low, data


def page_budget_bytes(original: int, cap_mb: float = 0.0, ratio: float = 2.0) -> int:
    """Most bytes of a converted page, as the column function of the same rule has it."""
    limits = ([max(int(original * ratio), 1024)] if original > 0 else []) + ([max(int(cap_mb * (1 << 20)), 1024)] if cap_mb > 0 else [])
    return min(limits) if limits else 512 << 10


def converted_bytes(data: bytes, encode: Encoder = encode_webp, cap_mb: float = 0.0) -> bytes | None:
    """A page in the target format: at full size, or within its budget where a cap is set."""
    first = encode(data, 1.0)
    if first is None:
        return None
    if cap_mb <= 0:
        return first
    fitted = fit_budget(lambda scale: first if scale >= 0.999 else encode(data, scale), page_budget_bytes(len(data), cap_mb))
    return fitted[1] if fitted else None


def is_page_file(path: Path) -> bool:
    return path.is_file() and path.suffix.lower() in PAGE_SUFFIXES and not path.name.startswith((".", "._")) and path.name.lower() not in JUNK_NAMES


def free_path(folder: Path, name: str, joint: str = "_") -> Path:
    """A path that does not exist: the name, or its stem with the first free number from 2."""
    target, k = folder / name, 2
    while target.exists():
        target = folder / f"{Path(name).stem}{joint}{k}{Path(name).suffix}"
        k += 1
    return target


def free_folder(parent: Path, name: str, own: Path | None = None) -> Path:
    """A folder that does not exist, or is `own`: the name, or the name with the first free number from 2."""
    target, k = parent / name, 2
    while target.exists() and not (own is not None and target.resolve() == own.resolve()):
        target = parent / f"{name}__{k}"
        k += 1
    return target


def _write_whole(target: Path, data: bytes) -> None:
    part = target.with_name(f".{target.name}.part")
    part.write_bytes(data)
    os.replace(part, target)


def _convert(encode: Encoder, cap_mb: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name in frame["path"]:
                page, written = Path(name), None
                if page.suffix.lower() != TARGET:
                    with contextlib.suppress(OSError):
                        data = converted_bytes(page.read_bytes(), encode, cap_mb)
                        if data:
                            target = page.with_suffix(TARGET)
                            # A page of that name which is not this one's result stays: the result gets a number.
                            target = target if not target.exists() or target.read_bytes() == data else free_path(page.parent, target.name)
                            _write_whole(target, data)
                            written = str(target)
                rows.append((name, written, written is not None or page.suffix.lower() == TARGET))
            yield pd.DataFrame(rows, columns=["path", "written", "ok"])

    return run


def convert_pages(pages: DataFrame, encode: Encoder = encode_webp, cap_mb: float = 0.0) -> DataFrame:
    """(path, written, ok) of pages (path): each is written beside its source, in parallel; sources stay.

    A task that runs again finds its own result and leaves it. Pages in the target format are left.
    """
    ship(pages.sparkSession)
    return pages.select("path").mapInPandas(_convert(encode, cap_mb), "path string, written string, ok boolean")


def extract_archive(archive: Path, target: Path, encode: Encoder = encode_webp, cap_mb: float = 0.0) -> list[Path]:
    """Pages of an archive or document as a folder in the target format; nothing is left if a page fails."""
    staging = target.with_name(f".{target.name}.part")
    shutil.rmtree(staging, ignore_errors=True)
    staging.mkdir(parents=True)
    written = []
    for name, data in document_pages(archive.name, archive.read_bytes()):
        done = data if name.lower().endswith(TARGET) else converted_bytes(data, encode, cap_mb)
        if done is None:
            written = []
            break
        page = free_path(staging, Path(name.replace("\\", "/")).stem + TARGET)
        page.write_bytes(done)
        written.append(target / page.name)
    if not written:
        shutil.rmtree(staging)
        return []
    os.replace(staging, target)
    return written


def to_trash(path: Path, trash: Path, root: Path | None) -> Path:
    target = trash_path(path, trash, root)
    target.parent.mkdir(parents=True, exist_ok=True)
    shutil.move(path, target)
    return target


def rename_folder(folder: Path, name: str) -> Path:
    """Rename a folder; a name that is taken gets a number, a change of case alone goes over a third name."""
    if folder.name == name:
        return folder
    target = free_folder(folder.parent, name, own=folder)
    if target.exists():  # the same folder on a file system that ignores case
        between = free_folder(folder.parent, f".{folder.name}.renamed")
        folder.rename(between)
        between.rename(target)
    else:
        folder.rename(target)
    return target


def standardise(source: str, name: str, trash: str, root: str | None = None, encode: Encoder = encode_webp, cap_mb: float = 0.0, keep_originals: bool = False) -> Path | None:
    """Bring one work to its standard form: a folder of pages in the target format under its standard name.

    Returns the folder, or None if the source is missing, no work, or a page failed (then it stays as it is).
    """
    path, bin_, top = Path(source), Path(trash), Path(root) if root else None
    if path.is_dir():
        pages = sorted(p for p in path.iterdir() if is_page_file(p))
        if not pages:
            return None
        done = []
        for page in pages:
            if page.suffix.lower() == TARGET:
                continue
            data = converted_bytes(page.read_bytes(), encode, cap_mb)
            if data is None:
                for target, _ in done:
                    target.unlink()
                return None
            target = free_path(path, page.stem + TARGET)
            _write_whole(target, data)
            done.append((target, page))
        for _, page in done if not keep_originals else []:
            to_trash(page, bin_, top)
        return rename_folder(path, name)
    if path.is_file() and path.suffix.lower() in ARCHIVE_SUFFIXES:
        target = free_folder(path.parent, name)
        if not extract_archive(path, target, encode, cap_mb):
            return None
        if not keep_originals:
            to_trash(path, bin_, top)
        return target
    return None
