"""A directory tree as a table: by a Python data source, one partition per top-level entry, or level by level.

Unlike Spark's own file listing it keeps names that start with `_`, skips those that start with `.`,
never follows symbolic links, and reports modification times in nanoseconds.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import natural_key, suffix
from ..operators.exact import quick_fingerprint
from ..shipping import ship, work_folder

SCHEMA = "path string, parent string, name string, is_dir boolean, length long, mtime_ns long"

# Suffixes of pages and of archives, names that operating systems leave behind.
PAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".webp", ".gif", ".bmp", ".tif", ".tiff"]
ARCHIVE_SUFFIXES = [".cbz", ".cbr", ".zip", ".pdf", ".epub"]
JUNK_NAMES = [".ds_store", "desktop.ini", "thumbs.db", "ehthumbs.db", "ehthumbs_vista.db"]


class _Entry(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class TreeReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        if not os.path.isdir(self.root):
            return [_Entry("", False)]
        inside = [e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and not e.name.startswith(".")]
        return [_Entry(self.root, False), *(_Entry(p, True) for p in sorted(inside))]

    def read(self, partition: _Entry) -> Iterator[tuple]:
        stack = [partition.path] if partition.path else []
        while stack:
            folder = stack.pop()
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                if e.name.startswith(".") or e.is_symlink():
                    continue
                is_dir = e.is_dir(follow_symlinks=False)
                try:
                    stat = e.stat(follow_symlinks=False)
                except OSError:
                    continue
                yield e.path, folder, e.name, is_dir, 0 if is_dir else stat.st_size, stat.st_mtime_ns
                if is_dir and partition.deep:
                    stack.append(e.path)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folio_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(str(Path(self.options["path"]).absolute()))


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """All visible entries under a folder; a missing root gives no rows."""
    ship(spark)
    spark.dataSource.register(TreeSource)
    return spark.read.format("folio_tree").option("path", root).load()


def _listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "parent", "name", "is_dir", "length", "mtime_ns"]
    for frame in frames:
        rows = [row for folder in frame["path"] for row in TreeReader("").read(_Entry(folder, False))]
        yield pd.DataFrame(rows, columns=columns)


def scan(spark: SparkSession, root: str, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries of the tree as `list_tree` has them, and the works that were taken from the index.

    The tree is listed level by level, each level's folders in parallel however deep they lie. A folder
    that the index knows as a work, with the quick fingerprint it has now, is not listed at all: it is
    returned as (path, page_count). The inside of folders with pages is not listed either.
    """
    ship(spark)
    work_folder(spark)
    top = Path(root).absolute()
    start = [(str(top), top.stat().st_mtime_ns)] if top.is_dir() else []
    level = spark.createDataFrame(start, "path string, mtime_ns long")
    known = None
    if index is not None:
        known = index.where("kind = 'folder'").select("path", F.col("quick_fingerprint").alias("_known"), "page_count")
    entries = spark.createDataFrame([], SCHEMA)
    cached = spark.createDataFrame([], "path string, page_count int")
    while level.limit(1).count():
        if known is not None:
            now = quick_fingerprint(F.lit("folder"), F.lit(None), F.col("mtime_ns"))
            seen = level.join(known, "path").where(F.col("_known") == now).select("path", F.col("page_count").cast("int").alias("page_count")).checkpoint()
            cached = cached.unionByName(seen)
            level = level.join(seen.select("path"), "path", "left_anti")
        found = level.repartition("path").select("path").mapInPandas(_listed, SCHEMA).checkpoint()
        entries = entries.unionByName(found)
        with_pages = found.where(~F.col("is_dir") & is_page(F.col("path"), F.col("name"))).select("parent").distinct()
        level = found.where("is_dir").join(with_pages, "parent", "left_anti").select("path", "mtime_ns")
    return entries, cached


def is_junk(path: Column, name: Column) -> Column:
    return name.startswith("._") | F.lower(name).isin(JUNK_NAMES) | path.contains("/__MACOSX/") | path.startswith("__MACOSX/")


def is_page(path: Column, name: Column) -> Column:
    return suffix(name).isin(PAGE_SUFFIXES) & ~is_junk(path, name)


def works(entries: DataFrame) -> DataFrame:
    """(path, kind, parent, name, n_pages, size): folders with pages of their own, and archives.

    The inside of a folder with pages is not looked at: works below such a folder do not count.
    """
    files = entries.where(~F.col("is_dir"))
    pages = files.where(is_page(F.col("path"), F.col("name")))
    folders = pages.groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("n_pages"), F.sum("length").alias("size"))
    archives = files.where(suffix(F.col("name")).isin(ARCHIVE_SUFFIXES)).select("path", F.lit(None).cast("long").alias("n_pages"), F.col("length").alias("size"))
    found = folders.withColumn("kind", F.lit("folder")).unionByName(archives.withColumn("kind", F.lit("archive")))
    depth = F.size(F.split("path", "/"))
    above = F.transform(F.sequence(F.lit(1), depth - 1), lambda k: F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/"))
    covered = found.select("path", F.explode(F.when(depth > 1, above).otherwise(F.array())).alias("above")).join(folders.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct()
    kept = found.join(covered, "path", "left_anti")
    return kept.select("path", "kind", F.regexp_replace("path", "/[^/]*$", "").alias("parent"), F.regexp_extract("path", "[^/]*$", 0).alias("name"), "n_pages", "size")


def folder_pages(entries: DataFrame) -> DataFrame:
    """Pages of folders; `numbered_pages` puts them in order."""
    return entries.where(~F.col("is_dir") & is_page(F.col("path"), F.col("name"))).select(F.col("parent").alias("work"), "path", "name", "length", "mtime_ns")


def numbered_pages(pages: DataFrame, work: str = "work", name: str = "name") -> DataFrame:
    """Add page_no, from 0 in the natural order of the names of a work."""
    order = Window.partitionBy(work).orderBy(natural_key(F.col(name)))
    return pages.withColumn("page_no", F.row_number().over(order) - 1)


def needs_page_conversion(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Works with `needs_pages`: an archive, or a folder with a page that is not .webp."""
    other = pages.groupBy(F.col("work").alias("path")).agg(F.max(suffix(F.col("name")) != ".webp").alias("_other"))
    return found.join(other, "path", "left").withColumn("needs_pages", (F.col("kind") == "archive") | F.coalesce("_other", F.lit(False))).drop("_other")
