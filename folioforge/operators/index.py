"""The incremental index: a table of derived values, each with the fingerprint it was made from.

Values carry the fingerprint of their own (exact_fp, signature_fp), so a refreshed fingerprint never
makes an old value look valid. Snapshots are immutable Parquet folders and a pointer to the latest.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("kind", T.StringType()),
    T.StructField("quick_fingerprint", T.StringType()),
    T.StructField("content_fingerprint", T.StringType()),
    T.StructField("exact_hash", T.StringType()),
    T.StructField("exact_fp", T.StringType()),
    T.StructField("page_count", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("perceptual_hashes", T.ArrayType(T.LongType())),
    T.StructField("signature_fp", T.StringType()),
    T.StructField("perceptual_num_pages", T.IntegerType()),
    T.StructField("updated_at", T.TimestampType()),
])


def lookup(works: DataFrame, index: DataFrame, key: str, fingerprint: str, value: str, value_fp: str) -> DataFrame:
    """Works with `cached` (the value, if it was made from the work's present fingerprint) and `is_hit`."""
    known = index.select(key, F.col(value).alias("_value"), F.col(value_fp).alias("_fp"))
    hit = F.col("_fp").isNotNull() & (F.col("_fp") == F.col(fingerprint)) & F.col("_value").isNotNull()
    return works.join(known, key, "left").withColumn("is_hit", hit).withColumn("cached", F.when(hit, F.col("_value"))).drop("_value", "_fp")


def metadata_hit(works: DataFrame, index: DataFrame, key: str, fingerprint: str) -> DataFrame:
    known = index.select(key, F.col("quick_fingerprint").alias("_fp"), F.col("page_count").alias("_pages"))
    hit = (F.col("_fp") == F.col(fingerprint)) & (F.col("_pages") > 0)
    return works.join(known, key, "left").withColumn("is_hit", F.coalesce(hit, F.lit(False))).drop("_fp", "_pages")


def signature_hit(num_pages: int):
    return (F.col("perceptual_num_pages") == num_pages) & (F.size("perceptual_hashes") > 0)


def upsert(index: DataFrame, changes: DataFrame, key: str, stamp: Column | None = None) -> DataFrame:
    """Insert new keys and patch known ones; a null in a change keeps the old value.

    Several changes of one key count as one: of each field the largest value that is not null. A
    `stamp` is what updated_at becomes for the keys that changed (such as `current_timestamp()`).
    """
    changes = changes.groupBy(key).agg(*[F.max(c).alias(c) for c in changes.columns if c != key])
    if stamp is not None:
        changes = changes.withColumn("updated_at", stamp)
    old, new = index.alias("o"), changes.alias("n")
    columns = []
    for c in index.columns:
        if c == key:
            columns.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        elif c in changes.columns:
            columns.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        else:
            columns.append(F.col(f"o.{c}").alias(c))
    return old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*columns)


def cached_paths(index: DataFrame, key: str = "path") -> DataFrame:
    """The works that the index knows, each once."""
    return index.select(key).distinct()


def ensure_metadata(works: DataFrame, index: DataFrame, found: DataFrame, key: str, fingerprint: str, force: bool = False) -> DataFrame:
    """(key, quick_fingerprint, page_count, width, height, is_hit) of all works.

    A work whose quick fingerprint is that of its record, and whose record has pages, keeps its
    record. All others get what was `found` (key, page_count, width, height), and where that is
    missing or without pages what the record had.
    """
    old = index.select(key, F.col("quick_fingerprint").alias("_fp"), *[F.col(c).alias(f"_old_{c}") for c in ("page_count", "width", "height")])
    new = found.select(key, *[F.col(c).alias(f"_new_{c}") for c in ("page_count", "width", "height")])
    hit = F.lit(not force) & F.coalesce((F.col("_fp") == F.col(fingerprint)) & (F.col("_old_page_count") > 0), F.lit(False))
    rows = works.select(key, fingerprint).join(old, key, "left").join(new, key, "left").withColumn("is_hit", hit)
    pages = F.coalesce(F.when(F.col("_new_page_count") > 0, F.col("_new_page_count")), F.col("_old_page_count"), F.lit(0))
    side = lambda c: F.when(F.col("is_hit"), F.col(f"_old_{c}")).otherwise(F.coalesce(f"_new_{c}", f"_old_{c}")).alias(c)
    return rows.select(key, F.col(fingerprint).alias("quick_fingerprint"), F.when(F.col("is_hit"), F.col("_old_page_count")).otherwise(pages).alias("page_count"), side("width"), side("height"), "is_hit")


def remove(index: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return index.join(gone.select(key).distinct(), key, "left_anti")


def prune(index: DataFrame, discovered: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The index of discovered works, and a one-row table of how many rows were removed."""
    kept = index.join(discovered.select(key).distinct(), key, "left_semi")
    counts = index.agg(F.count(F.lit(1)).alias("before")).join(kept.agg(F.count(F.lit(1)).alias("after")), F.lit(True))
    return kept, counts.select((F.col("before") - F.col("after")).alias("removed"))


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file over another in one step, so that a reader sees the one or the other."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    where = path(target).getFileSystem(conf).makeQualified(path(target))
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf).rename(path(source), path(target), options)


class SnapshotStore:
    """Snapshots and later changes under one folder; a pointer names the snapshot that counts.

    Changes that were appended after it count on top of it, the latest value of each field that is not
    null first, until `compact` writes a new snapshot. Any Hadoop path will do.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _latest(self) -> str | None:
        pointer = self._path(f"{self.root}/LATEST")
        if not self._fs.exists(pointer):
            return None
        rows = self.spark.read.text(f"{self.root}/LATEST").collect()  # one line
        return rows[0].value if rows else None

    def load(self, rebuild: bool = False) -> DataFrame:
        """The latest snapshot; an empty index if there never was one, or `rebuild` is set.

        A pointer to a snapshot that is not there, or was not finished, raises ValueError.
        """
        name = None if rebuild else self._latest()
        if name is not None and not self._fs.exists(self._path(f"{self.root}/{name}/_SUCCESS")):
            raise ValueError(f"{self.root}/LATEST names {name}, which is not a finished snapshot; load with rebuild=True to start anew")
        base = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/{name}") if name is not None else self.spark.createDataFrame([], SCHEMA)
        deltas = [] if rebuild else [d for d in self._deltas() if d > (name or "")]
        if not deltas:
            return base
        rows = None
        for k, delta in enumerate(deltas):
            part = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/{delta}").withColumn("_n", F.lit(k))
            rows = part if rows is None else rows.unionByName(part)
        latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_n"))).alias(c) for c in SCHEMA.names if c != "path"]
        return upsert(base, rows.groupBy("path").agg(*latest), "path")

    def _deltas(self) -> list[str]:
        """Names of finished changes in order; they sort after the snapshot that they follow."""
        folder = self._path(f"{self.root}")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(n for n in names if "+" in n and self._fs.exists(self._path(f"{self.root}/{n}/_SUCCESS")))

    def append(self, changes: DataFrame, batch: int) -> str:
        """Write changes (path and any other fields) of a numbered batch; a batch that comes again replaces itself."""
        for c in SCHEMA.fields:
            if c.name not in changes.columns:
                changes = changes.withColumn(c.name, F.lit(None).cast(c.dataType))
        name = f"{self._latest() or 'snapshot-0'}+{batch:012d}"
        changes.select(*SCHEMA.names).write.mode("overwrite").parquet(f"{self.root}/{name}")
        return name

    def compact(self) -> str:
        """One new snapshot of the present state; older folders stay for readers that still use them."""
        return self.save(self.load())

    def save(self, index: DataFrame) -> str:
        name = f"snapshot-{time.time_ns()}"
        index.write.parquet(f"{self.root}/{name}")
        stream = self._fs.create(self._path(f"{self.root}/LATEST.new"), True)
        stream.write(bytearray(name.encode()))
        stream.close()
        replace(self.spark, f"{self.root}/LATEST.new", f"{self.root}/LATEST")
        return name
