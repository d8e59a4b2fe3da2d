"""Exact deduplication with a log-structured merge index of content digests.

Memtables (the rows of a group of tasks) are flushed as sorted Parquet runs of (digest, keep_id, n);
each has a Bloom filter of its digests beside it. Compaction merges FAN_IN runs of a level at a time
into one sorted run of the next, with one row per digest that keeps the smallest (or largest)
identifier and adds up the rows, until one run is left. Digests with more than one row are hits. A
filter of the hits is probed with every document: what it excludes is alone in the table and is
neither shuffled nor compared. The bytes of the others are compared, and a hit whose bytes are all
equal takes the identifier that compaction kept. All of it is DataFrame code.

The filters are blocked Bloom filters: a digest chooses a block of 2**15 bits and PROBES bits in it.
A run's filter has about BITS_PER_KEY bits for each digest and 2**MOST_BITS at most (128 MB), so its
size is bounded whatever the input; beyond that it only lets more documents through to the comparison.

Hot digests: every step that meets equal rows aggregates partially in the map tasks, and the final
lookup is an equi-join that adaptive execution can split.

Defined cases: null text counts as empty; a null id ranks below every id; rows that repeat both id
and text are one document to the index and all of them are marked kept (`distinct_rows` leaves one);
very long texts are compared whole; two texts of one digest would be told apart by a second digest;
an empty table gives an empty result. Other columns, also such as `digest` or `id`, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_a_to_z, materialize, shared_path, table

#: Runs that one flush writes, and runs that a compaction merges at a time.
MEMTABLES = 8
FAN_IN = 4
BITS_PER_KEY = 16
MOST_BITS = 30
BLOCK_BITS = 15
PROBES = 3


def normalised(text: Column) -> Column:
    return lower_a_to_z(F.coalesce(text.cast("string"), F.lit("")))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


class BloomFilter:
    """Blocks of 2**15 bits as a small table (block, bits), made and probed without leaving the JVM."""

    def __init__(self, keys: DataFrame, count: int, column: str = "digest"):
        self.blocks = 1 << max(0, min(MOST_BITS, (max(1, count) * BITS_PER_KEY - 1).bit_length()) - BLOCK_BITS)
        places = keys.select(self._block(F.col(column)).alias("_block"), F.explode(F.array(*[self._place(F.col(column), k) for k in range(PROBES)])).alias("_place"))
        # A bitmap's bits are numbered from 0, which is bit 0 of its first byte.
        self.table = materialize(places.groupBy("_block").agg(F.bitmap_construct_agg(F.col("_place")).alias("_bits")))

    def _block(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(self.blocks))

    @staticmethod
    def _place(key: Column, k: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(k + 1)), F.lit(1 << BLOCK_BITS))

    def probe(self, rows: DataFrame, key: Column) -> DataFrame:
        """Add `_maybe`: whether a row's key may be in the filter."""
        rows = rows.withColumn("_block", self._block(key)).join(F.broadcast(self.table), "_block", "left")
        found = F.col("_bits").isNotNull()
        for k in range(PROBES):
            place = self._place(key, k)
            byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            found &= F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1
        return rows.withColumn("_maybe", F.coalesce(found, F.lit(False))).drop("_block", "_bits")


class DigestIndex:
    """Sorted runs of digests by level; `keep` names which identifier of equal texts stays."""

    def __init__(self, spark: SparkSession, keep: str = "min"):
        if keep not in ("min", "max"):
            raise ValueError("keep is 'min' or 'max'")
        self.spark, self.keep = spark, keep
        self.pick = F.min if keep == "min" else F.max
        self.levels: list[list[str]] = [[]]
        self._hits: BloomFilter | None = None

    @property
    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Write the rows of each group of tasks as a sorted run; return the rows (id, digest)."""
        path = shared_path(self.spark, "lsm-memtables")
        memtable = F.pmod(F.spark_partition_id(), F.lit(MEMTABLES)).alias("memtable")
        rows = docs.select(memtable, F.col(id_col).cast("long").alias("id"), digest_of(F.col(text_col)).alias("digest"))
        rows.sortWithinPartitions("memtable", "digest", "id").write.partitionBy("memtable").parquet(path)
        slim = self.spark.read.schema("id long, digest binary, memtable int").parquet(path)
        for m in range(MEMTABLES):
            run = slim.where(F.col("memtable") == m).select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
            self.levels[0].append(run)
        self._hits = None
        return slim.select("id", "digest")

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """One run of several: a row for each digest with the identifier that stays and all rows counted."""
        rows = runs[0]
        for run in runs[1:]:
            rows = rows.unionByName(run)
        path = shared_path(self.spark, "lsm-run")
        merged = rows.groupBy("digest").agg(self.pick("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        merged.sortWithinPartitions("digest").write.parquet(path)
        return self.spark.read.schema("digest binary, keep_id long, n long").parquet(path)

    def compact(self) -> DataFrame:
        """Merge FAN_IN runs at a time, level by level, down to one run."""
        while len(self.runs) > 1:
            level = next(k for k, runs in enumerate(self.levels) if runs)
            runs, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1] += [self._merged(runs[k : k + FAN_IN]) for k in range(0, len(runs), FAN_IN)]
        return self.runs[0]

    def hits(self) -> DataFrame:
        """Digests of more than one row."""
        return self.compact().where("n > 1")

    def filter(self) -> BloomFilter:
        """The filter of all hits."""
        if self._hits is None:
            hits = self.hits()
            self._hits = BloomFilter(hits.select("digest"), hits.count())
        return self._hits

    def verify(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
        """Compare the bytes of all hits: what compaction kept for them, and whether texts clash.

        Without a clash every hit has one text, and the answer is (digest, keep_id, n) of the compacted
        run. If some digest stands for two texts, it has a row for each, told apart by `second`.
        """
        rows = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("_text"))
        rows = rows.withColumn("digest", F.unhex(F.sha2("_text", 256)))
        maybe = self.filter().probe(rows, F.col("digest")).where("_maybe")
        texts = maybe.groupBy("digest", "_text").agg(self.pick("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        seen = materialize(texts.select("digest", "keep_id", "n", _second(F.col("_text")).alias("second")))
        clash = materialize(seen.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"))
        kept = self.hits()
        if not clash.limit(1).count():
            return kept, False
        sound = kept.join(clash, "digest", "left_anti").withColumn("second", F.lit(None).cast("string"))
        return sound.unionByName(seen.join(clash, "digest", "left_semi")), True


def _second(text: Column) -> Column:
    return F.sha2(F.concat(F.lit("second:"), text), 512)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    index = DigestIndex(docs.sparkSession, keep)
    slim = index.flush(docs, id_col, text_col)
    classes, clash = index.verify(docs, id_col, text_col)
    if clash:
        slim = docs.select(F.col(id_col).cast("long").alias("id"), digest_of(F.col(text_col)).alias("digest"), _second(normalised(F.col(text_col))).alias("_own"))
        same = (slim["digest"] == classes["digest"]) & (classes["second"].isNull() | (slim["_own"] == classes["second"]))
        joined = slim.join(classes, same, "left").drop(classes["digest"])
    else:
        joined = slim.join(classes, "digest", "left")
    keep_id = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The input rows that stay, in all their columns; of repeated rows one stays.

    Rows that the filter of hits excludes pass straight through. The others meet by digest and bytes,
    where the row with the identifier that stays is kept; the map tasks leave one row per text before.
    """
    index = DigestIndex(docs.sparkSession, keep)
    index.flush(docs, id_col, text_col)
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_id"), normalised(F.col(text_col)).alias("_text"))
    probed = index.filter().probe(plain.withColumn("_digest", F.unhex(F.sha2("_text", 256))), F.col("_digest"))
    rank = F.struct(F.col("_id").isNotNull().alias("known"), (F.col("_id") if keep == "max" else -F.col("_id")).alias("id"))
    rest = probed.where("_maybe").groupBy("_digest", "_text").agg(F.max_by("_row", rank).alias("_row"))
    return probed.where("not _maybe").select("_row.*").unionByName(rest.select("_row.*"))


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


OP3_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
