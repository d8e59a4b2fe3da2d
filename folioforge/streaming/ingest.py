"""Continuous index upkeep: new files arrive as a stream, each micro-batch is appended to the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.exact import file_digest
from ..operators.index import SnapshotStore

#: Archives and documents in small or capital letters.
ARCHIVES = "*.{[cC][bB][zZ],[cC][bB][rR],[zZ][iI][pP],[pP][dD][fF],[eE][pP][uU][bB]}"
BINARY = "path string, modificationTime timestamp, length long, content binary"


def index_stream(spark: SparkSession, root: str, store: SnapshotStore, checkpoint: str, pattern: str = ARCHIVES) -> StreamingQuery:
    """Digest files as they appear and append their records to the index, batch by batch.

    A batch writes its own records only; one that is run again replaces what it wrote. `store.compact()`
    folds the batches into a snapshot now and then.
    """
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    size, time = F.col("length").cast("string"), F.col("modificationTime").cast("string")
    fingerprint = F.sha2(F.concat_ws(":", F.lit("file"), size, time), 256)
    rows = files.select("path", F.lit("archive").alias("kind"), fingerprint.alias("quick_fingerprint"), fingerprint.alias("content_fingerprint"), file_digest(F.col("content")).alias("exact_hash"), fingerprint.alias("exact_fp"), F.col("modificationTime").alias("updated_at"))

    def apply(batch: DataFrame, number: int) -> None:
        store.append(batch, number)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
