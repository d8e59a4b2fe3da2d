"""Import and export of an index kept as one JSON document {version, root, updated_at, comics: {path: record}}."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.signatures import hash_to_hex, hex_to_hash
from ..operators.index import SCHEMA, replace

VERSION = 1
_RECORD = (
    "struct<path:string,kind:string,quick_fingerprint:string,content_fingerprint:string,exact_hash:string,page_count:int,"
    "width:int,height:int,perceptual_hashes:array<string>,perceptual_num_pages:int,updated_at:string>"
)


def read_index(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Rows of the index; none if the document is broken or of another version or root.

    Missing fields get their defaults, unknown ones are ignored; derived values are taken to belong
    to the record's content fingerprint.
    """
    schema = f"version int, root string, comics map<string,{_RECORD}>"
    doc = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = doc.where((F.col("version") == VERSION) & (F.col("root") == root) & F.col("comics").isNotNull()).select(F.explode("comics").alias("key", "r"))
    hashes = F.transform(F.coalesce("r.perceptual_hashes", F.array().cast("array<string>")), hex_to_hash)
    return rows.where("r.path is not null").select(
        F.col("r.path").alias("path"),
        F.coalesce("r.kind", F.lit("archive")).alias("kind"),
        F.coalesce("r.quick_fingerprint", F.lit("")).alias("quick_fingerprint"),
        F.coalesce("r.content_fingerprint", F.lit("")).alias("content_fingerprint"),
        F.col("r.exact_hash").alias("exact_hash"),
        F.when(F.col("r.exact_hash").isNotNull(), F.col("r.content_fingerprint")).alias("exact_fp"),
        F.coalesce("r.page_count", F.lit(0)).alias("page_count"),
        F.col("r.width").alias("width"),
        F.col("r.height").alias("height"),
        hashes.alias("perceptual_hashes"),
        F.when(F.size(hashes) > 0, F.col("r.content_fingerprint")).alias("signature_fp"),
        F.coalesce("r.perceptual_num_pages", F.lit(12)).alias("perceptual_num_pages"),
        F.try_to_timestamp("r.updated_at").alias("updated_at"),
    ).select(*SCHEMA.names)


_FIELDS = ["path", "kind", "quick_fingerprint", "content_fingerprint", "exact_hash", "page_count", "width", "height", "perceptual_hashes", "perceptual_num_pages", "updated_at"]


def write_index(index: DataFrame, path: str, root: str) -> None:
    """Write the index as one JSON document that `read_index` reads, records sorted by path.

    The document is streamed record by record to a file beside it, which then replaces it in one step:
    readers see the old or the new index, never a part. An exact hash is written only if it belongs to
    the record's content.
    """
    spark = index.sparkSession
    hashes = F.transform(F.coalesce("perceptual_hashes", F.array().cast("array<bigint>")), hash_to_hex)
    own = index.withColumn("exact_hash", F.when(F.col("exact_fp").eqNullSafe(F.col("content_fingerprint")), F.col("exact_hash"))).withColumn("perceptual_hashes", hashes)
    stamp = F.date_format(F.to_utc_timestamp("updated_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    record = F.to_json(F.struct(*[F.col(c) for c in _FIELDS]), {"ignoreNullFields": "false"})
    lines = own.withColumn("updated_at", stamp).select("path", F.concat(F.to_json(F.array("path")), F.lit("\n"), record).alias("line")).orderBy("path")
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path
    files = hadoop_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(hadoop_path(f"{path}.tmp"), True)
    now = datetime.now(timezone.utc).isoformat()
    out.write(bytearray(f'{{"version": {VERSION}, "root": {json.dumps(root)}, "updated_at": "{now}", "comics": {{'.encode()))
    for k, row in enumerate(lines.toLocalIterator()):
        key, text = row.line.split("\n", 1)
        out.write(bytearray(("," if k else "").encode() + key[1:-1].encode() + b": " + text.encode()))
    out.write(bytearray(b"}}\n"))
    out.close()
    replace(spark, f"{path}.tmp", path)
