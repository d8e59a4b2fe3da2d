"""Brings this package to the Python workers where their path does not already have it, and names the shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def work_folder(spark: SparkSession) -> str:
    """The shared folder for tables between steps, which is also made the checkpoint folder.

    It is spark.checkpoint.dir, or the checkpoint folder that was set, or a folder in the warehouse,
    which executors share. Only a session of one machine (master local[...]) gets a temporary folder.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not found:
        alone = re.fullmatch(r"local(\[[^\]]*\])?", context.master)
        found = "file://" + tempfile.mkdtemp(prefix="folioforge-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_folioforge_work"
    if not held.isDefined():
        context.setCheckpointDir(found)
    return found


#: Bytes of rows that Python stages get at a time, where the session leaves Spark's own 64 MB: texts may be long.
BATCH_BYTES = "4m"


def ship(spark: SparkSession) -> None:
    """Send the package's files to the executors, once for each application, and bound the batches of Python stages."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64m") in ("67108864b", "64m"):
        spark.conf.set(key, BATCH_BYTES)
    package = Path(__file__).resolve().parent
    context = spark.sparkContext
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if context.applicationId in _shipped or str(package.parent) in paths or not package.is_dir():
        return
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="folioforge-")), "folioforge.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
