"""Scan of source files as they arrive in a folder (Structured Streaming).

The scan of whole files has neither a shuffle nor a window, so it runs on a
stream as it is: files that arrive are rows, and their findings are appended to
a Parquet sink.  The checkpoint remembers which files were read and the sink's
log which of its files count, so a query that fails and starts again scans each
file exactly once.  Progress is kept in the checkpoint location (from the
session's checkpoint folder unless given).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..plans.scan import scan
from ..session import checkpoint_dir
from ..sources.files import plain_path


def source_stream(spark: SparkSession, folder: str, pattern: str | None = None,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    reader = (spark.readStream.format("text").option("wholetext", "true")
              .option("recursiveFileLookup", "true")
              .option("pathGlobFilter", pattern or rules.DEFAULT_PATTERN))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.load(folder)
    return df.select(plain_path(F.col("_metadata.file_path")).alias("file_path"),
                     F.col("value").alias("content"))


def scan_stream(spark: SparkSession, folder: str, output: str, checkpoint: str | None = None,
                pattern: str | None = None, detectors=None, available_now: bool = True,
                max_files_per_trigger: int | None = None):
    """Start the streaming scan; returns the ``StreamingQuery``."""
    if checkpoint is None:
        base = checkpoint_dir(spark)
        if base is None:
            raise ValueError("no checkpoint location: pass one or set spark.checkpoint.dir")
        # the same input and output resume the same progress
        same = hashlib.sha256(f"{folder}\n{output}\n{pattern}".encode()).hexdigest()[:32]
        checkpoint = f"{base.rstrip('/')}/scan-stream-{same}"

    writer = (scan(source_stream(spark, folder, pattern, max_files_per_trigger), detectors).writeStream
              .format("parquet").outputMode("append").option("path", output).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
