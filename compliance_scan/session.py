"""Session helpers.

On a cluster the session comes from the platform and already names a shared
checkpoint folder in ``spark.checkpoint.dir``; ``checkpoint_dir`` reads that
setting and only falls back to a folder of the caller's choosing when it is
unset (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "compliance_scan",
                  extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g")))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder that the session names in ``spark.checkpoint.dir`` (or has been given)."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def need_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder, set on the context.

    A session on a plain local master gets a temporary folder where none is
    named; a cluster must name one that the driver and all executors share.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = checkpoint_dir(spark)
        if folder is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="compliance-scan-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once with a reliable checkpoint, for several consumers.

    The files belong to Spark, which removes them with the DataFrame if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    need_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
