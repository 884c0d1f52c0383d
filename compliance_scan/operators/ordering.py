"""Report order (A3) and exact ordinals without a single-task window.

Report order is directory-walk order, then detector registration order,
then line: ``split(file_path, '/')`` sorts ``a/b.java`` before ``a.java``
as a lexical per-directory walk does (plain string order would not).

``numbered`` gives each row its 1-based place in its group: the rows are
materialised once, sorted by range into partitions and checkpointed (reliably,
to the session's checkpoint folder); a row's place is its place among its group's
rows of its partition plus the counts of its group in earlier partitions, which is
broadcast: at most one row per partition, however many groups there are.  One group,
or one file, may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

def walk_order() -> list[Column]:
    return [F.split(F.col("file_path"), "/"), F.col("detector_ord"), F.col("line_number")]


def order_findings(findings: DataFrame) -> DataFrame:
    """A3: findings in report order (range-partitioned global sort)."""
    return findings.orderBy(*walk_order())


def numbered(rows: DataFrame, order: list[Column], group: Column | None = None, name: str = "ordinal") -> DataFrame:
    """``rows`` with their 1-based place in ``order`` within ``group`` (default: the whole table)."""
    key = F.lit(0) if group is None else group
    # sampling for the range partitions reads the rows a second time, so they are computed before
    ranged = materialize(materialize(rows.withColumn("_group", key)).orderBy("_group", *order))
    tagged = ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    blocks = tagged.groupBy("_part", "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # rows are sorted by group, so of a partition's groups its first alone can have rows in earlier partitions
    starts = blocks.select("_part", "_group", F.sum("_n").over(before).alias("_start")).where("_start > 0")
    starts = starts.select(F.col("_part").alias("_of"), F.col("_group").alias("_same"), "_start")
    local = F.row_number().over(Window.partitionBy("_part", "_group").orderBy("_at"))
    here = (F.col("_part") == F.col("_of")) & F.col("_group").eqNullSafe(F.col("_same"))
    placed = tagged.withColumn("_local", local).join(F.broadcast(starts), here, "left")
    return (placed.withColumn(name, (F.coalesce("_start", F.lit(0)) + F.col("_local")).cast("long"))
            .drop("_part", "_group", "_at", "_local", "_of", "_same", "_start"))


def with_file_ordinal(findings: DataFrame, name: str = "ordinal") -> DataFrame:
    """1-based position of each finding in its file, ordered by (detector, line)."""
    return numbered(findings, [F.col("detector_ord"), F.col("line_number")], F.col("file_path"), name)


def with_global_ordinal(findings: DataFrame, name: str = "ordinal") -> DataFrame:
    """1-based position of each finding in report order over the whole table."""
    return numbered(findings, walk_order(), None, name)
