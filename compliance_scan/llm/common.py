"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROWS_A_TASK = 1 << 15  # narrow rows of a table kept between rounds that one task may hold at least


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names.

    Only a session on a plain local master (tests) may leave
    ``spark.checkpoint.dir`` unset; a cluster must name a folder that the
    driver and all executors share.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="llm-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, known to hold at most ``rows`` narrow rows, in no more partitions than these need.

    Rounds on small tables then make few tasks and files, whatever the session's number of
    shuffle partitions; large tables keep their partitions.
    """
    return df.coalesce(max(1, -(-rows // ROWS_A_TASK)))


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint in the shared folder.

    ``rows`` is an upper bound of its rows, where one is known and the rows are narrow.  A table that
    fits one task is also read as one partition, and what groups or joins such tables needs no exchange.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint() if rows is None else few(few(df, rows).checkpoint(), rows)


def counted(df: DataFrame, rows: int | None = None, of: Column | None = None) -> tuple[DataFrame, int]:
    """``cut(df, rows)`` and the number of its rows, or of those where ``of`` holds, observed by the same job."""
    seen = Observation()
    number = F.count(F.lit(1)) if of is None else F.count_if(of)
    done = cut(df.observe(seen, number.alias("n")), rows)
    return done, seen.get["n"]


def released(spark: SparkSession) -> None:
    """Let go of what finished jobs left: their broadcasts, shuffle files and plans.

    Spark frees these only when the driver happens to collect its garbage, and the driver's heap grows
    before it does; a loop of many small jobs calls this every turn.
    """
    gc.collect()  # Python's references first
    spark.sparkContext._jvm.System.gc()


def held(df: DataFrame, rows: int) -> DataFrame:
    """``df``, known to hold at most ``rows`` narrow rows, as the side of a join: broadcast if these fit one task."""
    return F.broadcast(df) if rows <= ROWS_A_TASK else df


def apart(docs: DataFrame, made, **used: Column) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns renamed ``c0``, ``c1``, ... so that no name of theirs meets a helper column.

    Columns named like one of ``made`` (what an operator returns) are left out; ``used`` are further
    columns, given over the old names.  Also returns the new names and what they stand for.
    """
    kept = [c for c in docs.columns if c.lower() not in made]
    names = {f"c{i}": c for i, c in enumerate(kept)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()], *[v.alias(k) for k, v in used.items()]), names


def back(names: dict[str, str]) -> list[Column]:
    """The columns that ``apart`` renamed, under their own names."""
    return [F.col(n).alias(c) for n, c in names.items()]


def crc_fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null for a null id)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % folds


def labelled(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """``(doc_id, y)`` of the usable training labels: one row per id, folds but the held-out one.

    Null ids, null labels, labels other than 0 and 1, and ids with
    contradicting labels are left out.
    """
    y = F.col(label).cast("int")
    return (labels.where(F.col("doc_id").isNotNull() & y.isin(0, 1) & (crc_fold("doc_id", folds) != held_out))
            .groupBy("doc_id").agg(F.min(y).alias("y"), F.max(y).alias("_most"))
            .where(F.col("y") == F.col("_most")).select("doc_id", "y"))


def first_by_hash(labels: DataFrame, rows: int, seed: int) -> DataFrame:
    """A bounded sample: the ``rows`` smallest by a hash of the id; the same on every run."""
    return labels.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows)
