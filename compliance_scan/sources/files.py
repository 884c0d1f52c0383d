"""File sources: a folder (recursive, base-name glob) or a single file.

``read_sources`` returns ``(file_path, content)``, one row per file, read by
the executors: files of a local folder as a walk in tasks finds them, others with
Spark's text source in whole-text mode; nothing passes through the driver.  ``to_lines`` explodes it into ``(file_path, line_no,
line)``.  ``read_lines`` gives that table without ever holding a file in a
row: a file is split like any other input, and the lines of its blocks are
numbered by the counts of the blocks before them.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import split_lines
from . import tree

WHOLE_BYTES = 8 << 20  # larger files are read as lines, split by split


def plain_path(uri):
    """``file:/a%20b/c+d.java`` -> ``/a b/c+d.java`` (a literal ``+`` survives)."""
    decoded = F.url_decode(F.regexp_replace(uri, r"\+", "%2B"))
    return F.regexp_replace(decoded, r"^file:(//)?", "")


def _is_file(spark: SparkSession, path: str) -> bool:
    """Ask the path's Hadoop file system (local, HDFS, object store) whether it is a file."""
    try:
        jvm = spark.sparkContext._jvm
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return bool(fs.getFileStatus(hpath).isFile())
    except Exception:  # missing path or no JVM gateway: let the reader raise / decide
        return os.path.isfile(path)


def _reader(spark: SparkSession, path: str, pattern: str | None):
    reader = spark.read.format("text")
    if not _is_file(spark, path):
        reader = (reader.option("recursiveFileLookup", "true")
                  .option("pathGlobFilter", pattern or rules.DEFAULT_PATTERN))
    return reader


def walked(spark: SparkSession, path: str, pattern: str | None) -> DataFrame | None:
    """``(file_path, size)`` of the files that Spark's file index finds under a local folder, walked in tasks.

    The index holds every file in the driver and opens each at the cost of a small task; a walk does
    neither.  None where the reader alone tells what it finds: one file, another file system, a glob
    pattern beyond ``*`` and ``?``, compressed files, files that may be left out.
    """
    local = re.sub(r"^file:(//)?", "", path)
    plain = local.startswith("/") and not re.search(r"[*?\[\]{}\\]", local) and not re.search(r"[\[\]{}\\]", pattern or "")
    lenient = any(spark.conf.get(f"spark.sql.files.ignore{x}Files", "false") == "true" for x in ("Missing", "Corrupt"))
    if not plain or lenient or not os.path.isdir(local) or not _is_local(spark, path):
        return None
    files = tree.inventory(spark, local, pattern, as_spark=True).where("size > 0")
    packed = files.where(F.col("file_path").rlike(r"\.(gz|bz2|deflate|snappy|lz4|zst)$"))
    return None if packed.limit(1).count() else files


def _is_local(spark: SparkSession, path: str) -> bool:
    """Whether Hadoop, too, takes ``path`` for one of the local file system."""
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(
        spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file"


def read_sources(spark: SparkSession, path: str, pattern: str | None = None,
                 row_bytes: int | None = None, found: DataFrame | None = None) -> DataFrame:
    """Read every file under ``path`` whose base name matches ``pattern``.

    * empty / missing pattern means ``*.java``;
    * if ``path`` is a file it is read regardless of the pattern;
    * a missing path raises (Spark's ``AnalysisException``: path does not exist);
    * with ``row_bytes``, larger files are left out (see ``read_lines``);
    * ``found`` is what ``walked`` gives for the same path, where it is at hand.

    Known differences to a plain directory walk: Spark's file index skips names
    starting with ``_`` or ``.``, and returns no row for a 0-byte file;
    ``sources.tree.read_tree`` has both, and unreadable files.
    """
    files = found if found is not None else walked(spark, path, pattern)
    if files is not None:
        return tree.read_whole(files if row_bytes is None else files.where(F.col("size") <= row_bytes))
    df = _reader(spark, path, pattern).option("wholetext", "true").load(path)
    if row_bytes is not None:
        df = df.where(F.col("_metadata.file_size") <= row_bytes)  # prunes the files, nothing of them is read
    return df.select(plain_path(F.col("_metadata.file_path")).alias("file_path"),
                     F.col("value").alias("content"))


def read_lines(spark: SparkSession, path: str, pattern: str | None = None,
               larger_than: int | None = None, found: DataFrame | None = None) -> DataFrame:
    """``(file_path, line_no, line)`` of every file under ``path``, read split by split.

    Equal to ``to_lines(read_sources(...))``: lines end at ``\\n`` alone, a trailing
    one opens an empty last line, and a byte order mark stays.  Files may be of
    any size; with ``larger_than`` (bytes) smaller ones are left out.

    Files of a local folder that are no more than a split or ``WHOLE_BYTES`` are read whole, and once.

    A block's lines are consecutive rows of a partition, so a line's number is its
    place there plus the lines of earlier blocks of its file: a table of one row
    per block, aggregated map-side, that a second pass over the text joins.
    """
    files = found if found is not None else walked(spark, path, pattern)
    if files is None:
        df = _reader(spark, path, pattern).option("lineSep", "\n").load(path)
        return _numbered(df if larger_than is None else df.where(F.col("_metadata.file_size") > larger_than))
    files = files if larger_than is None else files.where(F.col("size") > larger_than)
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    whole = F.col("size") <= min(split, WHOLE_BYTES)
    lines = to_lines(tree.read_whole(files.where(whole)))
    large = [r.file_path for r in files.where(~whole).select("file_path").collect()]  # as the reader's own index holds them
    if not large:
        return lines
    return lines.unionByName(_numbered(spark.read.format("text").option("lineSep", "\n").load([f"file:{_literal(p)}" for p in large])))


def _literal(path: str) -> str:
    """``path`` with the signs of a glob pattern taken for themselves."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def _numbered(df: DataFrame) -> DataFrame:
    """The rows of Spark's text reader as ``(file_path, line_no, line)``."""
    rows = df.select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("block"),
                     F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("at"),
                     F.col("value").alias("line"))
    blocks = rows.groupBy("uri", "block", "size").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n"),
        F.sum(F.octet_length("line").cast("long") + 1).alias("bytes"))
    of_file = Window.partitionBy("uri")
    before = of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select("uri", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
                           F.sum("n").over(of_file).alias("lines"),
                           (F.col("size") - F.sum("bytes").over(of_file)).alias("missing"))
    # with a line feed to every line a file has as many bytes as it should if it ends with one, and one
    # too many if not; the reader takes a byte order mark, three bytes, off the first line
    number = (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no")
    mark = F.when((F.col("missing") >= 2) & (number == 1), F.lit("\ufeff")).otherwise(F.lit(""))
    lines = rows.join(placed, ["uri", "block"]).select("uri", number, F.concat(mark, F.col("line")).alias("line"))
    ends = placed.where((F.col("before") == 0) & F.col("missing").isin(0, 3)).select(
        "uri", (F.col("lines") + 1).alias("line_no"), F.lit("").alias("line"))
    return lines.unionByName(ends).select(plain_path(F.col("uri")).alias("file_path"),
                                          F.col("line_no").cast("int").alias("line_no"), "line")


def to_lines(sources: DataFrame) -> DataFrame:
    """``(file_path, content)`` -> ``(file_path, line_no, line)``; 1-based, split on ``\\n``."""
    return (sources
            .select("file_path", F.posexplode(split_lines(F.col("content"))).alias("pos", "line"))
            .select("file_path", (F.col("pos") + 1).cast("int").alias("line_no"), "line"))
