"""Inventory of a folder: every file that a directory walk finds, readable or not.

Spark's own file index leaves out names that begin with ``_`` or ``.`` and
yields no row for an empty file, and one unreadable file fails its job.
``read_tree`` walks the folder itself, in Spark tasks: folders are rows, one
round lists all folders of one depth, and the driver sees only how many there
are.  Files are then read by the executors, each with its own outcome, so a
result has one row per file found: its text, or the error that kept it from
being read.  An unreadable file has no findings but counts as scanned; a folder
that cannot be listed fails the walk, as does a missing root.

Paths without a scheme and ``file:`` URIs are read from the file system that the
executors share; other schemes go through ``pyarrow.fs``.  A store that only
Spark can read is left to ``sources.files.read_sources``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import partial
from itertools import groupby
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..session import materialize

FOUND = "path string, is_dir boolean, size long, error string"
READ = "file_path string, content string, size long, error string"

ROW_BYTES = 256 << 20        # larger files are not read into one row
TASK_FILES = 1 << 12         # files or folders that a task lists or reads, about
TASK_BYTES = 128 << 20       # bytes that a task reads, about
LISTED_AT_ONCE = 1 << 12     # rows of one batch of a listing
READ_AT_ONCE = 8 << 20       # bytes of text of one batch of files


def name_pattern(glob: str) -> str:
    """A regular expression for base names: ``*``, ``?``, ``[a-z]``, ``[^a-z]`` and ``\\`` before a plain character."""
    out, i = "", 0
    while i < len(glob):
        ch = glob[i]
        if ch in "*?":
            out += ".*" if ch == "*" else "."
        elif ch == "[":
            end = i + 1 + glob.startswith("^", i + 1)
            body = ""
            while end < len(glob) and glob[end] != "]":
                at = end + (glob[end] == "\\")
                if at >= len(glob):
                    break
                body += "-" if glob[end] == "-" else re.escape(glob[at])
                end = at + 1
            if end >= len(glob) or not body or body.startswith("-") or body.endswith("-"):
                raise ValueError(f"bad file pattern: {glob}")
            out += f"[{'^' if glob[i + 1] == '^' else ''}{body}]"
            i = end
        elif ch == "\\":
            i += 1
            if i == len(glob):
                raise ValueError(f"bad file pattern: {glob}")
            out += re.escape(glob[i])
        else:
            out += re.escape(ch)
        i += 1
    return f"(?s)\\A(?:{out})\\Z"


def _local(path: str) -> str | None:
    """The local path of a plain path or a ``file:`` URI, None for other schemes."""
    if path.startswith("file:"):
        return unquote(re.sub(r"^file:(//)?", "", path))
    return None if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path) else path


def _status(path: str) -> tuple[bool, int]:
    """Whether ``path`` is a folder, and its size; raises FileNotFoundError."""
    local = _local(path)
    if local is not None:
        found = os.stat(local)
        return os.path.isdir(local), found.st_size
    store, inner = pafs.FileSystem.from_uri(path)
    info = store.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    return info.type == pafs.FileType.Directory, info.size or 0


def _entries(folder: str, follow: bool = False) -> Iterator[tuple[str, bool, int]]:
    """``(path, is_dir, size)`` of everything right in ``folder``; links to folders are files, or followed."""
    local = _local(folder)
    if local is not None:
        with os.scandir(local) as found:
            for e in found:
                is_dir = e.is_dir(follow_symlinks=follow)
                try:
                    size = 0 if is_dir else e.stat().st_size
                except OSError:  # a dangling link or a file that is gone: reading it will tell
                    size = 0
                yield f"{local.rstrip('/')}/{e.name}", is_dir, size
        return
    store, inner = pafs.FileSystem.from_uri(folder)
    for info in store.get_file_info(pafs.FileSelector(inner)):
        yield (f"{folder.rstrip('/')}/{info.base_name}", info.type == pafs.FileType.Directory, info.size or 0)


def _read(path: str) -> bytes:
    local = _local(path)
    if local is not None:
        with open(local, "rb") as file:
            return file.read()
    store, inner = pafs.FileSystem.from_uri(path)
    with store.open_input_stream(inner) as stream:
        return stream.read()


def reaches(path: str) -> bool:
    """Whether tasks can open ``path`` themselves: a local path, or a scheme that ``pyarrow.fs`` knows."""
    try:
        return _local(path) is not None or bool(pafs.FileSystem.from_uri(path))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def _write(path: str, data: bytes) -> None:
    local = _local(path)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "wb") as file:
            file.write(data)
        return
    store, inner = pafs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(inner))
    with store.open_output_stream(inner) as stream:
        stream.write(data)


def write_files(rows: DataFrame, folder: str) -> int:
    """``(folder, value)`` written as text below ``folder``, and the number of files.

    Every partition has its own file ``<folder>/part-<partition>.txt`` for each folder of its rows,
    with a line feed after each value (null: empty).  The executors write the files where they stay,
    so none is renamed and the driver sees a number only; a task that runs again writes the same files.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():05d}.txt"
        values = (pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        files = 0
        for inner, of_file in groupby(values, key=lambda pair: pair[0]):
            _write(f"{folder}/{inner}/{name}", "".join(f"{value or ''}\n" for _, value in of_file).encode())
            files += 1
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], ["files"])

    ordered = rows.select("folder", "value").sortWithinPartitions("folder")
    return ordered.mapInArrow(write, "files long").agg(F.sum("files")).first()[0] or 0


def _list(batches: Iterator[pa.RecordBatch], follow: bool = False) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch():
        columns = list(zip(*held)) or [(), (), (), ()]
        kinds = (pa.string(), pa.bool_(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "is_dir", "size", "error"])

    for b in batches:
        for folder in b.column(0).to_pylist():
            try:
                for path, is_dir, size in _entries(folder, follow):
                    held.append((path, is_dir, size, None))
                    if len(held) >= LISTED_AT_ONCE:
                        yield batch()
                        held.clear()
            except OSError as error:
                held.append((folder, True, 0, f"{type(error).__name__}: {error}"))
    yield batch()


def _spread(df: DataFrame, rows: int, size: int = 0) -> DataFrame:
    """``df``, of so many rows that stand for so many bytes, in as many partitions as its tasks should be."""
    at_least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(rows, max(at_least, -(-rows // TASK_FILES), -(-size // TASK_BYTES)))))


def _shown() -> Column:
    """Whether Spark's file index has the file, or looks into the folder, at ``path``."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return (F.col("is_dir") & name.rlike("^_(common_)?metadata")) | ~name.rlike(r"(?s)^[.]|[.]_COPYING_\z|^_[^=]*\z")


def inventory(spark: SparkSession, path: str, pattern: str | None = None, as_spark: bool = False) -> DataFrame:
    """``(file_path, size)``: every file under ``path`` whose base name matches ``pattern`` (default ``*.java``).

    ``as_spark`` follows links to folders and leaves out the names, folders too, that Spark's file index does.

    A path that is a file is the whole inventory, whatever the pattern; a
    missing path raises ``FileNotFoundError``, a folder that cannot be listed ``OSError``.
    """
    is_dir, size = _status(path)
    root = _local(path) if _local(path) is not None else path
    if not is_dir:
        return spark.createDataFrame([(root, size)], "file_path string, size long")
    named = F.regexp_extract("path", r"([^/]*)$", 1).rlike(name_pattern(pattern or rules.DEFAULT_PATTERN))
    folders, n = spark.createDataFrame([(os.path.normpath(root) if _local(path) is not None else root,)], "path string"), 1
    files = None
    while n:
        level = _spread(folders, n).mapInArrow(partial(_list, follow=as_spark), FOUND)
        level = materialize(level.where(F.col("error").isNotNull() | _shown()) if as_spark else level)
        told = level.agg(F.count_if(F.expr("is_dir and error is null")).alias("n"), F.min("error").alias("error")).first()
        if told.error:
            raise OSError(told.error)
        here = level.where(~F.col("is_dir") & named).select(F.col("path").alias("file_path"), "size")
        files = here if files is None else files.unionByName(here)
        folders, n = level.where("is_dir").select("path"), told.n
    return files


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch():
        columns = list(zip(*held)) or [(), (), (), ()]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file_path", "content", "size", "error"])

    for b in batches:
        for path, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            try:
                text, error = _read(path).decode("utf-8", "replace"), None
            except OSError as failed:
                text, error = None, f"{type(failed).__name__}: {failed}"
            held.append((path, text, n, error))
            size += n
            if size >= READ_AT_ONCE or len(held) >= LISTED_AT_ONCE:
                yield batch()
                held.clear()
                size = 0
    yield batch()


def read_tree(spark: SparkSession, path: str, pattern: str | None = None, row_bytes: int = ROW_BYTES) -> DataFrame:
    """``(file_path, content, size, error)``: one row per file of the inventory.

    ``content`` is NULL where ``error`` says why; bytes that are no UTF-8 become
    U+FFFD.  Files larger than ``row_bytes`` are not read here
    (``error`` says so): ``sources.files.read_lines`` reads them line by line.
    """
    files = materialize(inventory(spark, path, pattern))
    small = files.where(F.col("size") <= row_bytes)
    large = files.where(F.col("size") > row_bytes).select(
        "file_path", F.lit(None).cast("string").alias("content"), "size", F.lit("larger than a row").alias("error"))
    told = small.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).first()
    # a round-robin deal: neighbours of a folder are spread over the tasks
    return _spread(small, told.n, told.size or 0).mapInArrow(_read_files, READ).unionByName(large)


def _read_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths, texts, size = [], [], 0
    for b in batches:
        for path in b.column(0).to_pylist():
            paths.append(path)
            texts.append(_read(path))
            size += len(texts[-1])
            if size >= READ_AT_ONCE or len(paths) >= LISTED_AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.binary())], ["file_path", "content"])
                paths, texts, size = [], [], 0
    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.binary())], ["file_path", "content"])


def read_whole(files: DataFrame) -> DataFrame:
    """``(file_path, content)`` of an inventory's files, their bytes as they are; one that cannot be read fails the job."""
    told = files.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).first()
    read = _spread(files.select("file_path"), told.n, told.size or 0).mapInArrow(_read_whole, "file_path string, content binary")
    return read.select("file_path", F.col("content").cast("string").alias("content"))
