"""Reports (A4, A5, K1, K2).

The original builds one record per scan with every finding in an array.  At
corpus scale that is one unbounded group, so here a report is a table of
ordered *fragments* ``(target_path, seq, text)``: 0 opens the document, 1..n are
the findings in report order, n+1 closes it.  The texts of a target, joined in
order, are the whole document -- a JSON object or a text report -- while no row
holds more than one finding.  A target is a file, a folder or a whole scan.

Findings are materialised once, so a document reads the corpus twice: for its
findings and for its number of files.  An inventory of paths (see
``sources.tree``) as ``sources`` spares the second read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..session import materialize
from .detectors import FINDING_FIELDS
from .ordering import numbered, walk_order, with_file_ordinal

# Title line of the text report (the original prints its own product name).
TEXT_TITLE = "compliance scan report"

_RFC3339_UTC = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def scanned_at() -> Column:
    """Now as RFC 3339 in UTC (``...Z``)."""
    utc_wall = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.date_format(utc_wall, _RFC3339_UTC)


def summary(sources: DataFrame, findings: DataFrame, target: Column | str | None = None,
            with_time: bool = False) -> DataFrame:
    """A4/A5: one row per target: ``target_path, files_scanned, total_findings, disclaimer``.

    ``target`` is a column over ``file_path`` (e.g. the file itself for the
    per-file form, or a folder); a string is a constant target (whole scan).
    Where findings are not needed themselves, ``header(plans.scan.scan_counts(...))``
    gives the same in one pass over the sources.
    """
    if target is None:
        target = F.col("file_path")
    elif isinstance(target, str):
        target = F.lit(target)
    files = sources.select(target.alias("target_path"), F.lit(1).cast("long").alias("f"), F.lit(0).cast("long").alias("n"))
    hits = findings.select(target.alias("target_path"), F.lit(0).cast("long").alias("f"), F.lit(1).cast("long").alias("n"))
    out = (files.unionByName(hits).groupBy("target_path")
           .agg(F.sum("f").alias("files_scanned"),
                F.sum("n").alias("total_findings")))
    return header(out, with_time)


def header(counts: DataFrame, with_time: bool = False) -> DataFrame:
    """The report header of each target from its counts (``target_path, files_scanned, total_findings``)."""
    cols = [F.col("target_path"), F.col("files_scanned"), F.col("total_findings"),
            F.lit(rules.DISCLAIMER).alias("disclaimer")]
    if with_time:
        cols.insert(0, scanned_at().alias("scanned_at"))
    return counts.select(*cols)


def finding_json(findings: DataFrame) -> DataFrame:
    """K1: each finding as a JSON object, snake_case keys in struct order."""
    return findings.select("file_path", "line_number", "detector_id",
                           F.to_json(F.struct(*[F.col(c) for c in FINDING_FIELDS])).alias("json"))


def summary_json(summary_rows: DataFrame) -> DataFrame:
    """K1: the report header (everything but the findings) as JSON."""
    return summary_rows.select("target_path", F.to_json(F.struct(*summary_rows.columns)).alias("json"))


# FIXED VALUES -- layout of the text report, title aside
_HEADER = f"{TEXT_TITLE}\nScanned: %s\nTarget:  %s\nFiles:   %d\nFindings: %d\n\n"
_BLOCK = ("--- Finding %d ---\n"
          "  Detector:  %s\n"
          "  Risk:      %s\n"
          "  Location:  %s:%d\n"
          "  Snippet:   %s\n"
          "  Message:   %s\n"
          "  Laws:      %s\n\n")


def _block() -> Column:
    return F.format_string(_BLOCK, F.col("ordinal"), F.col("detector_id"), F.col("risk_level"),
                           F.col("file_path"), F.col("line_number"), F.col("snippet"),
                           F.col("message"), F.array_join(F.col("related_laws"), ", "))


def finding_blocks(findings: DataFrame) -> DataFrame:
    """K2: numbered text block of each finding in its file's report."""
    return with_file_ordinal(findings).select(F.col("file_path").alias("target_path"), "ordinal", _block().alias("text"))


def _escaped(json: Column) -> Column:
    """JSON text with ``<``, ``>``, ``&`` and the line separators U+2028 and U+2029 escaped, as the original writes it."""
    out = json
    for ch in "<>&\u2028\u2029":
        out = F.replace(out, F.lit(ch), F.lit(f"\\u{ord(ch):04x}"))
    return out


def _value(column: str) -> Column:
    """A string column as a JSON string."""
    one = F.to_json(F.struct(F.col(column).alias("v")))
    return _escaped(F.substring(one, 6, F.length(one) - 6))  # {"v":...}


def _target(target: Column | str | None) -> Column:
    return F.col("file_path") if target is None else F.lit(target) if isinstance(target, str) else target


def _document(sources: DataFrame, findings: DataFrame, target, at: Column | str | None, opening, body, closing) -> DataFrame:
    """Fragments of the documents of all targets; the parts are given as columns over the header or a finding."""
    target = _target(target)
    placed = materialize(numbered(findings.withColumn("target_path", target), walk_order(), F.col("target_path")))
    head = summary(sources, placed.drop("target_path"), target).withColumn(
        "scanned_at", scanned_at() if at is None else F.lit(at) if isinstance(at, str) else at)
    head = materialize(head)  # one time stamp and one count for both ends of a document
    return (head.select("target_path", F.lit(0).cast("long").alias("seq"), opening.alias("text"))
            .unionByName(placed.select("target_path", F.col("ordinal").alias("seq"), body.alias("text")))
            .unionByName(head.select("target_path", (F.col("total_findings") + 1).alias("seq"), closing.alias("text"))))


def text_report(sources: DataFrame, findings: DataFrame, target: Column | str | None = None,
                at: Column | str | None = None) -> DataFrame:
    """K2: text reports as ordered fragments; findings are numbered through the whole target in report order.

    ``target`` is a column over ``file_path`` or a constant; by default every file has its own report.
    ``at`` replaces the time of the scan.
    """
    opening = F.format_string(_HEADER, "scanned_at", "target_path", "files_scanned", "total_findings")
    return _document(sources, findings, target, at, opening, _block(), F.concat(F.col("disclaimer"), F.lit("\n")))


def json_report(sources: DataFrame, findings: DataFrame, target: Column | str | None = None,
                at: Column | str | None = None) -> DataFrame:
    """K1/A5: JSON reports as ordered fragments that join to one object a target.

    The object has the keys of the original in its order; a report without findings has an empty list.
    """
    opening = F.concat(F.lit('{"scanned_at":'), _value("scanned_at"), F.lit(',"target_path":'), _value("target_path"),
                       F.lit(',"files_scanned":'), F.col("files_scanned").cast("string"), F.lit(',"total_findings":'),
                       F.col("total_findings").cast("string"), F.lit(',"findings":['))
    one = _escaped(F.to_json(F.struct(*[F.col(c) for c in FINDING_FIELDS])))
    body = F.when(F.col("ordinal") == 1, one).otherwise(F.concat(F.lit(","), one))
    closing = F.concat(F.lit('],"disclaimer":'), _value("disclaimer"), F.lit("}"))
    return _document(sources, findings, target, at, opening, body, closing)


def write_report(report_rows: DataFrame, path: str) -> None:
    """Write reports in order: range-partitioned on ``(target_path, seq)`` so the part files, read in
    name order, are the reports in order and no target is forced into one task.

    The writer ends every fragment with a line feed: text fragments have that one already and are
    written as they are; a JSON object has its line feeds between its parts, where they mean nothing.
    """
    (report_rows.repartitionByRange("target_path", "seq")
     .sortWithinPartitions("target_path", "seq")
     .select(F.regexp_replace(F.col("text"), r"\n\z", "").alias("value"))
     .write.mode("overwrite").text(path))
