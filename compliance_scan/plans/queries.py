"""Named queries over the driver tables (the ``queries()`` contract).

Every query reads a driver table: the corpus is generated from
``customer.c_custkey`` (one Java file per key), so the work grows with the
table.  Output columns are aliased to match the DuckDB oracle
(``compliance_scan.oracle``); ``related_laws`` is joined with ``,`` and line
numbers are INT on both sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import re2
from ..functions.text import FLAG_BITS, flag, unicode_trim
from ..operators import laws as law_ops
from ..operators import ordering, report
from ..operators.detectors import detector_catalog
from ..session import need_checkpoint_dir
from ..sources import tree
from ..sources.corpus import corpus_sources
from ..sources.files import read_lines, to_lines
from ..sources.laws import load_laws
from .scan import frames, scan, scan_counts, scan_path

CORPUS_TABLE = "customer"

FINDING_COLUMNS = ["detector_id", "risk_level", "file_path", "line_number", "snippet",
                   "message", "related_laws"]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_sources(spark, sf_dir, CORPUS_TABLE)


def findings(spark: SparkSession, sf_dir: str, detectors=None) -> DataFrame:
    return scan(corpus(spark, sf_dir), detectors)


def _flat(f: DataFrame) -> DataFrame:
    return f.select(*[F.array_join("related_laws", ",").alias(c) if c == "related_laws" else F.col(c)
                      for c in FINDING_COLUMNS])


def corpus_folder(spark: SparkSession, sf_dir: str) -> str:
    """The corpus written as a folder of files ``k=<key>/part-*.txt`` in the shared checkpoint folder.

    The writer ends every line with a line feed, so a file has an empty last line.
    """
    folder = f"{need_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    k = F.regexp_extract("file_path", r"/F(\d+)\.java$", 1)
    rows = corpus(spark, sf_dir).select(k.alias("k"), F.col("content").alias("value"))
    if tree.reaches(folder):
        named = F.coalesce(F.nullif("k", F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))  # as partitionBy names it
        tree.write_files(rows.select(F.concat(F.lit("k="), named).alias("folder"), "value"), folder)
    else:
        rows.write.partitionBy("k").text(folder)
    return folder


def _of_key(df: DataFrame) -> DataFrame:
    return df.withColumn("k", F.regexp_extract("file_path", r"k=(\d+)/", 1).cast("long")).drop("file_path")


# --- sources / projections ------------------------------------------------------

def source_lines(spark, sf_dir):
    """Every line of every file, 1-based."""
    return to_lines(corpus(spark, sf_dir))


def tree_files(spark, sf_dir):
    """Every file of the corpus folder that a walk finds, its size, and whether it could be read."""
    found = tree.read_tree(spark, corpus_folder(spark, sf_dir), "part-*")
    return _of_key(found.select("file_path", "size", F.col("error").isNull().alias("readable"),
                                F.octet_length("content").cast("long").alias("bytes")))


def tree_findings(spark, sf_dir):
    """Findings of the walked corpus folder."""
    found = scan(tree.read_tree(spark, corpus_folder(spark, sf_dir), "part-*"))
    return _of_key(found.select("file_path", "detector_id", "line_number", "snippet", "message"))


def split_lines(spark, sf_dir):
    """Every line of the corpus folder's files, numbered over the splits of each file."""
    return _of_key(read_lines(spark, corpus_folder(spark, sf_dir), "part-*"))


def path_findings(spark, sf_dir):
    """A1/A2: findings of the corpus folder, files of up to 500 bytes whole, larger ones as lines in chunks."""
    found = scan_path(spark, corpus_folder(spark, sf_dir), "part-*", row_bytes=500)
    return _of_key(found.select("file_path", "detector_id", "line_number", "snippet", "message"))


def line_snippets(spark, sf_dir):
    """Unicode-trimmed text of every line."""
    return to_lines(corpus(spark, sf_dir)).select(
        "file_path", "line_no", unicode_trim(F.col("line")).alias("snippet"))


def line_flags(spark, sf_dir):
    """Every line predicate of every line (the scan's RE2 bitmask, unpacked)."""
    lines = to_lines(corpus(spark, sf_dir))
    names = tuple(FLAG_BITS)
    packed = lines.select("file_path", "line_no", re2.line_flags(F.col("line"), names).alias("flags"))
    return packed.select("file_path", "line_no", *[flag(F.col("flags"), n).alias(n) for n in names])


FIELD_PATTERNS = (("log_call", 2), ("identifier", 0), ("financial", 0), ("record", 0))


def _matched(lines):
    which = F.explode(F.array(*[F.lit(i) for i in range(len(FIELD_PATTERNS))]))
    fields = [(i, p, g) for i, (p, g) in enumerate(FIELD_PATTERNS)]
    tried = lines.select("file_path", "line_no", "line", which.alias("which"))
    found = tried.withColumn("field", re2.matched_field(F.col("line"), F.col("which"), fields))
    names = F.array(*[F.lit(p) for p, _ in FIELD_PATTERNS])
    return (found.where("field is not null")
            .select("file_path", "line_no", F.get(names, F.col("which")).alias("pattern"), "field"))


def matched_field(spark, sf_dir):
    """Reported field of every line matching a field pattern."""
    return _matched(to_lines(corpus(spark, sf_dir)))


def matched_field_folded(spark, sf_dir):
    """The same where the letters s, k and i are others that fold to them, or do not, by the rules' dialect."""
    n = F.col("line_no") % 3
    line = (F.when(n == 0, F.translate("line", "skSK", "ſKſK")).when(n == 1, F.translate("line", "iI", "ıİ"))
            .otherwise(F.translate("line", "ski", "SKİ")))
    return _matched(to_lines(corpus(spark, sf_dir)).withColumn("line", line))


# --- frames -------------------------------------------------------------------------

def _framed(spark, sf_dir, detector_ids, only_triggers=False):
    return frames(to_lines(corpus(spark, sf_dir)), rules.resolve(detector_ids),
                  only_triggers=only_triggers)


def annotation_evidence(spark, sf_dir):
    """Evidence inside the annotation run right above each line."""
    fr = _framed(spark, sf_dir, [rules.ENCRYPTION, rules.FINANCIAL])
    return fr.select("file_path", "line_no", F.col("annot_enc_ev").alias("annot_encrypt"),
                     F.col("annot_prot_ev").alias("annot_protect"))


def forward_evidence(spark, sf_dir):
    """Evidence in the next 10 lines before a new field starts."""
    fr = _framed(spark, sf_dir, [rules.ENCRYPTION, rules.FINANCIAL])
    return fr.select("file_path", "line_no", F.col("forward_enc_ev").alias("fwd_encrypt"),
                     F.col("forward_prot_ev").alias("fwd_protect"))


def marketing_context(spark, sf_dir):
    """Intent / opt-in within +-10 code lines of each line."""
    fr = _framed(spark, sf_dir, [rules.MARKETING])
    return fr.select("file_path", "line_no", "ctx_intent", "ctx_optin")


def method_blocks(spark, sf_dir):
    """Brace block of every mapping annotation and its tokens."""
    fr = frames(to_lines(corpus(spark, sf_dir)), rules.resolve([rules.CONSENT]), dense=True)
    return fr.select("file_path", F.col("line_no").alias("anchor_line"),
                     F.coalesce("blk_end", "blk_last").alias("end_line"),
                     F.col("blk_personal").alias("has_personal"),
                     F.col("blk_consent").alias("has_consent"))


# --- detectors -----------------------------------------------------------------------

def _detect(detector_id):
    def q(spark, sf_dir):
        return _flat(findings(spark, sf_dir, [detector_id]))
    q.__name__ = f"detect_{detector_id}"
    return q


def scan_all(spark, sf_dir):
    """A1/A2: all findings of all detectors over all files."""
    return _flat(findings(spark, sf_dir))


def total_lines(sources: DataFrame) -> DataFrame:
    """A detector of one's own: lines that declare a total."""
    hits = to_lines(sources).where(F.col("line").contains("int total"))
    return hits.select(F.lit("OWN-001").alias("detector_id"), F.lit("LOW").alias("risk_level"), "file_path",
                       F.col("line_no").alias("line_number"), unicode_trim(F.col("line")).alias("snippet"),
                       F.lit("A total is declared").alias("message"), F.array(F.lit("OWN-1"), F.lit("OWN-2")).alias("related_laws"))


def scan_with_own_detector(spark, sf_dir):
    """2.8: findings of a built-in detector and of a caller's, numbered in report order."""
    f = ordering.with_global_ordinal(scan(corpus(spark, sf_dir), [total_lines, rules.LOGGING]))
    return f.select(
        "ordinal", "detector_id", "file_path", "line_number", "snippet", F.array_join("related_laws", ",").alias("related_laws"))


def scan_ordered(spark, sf_dir):
    """A3: report position of every finding (walk order, detector order, line)."""
    f = ordering.with_global_ordinal(findings(spark, sf_dir))
    return f.select("ordinal", "file_path", "detector_id", "line_number")


# --- reports -------------------------------------------------------------------------

def report_summary(spark, sf_dir):
    """A4: the directory-scan report header (target = corpus root)."""
    return report.header(scan_counts(corpus(spark, sf_dir), target="src"))


def report_row(spark, sf_dir):
    """A5: the single-file report header of every file (clean files included)."""
    return report.header(scan_counts(corpus(spark, sf_dir)))


def report_by_folder(spark, sf_dir):
    """A5: the directory-scan report header of every folder."""
    folder = F.regexp_extract(F.col("file_path"), r"^(.*)/[^/]*$", 1)
    return report.header(scan_counts(corpus(spark, sf_dir), target=folder))


def report_json(spark, sf_dir):
    """K1: every finding as JSON."""
    return report.finding_json(findings(spark, sf_dir))


def report_text(spark, sf_dir):
    """K2: numbered text block of every finding in its file's report."""
    return report.finding_blocks(findings(spark, sf_dir))


def report_stamp(spark, sf_dir):
    """P10: the stamped header of every folder: the time is RFC 3339 in UTC, the same in all rows, and just past."""
    folder = F.regexp_extract(F.col("file_path"), r"^(.*)/[^/]*$", 1)
    stamped = report.header(scan_counts(corpus(spark, sf_dir), [rules.MARKETING], folder), with_time=True)
    at = F.to_timestamp("scanned_at", "yyyy-MM-dd'T'HH:mm:ssX")
    return stamped.select("target_path", "files_scanned", "total_findings",
                          F.col("scanned_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$").alias("well_formed"),
                          (F.abs(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(at)) <= 1).alias("just_past"))


REPORT_TIME = "2026-03-23T14:30:00Z"  # a report names the time of its scan; here a fixed one, so runs agree


def report_directory_text(spark, sf_dir):
    """K2: the text report of the whole corpus as ordered fragments, findings numbered through all files."""
    src = corpus(spark, sf_dir)
    return report.text_report(src, scan(src), "src", REPORT_TIME)


def report_file_text(spark, sf_dir):
    """K2: the text report of every file as ordered fragments."""
    src = corpus(spark, sf_dir)
    return report.text_report(src, scan(src), None, REPORT_TIME)


def report_directory_json(spark, sf_dir):
    """K1/A5: the JSON report of the whole corpus as ordered fragments of one object."""
    src = corpus(spark, sf_dir)
    return report.json_report(src, scan(src), "src", REPORT_TIME)


def report_file_json(spark, sf_dir):
    """K1/A5: the JSON report of every file as ordered fragments of one object a file."""
    src = corpus(spark, sf_dir)
    return report.json_report(src, scan(src), None, REPORT_TIME)


# --- catalogue and laws ------------------------------------------------------------------

def detector_summary(spark, sf_dir):
    """Detector catalogue with the number of findings of each detector."""
    counts = findings(spark, sf_dir).groupBy(F.col("detector_id").alias("id")).agg(
        F.count(F.lit(1)).alias("findings"))
    cat = detector_catalog(spark)
    return (cat.join(counts, "id", "left")
            .select("detector_ord", "id", "name", "description",
                    F.array_join("related_laws", ",").alias("related_laws"), "risk_level",
                    F.coalesce("findings", F.lit(0)).cast("long").alias("findings")))


def _cited(spark, sf_dir):
    return findings(spark, sf_dir).select(F.explode("related_laws").alias("id"))


LAW_COLUMNS = ["name_ko", "name_en", "summary", "url", "risk_level"]


def _requested(spark, sf_dir):
    """Requested law IDs: every cited provision, and IDs made of the table's keys that no law has."""
    keys = spark.read.parquet(f"{sf_dir}/{CORPUS_TABLE}.parquet").select(
        F.concat(F.lit("REQ-"), (F.col("c_custkey") % 7).cast("string")).alias("id"))
    return _cited(spark, sf_dir).unionByName(keys).distinct()


def law_list(spark, sf_dir):
    """The law table in load order with the number of findings citing each law."""
    cites = _cited(spark, sf_dir).groupBy("id").agg(F.count(F.lit(1)).alias("findings"))
    return (load_laws(spark).join(cites, "id", "left")
            .select("ord", "id", *LAW_COLUMNS, F.coalesce("findings", F.lit(0)).cast("long").alias("findings")))


def law_lookup(spark, sf_dir):
    """The law row of every requested ID, NULL columns where the ID is unknown."""
    return law_ops.lookup(_requested(spark, sf_dir), load_laws(spark)).select("id", *LAW_COLUMNS)


def law_unknown_ids(spark, sf_dir):
    """Requested IDs missing from the law table."""
    return law_ops.unknown_ids(_requested(spark, sf_dir), load_laws(spark))


def detector_law_coverage(spark, sf_dir):
    """Every provision a detector names, whether the law table has it, and the detector's findings."""
    counts = findings(spark, sf_dir).groupBy(F.col("detector_id").alias("id")).agg(F.count(F.lit(1)).alias("findings"))
    named = detector_catalog(spark).select("id", F.explode("related_laws").alias("law_id"))
    gaps = law_ops.detector_law_gaps(detector_catalog(spark), load_laws(spark)).select("id", "law_id", F.lit(False).alias("known"))
    return (named.join(gaps, ["id", "law_id"], "left").join(counts, "id", "left")
            .select(F.col("id").alias("detector_id"), "law_id", F.coalesce("known", F.lit(True)).alias("known"),
                    F.coalesce("findings", F.lit(0)).cast("long").alias("findings")))


def law_override(spark, sf_dir):
    """Laws made of the table's keys, written as four files of JSON lines in falling order, in load order.

    The duplicate check passes them; a row's ``ord`` is its place over all files.
    """
    folder = f"{need_checkpoint_dir(spark)}/laws-{uuid.uuid4().hex}"
    k = F.col("c_custkey").cast("long")
    rows = spark.read.parquet(f"{sf_dir}/{CORPUS_TABLE}.parquet").select(
        k.alias("k"), F.format_string("OWN-%d", k).alias("id"), F.format_string("법 %d", k).alias("name_ko"),
        F.when(k % 3 > 0, F.format_string("Act %d \"<&>\"", k)).alias("name_en"), F.lit("own").alias("summary"),
        F.when(k % 2 > 0, F.lit("HIGH")).otherwise(F.lit("MEDIUM")).alias("risk_level"))
    rows.repartitionByRange(4, F.desc("k")).sortWithinPartitions(F.desc("k")).drop("k").write.json(folder)
    return load_laws(spark, folder).select("ord", "id", "name_ko", "name_en", "summary", "risk_level", "full_text_ko")


def law_responses(spark, sf_dir):
    """``(query, body, arrived)``: one landed search response per key, for the law at ``key % 37`` in load order.

    The time of arrival falls and rises with the key, so the earliest text of a law is seldom the least.

    By ``key % 5``: two entries, no entry, no XML, another root, and a comment before the root.
    """
    keys = spark.read.parquet(f"{sf_dir}/{CORPUS_TABLE}.parquet").select(F.col("c_custkey").alias("k"))
    entry = "<law><법령명_한글>x</법령명_한글><조문내용>text %d</조문내용></law>"
    shapes = [f"<LawSearch>{entry}<law><조문내용>a later entry</조문내용></law></LawSearch>",
              "<LawSearch></LawSearch>", "not found", f"<Other>{entry}</Other>",
              f"<!-- answer --><LawSearch>{entry}</LawSearch>"]
    body = F.coalesce(*[F.when(F.col("k") % 5 == i, F.format_string(x, "k") if "%d" in x else F.lit(x))
                        for i, x in enumerate(shapes)])
    names = load_laws(spark).select("ord", F.col("name_ko").alias("query"))
    return keys.withColumn("ord", (F.col("k") % 37 + 1).cast("int")).join(names, "ord").select(
        "query", body.alias("body"), (F.col("k") * 7919 % 10007).alias("arrived"))


def law_refresh(spark, sf_dir):
    """A10: every law with the text that the landed responses give it."""
    return law_ops.refresh(load_laws(spark), law_responses(spark, sf_dir)).select("id", "name_ko", "full_text")


def findings_with_laws(spark, sf_dir):
    """One row per (finding, related law) with the law's name and risk."""
    x = law_ops.expand_findings(findings(spark, sf_dir), load_laws(spark))
    return x.select("file_path", "line_number", "detector_id", "law_id", "law_name_en",
                    "law_risk_level")


QUERIES = {
    "source_lines": source_lines,
    "tree_files": tree_files,
    "tree_findings": tree_findings,
    "split_lines": split_lines,
    "path_findings": path_findings,
    "line_snippets": line_snippets,
    "line_flags": line_flags,
    "matched_field": matched_field,
    "matched_field_folded": matched_field_folded,
    "annotation_evidence": annotation_evidence,
    "forward_evidence": forward_evidence,
    "marketing_context": marketing_context,
    "method_blocks": method_blocks,
    "detect_logging": _detect(rules.LOGGING),
    "detect_encryption": _detect(rules.ENCRYPTION),
    "detect_consent": _detect(rules.CONSENT),
    "detect_marketing": _detect(rules.MARKETING),
    "detect_financial": _detect(rules.FINANCIAL),
    "detect_retention": _detect(rules.RETENTION),
    "scan_all": scan_all,
    "scan_ordered": scan_ordered,
    "scan_with_own_detector": scan_with_own_detector,
    "report_summary": report_summary,
    "report_row": report_row,
    "report_by_folder": report_by_folder,
    "report_json": report_json,
    "report_text": report_text,
    "report_stamp": report_stamp,
    "report_directory_text": report_directory_text,
    "report_file_text": report_file_text,
    "report_directory_json": report_directory_json,
    "report_file_json": report_file_json,
    "detector_summary": detector_summary,
    "law_list": law_list,
    "law_override": law_override,
    "law_lookup": law_lookup,
    "law_unknown_ids": law_unknown_ids,
    "detector_law_coverage": detector_law_coverage,
    "law_refresh": law_refresh,
    "findings_with_laws": findings_with_laws,
}
