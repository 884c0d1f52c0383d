"""Detectors of a caller's own, the shuffle-free logging scan, and law queries on landed responses."""

import contextlib
import io

from conftest import SF0001
from pyspark.sql import functions as F

from compliance_scan import rules
from compliance_scan.operators.ordering import order_findings
from compliance_scan.plans import queries
from compliance_scan.plans.scan import scan
from compliance_scan.sources.files import to_lines


def todo(sources):
    hits = to_lines(sources).where(F.col("line").contains("TODO"))
    return hits.select(F.lit("MY-001").alias("detector_id"), F.lit("LOW").alias("risk_level"), "file_path",
                       F.col("line_no").alias("line_number"), F.trim("line").alias("snippet"),
                       F.lit("an open point").alias("message"), F.array(F.lit("X-1")).alias("related_laws"))


def _sources(spark):
    return spark.createDataFrame([("a/B.java", "// TODO later\nlog.info(\"mail \" + email);"), ("a/C.java", " TODO ")],
                                 "file_path string, content string")


def test_own_detector_stands_after_the_built_in_ones(spark):
    found = order_findings(scan(_sources(spark), [todo, rules.LOGGING]))
    assert [(r.detector_id, r.file_path, r.line_number) for r in found.collect()] == [
        (rules.LOGGING, "a/B.java", 2), ("MY-001", "a/B.java", 1), ("MY-001", "a/C.java", 1)]


def test_own_detector_alone(spark):
    assert sorted(r.snippet for r in scan(_sources(spark), [todo]).collect()) == ["// TODO later", "TODO"]


def test_logging_scan_has_no_shuffle(spark):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        scan(_sources(spark), [rules.LOGGING]).explain()
    assert "Exchange hashpartitioning" not in out.getvalue() and "Window" not in out.getvalue()


def test_refresh_takes_only_well_formed_responses(spark):
    shapes = {r.shape: r.rows for r in queries.law_responses(spark, SF0001).groupBy(
        F.substring("body", 1, 4).alias("shape")).agg(F.count("*").alias("rows")).collect()}
    assert set(shapes) == {"<Law", "not ", "<Oth", "<!--"}
    texts = {r.id: r.full_text for r in queries.law_refresh(spark, SF0001).collect()}
    assert len(texts) == 40 and texts["PIPA-34"] is None
    assert all(t is None or t.startswith("text ") for t in texts.values()) and any(texts.values())


def test_unknown_requests(spark):
    assert {r.id for r in queries.law_unknown_ids(spark, SF0001).collect()} == {f"REQ-{i}" for i in range(7)}
    assert all(r.known for r in queries.detector_law_coverage(spark, SF0001).collect())
