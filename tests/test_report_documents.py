"""Reports as ordered fragments: whole documents of files, folders and scans."""

import glob
import json

import pytest
from conftest import java
from pyspark.sql import functions as F

from compliance_scan import rules
from compliance_scan.operators import report
from compliance_scan.operators.ordering import numbered
from compliance_scan.plans.scan import scan

FILES = {
    "src/a/b.java": java('log.info("email " + e); // <b> & "q"', "    private String cardNumber;", "    Long orderId;"),
    "src/a.java": java("    private String residentNumber;"),
    "src/a b/c.java": java('    log.warn("전화 " + p);', '    log.warn("phone");'),
    "src/clean.java": "class Clean {}",
}
AT = "2026-03-23T14:30:00Z"


@pytest.fixture(scope="module")
def scanned(spark):
    src = spark.createDataFrame(list(FILES.items()), "file_path STRING, content STRING").repartition(3)
    return src, scan(src)


def documents(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.target_path, r.seq)):
        out.setdefault(r.target_path, []).append(r)
    assert all([r.seq for r in part] == list(range(len(part))) for part in out.values())
    return {t: "".join(r.text for r in part) for t, part in out.items()}


def test_directory_text_numbers_findings_through_all_files(spark, scanned):
    text = documents(report.text_report(*scanned, "src", AT))["src"]
    lines = text.split("\n")
    assert lines[:6] == [report.TEXT_TITLE, f"Scanned: {AT}", "Target:  src", "Files:   4", "Findings: 6", ""]
    assert [x for x in lines if x.startswith("---")] == [f"--- Finding {i} ---" for i in range(1, 7)]
    assert [x.split()[1] for x in lines if "Location:" in x][2:3] == ["src/a/b.java:3"]
    # names of one directory in byte order: "a" < "a b" < "a.java"
    assert [x[13:] for x in lines if "Location:" in x] == [
        "src/a/b.java:1", "src/a/b.java:2", "src/a/b.java:3", "src/a b/c.java:1", "src/a b/c.java:2", "src/a.java:1"]
    assert text.endswith(rules.DISCLAIMER + "\n")


def test_json_documents_parse_to_whole_reports(spark, scanned):
    made = documents(report.json_report(*scanned, "src", AT))["src"]
    doc = json.loads(made)
    assert list(doc) == ["scanned_at", "target_path", "files_scanned", "total_findings", "findings", "disclaimer"]
    assert (doc["scanned_at"], doc["files_scanned"], doc["total_findings"]) == (AT, 4, 6) and len(doc["findings"]) == 6
    assert list(doc["findings"][0]) == ["detector_id", "risk_level", "file_path", "line_number", "snippet", "message", "related_laws"]
    assert doc["findings"][0]["snippet"].endswith('// <b> & "q"') and "\\u003cb\\u003e \\u0026" in made
    each = {t: json.loads(x) for t, x in documents(report.json_report(*scanned, at=AT)).items()}
    assert {t: (d["files_scanned"], d["total_findings"], len(d["findings"])) for t, d in each.items()} == {
        "src/a/b.java": (1, 3, 3), "src/a.java": (1, 1, 1), "src/a b/c.java": (1, 2, 2), "src/clean.java": (1, 0, 0)}
    folder = F.regexp_extract(F.col("file_path"), r"^(.*)/[^/]*$", 1)
    folders = {t: json.loads(x)["total_findings"] for t, x in documents(report.json_report(*scanned, folder)).items()}
    assert folders == {"src/a": 3, "src": 1, "src/a b": 2}


def test_nothing_scanned_and_nothing_found(spark, scanned):
    src, found = scanned
    assert documents(report.text_report(src.limit(0), found.limit(0), "src")) == {}
    clean = documents(report.json_report(src, found.limit(0), "src"))["src"]
    assert json.loads(clean)["findings"] == [] and '"total_findings":0' in clean


def test_written_reports_are_the_documents(spark, scanned, tmp_path):
    for name, make in (("text", report.text_report), ("json", report.json_report)):
        rows = make(*scanned, "src", AT)
        report.write_report(rows, str(tmp_path / name))
        files = sorted(glob.glob(f"{tmp_path}/{name}/part-*"))
        written = "".join(open(f, encoding="utf-8").read() for f in files)
        whole = documents(rows)["src"]
        assert written == whole if name == "text" else json.loads(written) == json.loads(whole)


def test_one_scan_of_the_corpus_for_the_findings(spark, scanned, monkeypatch):
    """The fragments are made from materialised findings and heads; no regex runs again."""
    src, found = scanned
    text = report.text_report(src, found, "src")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in text


def test_places_with_ties_null_groups_and_many_partitions(spark):
    rows = [(g, i % 5) for g in ("a", None, "b") for i in range(40)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(9)
    made = numbered(df, [F.col("v")], F.col("g")).collect()
    by = {}
    for r in made:
        by.setdefault(r.g, []).append((r.ordinal, r.v))
    assert {g: len(x) for g, x in by.items()} == {"a": 40, None: 40, "b": 40, "c": 1}
    for placed in by.values():
        placed.sort()
        assert [n for n, _ in placed] == list(range(1, len(placed) + 1))
        assert [v for _, v in placed] == sorted((v for _, v in placed), key=lambda v: (v is not None, v))
    assert sorted(r.place for r in numbered(df, [F.col("v")], name="place").collect()) == list(range(1, 122))
