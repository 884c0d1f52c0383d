"""Law table and joins, reports and sinks, file and streaming sources."""

import json
import os
import tempfile
import time

import pytest
from conftest import java

from compliance_scan import rules


# --- laws (S6-S8, A6-A10) -----------------------------------------------------------

def test_bundled_laws(spark):
    from compliance_scan.sources.laws import load_laws
    laws = load_laws(spark).orderBy("ord").collect()
    assert len(laws) == 40
    assert sum(r.risk_level == "HIGH" for r in laws) == 26
    assert len({r.id for r in laws}) == 40
    assert [r.id for r in laws][:2] == ["CIA-15", "CIA-17"] and laws[-1].id == "PIPA-34"
    acts = {r.id.split("-")[0] for r in laws}
    assert acts == {"CIA", "ECA", "NIA", "PIPA"}
    assert all(r.full_text_ko is None for r in laws)


def test_lookup_unknown_and_detector_coverage(spark):
    from compliance_scan.operators import laws as ops
    from compliance_scan.operators.detectors import detector_catalog
    from compliance_scan.sources.laws import load_laws
    laws = load_laws(spark)
    req = spark.createDataFrame([("PIPA-29",), ("NIA-50",), ("XYZ-1",)], "id STRING")
    got = {r.id: r.name_en for r in ops.lookup(req, laws).collect()}
    assert got["PIPA-29"].startswith("PIPA Article 29") and got["XYZ-1"] is None
    assert [r.id for r in ops.unknown_ids(req, laws).collect()] == ["XYZ-1"]
    assert ops.detector_law_gaps(detector_catalog(spark), laws).count() == 0


def test_override_file_replaces_and_duplicates_fail(spark, tmp_path):
    from compliance_scan.sources.laws import load_laws
    good = tmp_path / "laws.json"
    good.write_text(json.dumps({"laws": [
        {"id": "T-1", "name_ko": "가", "name_en": "A", "summary": "s", "url": "u", "risk_level": "HIGH"},
        {"id": "T-2", "name_ko": "나", "name_en": "B", "summary": "s", "url": "u", "risk_level": "MEDIUM"}]}))
    rows = load_laws(spark, str(good), multi_line=True).orderBy("ord").collect()
    assert [(r.ord, r.id) for r in rows] == [(1, "T-1"), (2, "T-2")]
    dup = tmp_path / "dup.jsonl"
    dup.write_text('{"id": "D-1", "name_en": "x"}\n{"id": "D-1", "name_en": "y"}\n')
    with pytest.raises(ValueError, match="duplicate law ID: D-1"):
        load_laws(spark, str(dup))


def test_refresh_from_landed_responses(spark):
    from compliance_scan.operators.laws import refresh
    from compliance_scan.sources.laws import load_laws
    laws = load_laws(spark).where("id IN ('PIPA-15', 'PIPA-17', 'PIPA-18', 'PIPA-21', 'PIPA-29')")
    names = {r.id: r.name_ko for r in laws.collect()}
    two = ("<LawSearch><law><법령명_한글>a</법령명_한글><조문내용>first text</조문내용></law>"
           "<law><법령명_한글>b</법령명_한글><조문내용>second</조문내용></law></LawSearch>")
    responses = spark.createDataFrame([
        (names["PIPA-15"], two),
        (names["PIPA-17"], "<LawSearch></LawSearch>"),
        (names["PIPA-18"], "not xml at all"),
        (names["PIPA-21"], "<Other><law><조문내용>x</조문내용></law></Other>"),
        (names["PIPA-29"], "<!-- a -->\n<!-- b -->" + two),
        ("unused", "<!-- a --><Other/><!-- b -->" + two),
    ], "query STRING, body STRING")
    got = {r.id: r.full_text for r in refresh(laws, responses).collect()}
    assert got == {"PIPA-15": "first text", "PIPA-17": None, "PIPA-18": None,
                   "PIPA-21": None, "PIPA-29": "first text"}


# --- reports (A3-A5, K1, K2) ------------------------------------------------------------

SAMPLE = {
    "src/a/b.java": java('log.info("email " + e);', "    private String cardNumber;"),
    "src/a.java": java("    private String residentNumber;"),
    "src/clean.java": "class Clean {}",
}


def _findings(spark):
    from compliance_scan.plans.scan import scan
    src = spark.createDataFrame(list(SAMPLE.items()), "file_path STRING, content STRING")
    return src, scan(src)


def test_summary_counts_clean_files(spark):
    from compliance_scan.operators.report import summary
    src, f = _findings(spark)
    [whole] = summary(src, f, target="src").collect()
    assert (whole.files_scanned, whole.total_findings, whole.disclaimer) == (3, 3, rules.DISCLAIMER)
    per_file = {r.target_path: (r.files_scanned, r.total_findings) for r in summary(src, f).collect()}
    assert per_file == {"src/a/b.java": (1, 2), "src/a.java": (1, 1), "src/clean.java": (1, 0)}
    [stamped] = summary(src, f, target="src", with_time=True).collect()
    assert stamped.scanned_at.endswith("Z") and "T" in stamped.scanned_at


def test_walk_order_and_global_ordinal(spark):
    from compliance_scan.operators.ordering import with_global_ordinal
    _, f = _findings(spark)
    rows = with_global_ordinal(f).orderBy("ordinal").collect()
    # a/b.java sorts before a.java in a directory walk
    assert [(r.ordinal, r.file_path, r.detector_id) for r in rows] == [
        (1, "src/a/b.java", "PIPA-LOG-001"), (2, "src/a/b.java", "CIA-ENC-001"),
        (3, "src/a.java", "PIPA-ENC-001")]


def test_json_keys_and_text_blocks(spark):
    from compliance_scan.operators.report import finding_blocks, finding_json, text_report
    src, f = _findings(spark)
    docs = [json.loads(r.json) for r in finding_json(f).collect()]
    assert all(list(d) == ["detector_id", "risk_level", "file_path", "line_number", "snippet",
                           "message", "related_laws"] for d in docs)
    blocks = {(r.target_path, r.ordinal): r.text for r in finding_blocks(f).collect()}
    text = blocks[("src/a/b.java", 2)]
    assert text.startswith("--- Finding 2 ---\n  Detector:  CIA-ENC-001\n  Risk:      HIGH\n")
    assert "  Location:  src/a/b.java:2\n" in text and text.endswith("  Laws:      CIA-19\n\n")
    rep = text_report(src, f).where("target_path = 'src/clean.java'").orderBy("seq").collect()
    assert [r.seq for r in rep] == [0, 1] and "Findings: 0" in rep[0].text
    assert rep[1].text == rules.DISCLAIMER + "\n"


def test_file_ordinal_with_small_buckets(spark):
    from compliance_scan.operators.ordering import with_file_ordinal
    rows = [(1, "PIPA-LOG-001", "f", n) for n in (5, 1, 9, 3)] + [(5, "CIA-ENC-001", "f", 2)]
    df = spark.createDataFrame(rows, "detector_ord INT, detector_id STRING, file_path STRING, line_number INT")
    got = sorted((r.ordinal, r.detector_ord, r.line_number) for r in with_file_ordinal(df).collect())
    assert got == [(1, 1, 1), (2, 1, 3), (3, 1, 5), (4, 1, 9), (5, 5, 2)]


# --- file sources (S1-S5) and streaming ------------------------------------------------------

def _tree(root):
    os.makedirs(f"{root}/a", exist_ok=True)
    with open(f"{root}/a/b.java", "w") as fh:
        fh.write('log.info("email " + e);\n')
    with open(f"{root}/a.java", "w") as fh:
        fh.write("    private String cardNumber;")
    with open(f"{root}/notes.kt", "w") as fh:
        fh.write('log.info("phone " + p)')
    with open(f"{root}/sp ace+x.java", "w") as fh:
        fh.write("class S {}")


def test_read_folder_single_file_and_missing(spark, tmp_path):
    from compliance_scan.sources.files import read_sources
    root = str(tmp_path / "repo")
    _tree(root)
    got = sorted(r.file_path.replace(root, "") for r in read_sources(spark, root).collect())
    assert got == ["/a.java", "/a/b.java", "/sp ace+x.java"]
    kt = read_sources(spark, root, "*.kt").collect()
    assert [os.path.basename(r.file_path) for r in kt] == ["notes.kt"]
    # a file path is read regardless of the pattern
    one = read_sources(spark, f"{root}/notes.kt", "*.java").collect()
    assert len(one) == 1 and one[0].content.startswith("log.info")
    with pytest.raises(Exception):
        read_sources(spark, f"{root}/missing").collect()


def test_streaming_scan_of_arriving_files(spark, tmp_path):
    from compliance_scan.streaming.files import scan_stream
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    _tree(root)
    q = scan_stream(spark, root, out, checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    rows = spark.read.parquet(out).collect()
    assert sorted((os.path.basename(r.file_path), r.detector_id) for r in rows) == [
        ("a.java", "CIA-ENC-001"), ("b.java", "PIPA-LOG-001")]


def test_stream_restart_scans_each_file_once(spark, tmp_path):
    from compliance_scan.streaming.files import scan_stream

    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    for k in range(4):
        (folder / f"F{k}.java").write_text('log.info("email " + email);\n')
        if k in (1, 3):
            scan_stream(spark, str(folder), str(out), max_files_per_trigger=1).awaitTermination()
    found = spark.read.parquet(str(out)).select("file_path").collect()
    assert len(found) == 4 and len(set(found)) == 4


def test_stream_has_the_findings_of_the_batch(spark, tmp_path):
    from compliance_scan.plans.scan import scan
    from compliance_scan.sources.corpus import TEMPLATES
    from compliance_scan.sources.files import read_sources
    from compliance_scan.streaming.files import scan_stream

    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    for k in range(12):
        (folder / f"F{k}.java").write_text("\n".join(TEMPLATES[(k * 7 + n * n) % len(TEMPLATES)] for n in range(40)))
    scan_stream(spark, str(folder), str(out), max_files_per_trigger=5).awaitTermination()
    found = spark.read.parquet(str(out))
    want = scan(read_sources(spark, str(folder)))
    assert sorted(map(tuple, found.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert found.count() > 20


def test_scan_writes_nothing_and_a_cluster_needs_a_shared_folder(spark, tmp_path, monkeypatch):
    import types

    import pytest

    from compliance_scan import session
    from compliance_scan.plans.scan import scan

    src = spark.createDataFrame([("a.java", 'log.info("email " + email);')], "file_path STRING, content STRING")
    monkeypatch.setattr("compliance_scan.plans.scan.materialize", lambda df: pytest.fail("a plain scan must not materialise"))
    assert scan(src).count() == 1
    sc = types.SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    none = types.SimpleNamespace(sparkContext=sc, conf=types.SimpleNamespace(get=lambda key, default=None: default))
    with pytest.raises(RuntimeError):
        session.need_checkpoint_dir(none)


def test_law_summaries_are_hedged_where_the_name_is_a_prohibition(spark):
    from compliance_scan.sources.laws import LAWS

    said = {row[0]: row[-1] for row in LAWS}
    assert all(said[i] for i in said) and len(said) == 40
    assert all("may" in said[i] for i in ("ECA-21", "NIA-27", "NIA-28", "NIA-44-7"))
