"""Folders walked whole, files larger than a row, and load order over several files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from compliance_scan.operators import laws as law_ops
from compliance_scan.operators import report
from compliance_scan.plans.scan import scan, scan_lines, scan_path
from compliance_scan.sources import tree
from compliance_scan.sources.files import read_lines, read_sources, to_lines
from compliance_scan.sources.laws import load_laws

LOG_LINE = 'log.info("email " + e);\n'


def make(root, files):
    for name, data in files.items():
        os.makedirs(os.path.dirname(f"{root}/{name}") or root, exist_ok=True)
        with open(f"{root}/{name}", "wb") as fh:
            fh.write(data if isinstance(data, bytes) else data.encode())


def test_inventory_hides_no_name_and_counts_what_cannot_be_read(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "repo")
    make(root, {"A.java": LOG_LINE, "_A.java": LOG_LINE, ".b/C.java": LOG_LINE, "_c/.d/.E.java": LOG_LINE,
                "empty.java": "", "notes.kt": LOG_LINE, "x y/ü%20+.java": LOG_LINE, "latin.java": b"// \xe9\nString ssn;\n"})
    os.symlink(f"{root}/nowhere", f"{root}/gone.java")
    os.makedirs(f"{root}/folder.java")
    os.symlink(root, f"{root}/loop.java")  # a link to a folder is no folder: it is found by its name and cannot be read
    found = {r.file_path.removeprefix(root + "/"): r for r in tree.read_tree(spark, root).collect()}
    assert sorted(found) == sorted(["A.java", "_A.java", ".b/C.java", "_c/.d/.E.java", "empty.java", "x y/ü%20+.java",
                                    "latin.java", "gone.java", "loop.java"])
    assert found["empty.java"].content == "" and found["latin.java"].content == "// �\nString ssn;\n"
    assert {n for n, r in found.items() if r.error} == {"gone.java", "loop.java"}
    assert found["gone.java"].error.startswith("FileNotFoundError") and found["gone.java"].content is None
    src = tree.read_tree(spark, root)
    whole = report.summary(src, scan(src), target=root).first()
    assert (whole.files_scanned, whole.total_findings) == (9, 6)
    assert {r.file_path for r in tree.inventory(spark, root, "*.kt").collect()} == {f"{root}/notes.kt"}


def test_file_that_vanishes_between_listing_and_reading(spark, tmp_path):
    root = str(tmp_path / "repo")
    make(root, {"a.java": LOG_LINE, "b.java": LOG_LINE})
    src = tree.read_tree(spark, root)  # listed, not yet read
    os.unlink(f"{root}/b.java")
    assert {os.path.basename(r.file_path): r.error is None for r in src.collect()} == {"a.java": True, "b.java": False}


def test_root_that_is_a_file_or_missing_and_folders_that_cannot_be_listed(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "repo")
    make(root, {"sub/notes.kt": LOG_LINE})
    one = tree.read_tree(spark, f"{root}/sub/notes.kt", "*.java").collect()
    assert [(r.file_path, r.content) for r in one] == [(f"{root}/sub/notes.kt", LOG_LINE)]
    assert tree.read_tree(spark, root).collect() == []
    assert [r.file_path for r in tree.read_tree(spark, f"file:{root}/", "").collect()] == []
    with pytest.raises(FileNotFoundError):
        tree.read_tree(spark, f"{root}/missing")
    listed = list(tree._list(iter([tree.pa.RecordBatch.from_arrays([tree.pa.array([f"{root}/missing"])], ["path"])])))
    assert listed[0].column(3)[0].as_py().startswith("FileNotFoundError")


def test_files_beyond_a_row_are_named_and_not_read(spark, tmp_path):
    root = str(tmp_path / "repo")
    make(root, {"a.java": LOG_LINE, "b.java": LOG_LINE * 50})
    found = {os.path.basename(r.file_path): r for r in tree.read_tree(spark, root, row_bytes=100).collect()}
    assert found["a.java"].content == LOG_LINE and found["b.java"].error == "larger than a row"


@pytest.mark.parametrize("glob, yes, no", [
    ("*.java", ["a.java", ".java", "a\n.java"], ["a.javax", "a.jav", "xjava"]),
    ("?.k[ts]", ["a.kt", "é.ks"], ["ab.kt", ".kt", "a.kx"]),
    ("[a-c]*", ["a", "cx"], ["d", ""]), ("[^a-c]?", ["d1"], ["a1"]), ("a\\*b", ["a*b"], ["axb"]), ("[\\]x]", ["]", "x"], ["\\"]),
])
def test_name_patterns(glob, yes, no):
    import re
    made = re.compile(tree.name_pattern(glob))
    assert all(made.match(x) for x in yes) and not any(made.match(x) for x in no)


def test_bad_name_patterns():
    for glob in ("[a", "a\\", "[]", "[a-", "[-a]"):
        with pytest.raises(ValueError):
            tree.name_pattern(glob)


EDGES = {"crlf.java": "a\r\nb\r\n", "plain.java": "a\nb", "one.java": "x", "feed.java": "\n", "feeds.java": "\n\n\n",
         "bom.java": b"\xef\xbb\xbfString ssn;\nb\n", "bom1.java": b"\xef\xbb\xbfa", "cr.java": "a\rb\nc\r",
         "ü %41+.java": "전화\nx\n", "long.java": "y" * 3000 + "\nz" * 2000 + "\n"}


@pytest.mark.parametrize("split", ["64", "1000", "134217728"])
def test_lines_of_split_files_equal_those_of_whole_ones(spark, tmp_path, split):
    make(str(tmp_path), EDGES)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        whole = sorted(map(tuple, to_lines(read_sources(spark, str(tmp_path))).collect()))
        lines = read_lines(spark, str(tmp_path))
        assert sorted(map(tuple, lines.collect())) == whole
        if split == "64":
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 50
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_large_files_are_scanned_as_lines(spark, tmp_path):
    big = "\n".join(["class A {", *["    @Encrypted"] * 50, "    private String ssn;", *["    int a;"] * 500,
                     "    private String residentNumber;", '    log.info("phone");', "    Long orderId;"])
    make(str(tmp_path), {"big.java": big, "small.java": LOG_LINE, "d/c.java": "String cardNumber;"})
    src = read_sources(spark, str(tmp_path))
    want = sorted(map(tuple, scan(src).collect()), key=str)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        for limit in (0, 1000, 1 << 20):
            assert sorted(map(tuple, scan_path(spark, str(tmp_path), row_bytes=limit).collect()), key=str) == want
        assert read_sources(spark, str(tmp_path), row_bytes=1000).count() == 2
        assert read_lines(spark, str(tmp_path), larger_than=1000).select("file_path").distinct().count() == 1
        assert sorted(map(tuple, scan_lines(read_lines(spark, str(tmp_path)), materialized=True).collect()), key=str) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def law(i):
    return {"id": f"T-{i}", "name_ko": f"가{i}", "name_en": "A", "summary": "s", "url": "u", "risk_level": "HIGH"}


def test_load_order_over_several_files(spark, tmp_path, monkeypatch):
    docs, lines, tables = (tmp_path / n for n in ("docs", "lines", "tables.parquet"))
    parts = {"b.json": [7, 3], "a.json": [9, 1, 5], "c.json": [2]}
    want = [(1, "T-9"), (2, "T-1"), (3, "T-5"), (4, "T-7"), (5, "T-3"), (6, "T-2")]
    make(str(docs), {n: json.dumps({"laws": [law(i) for i in ids]}, indent=1) for n, ids in parts.items()})
    make(str(lines), {n: "".join(json.dumps(law(i)) + "\n" for i in ids) + "\n" for n, ids in parts.items()})
    os.makedirs(tables)
    for n, ids in parts.items():
        import pyarrow as pa
        import pyarrow.parquet as pq
        pq.write_table(pa.Table.from_pylist([law(i) for i in ids]), f"{tables}/{n[0]}.parquet")
    for made in (load_laws(spark, str(docs), multi_line=True), load_laws(spark, str(lines)), load_laws(spark, str(tables))):
        assert [(r.ord, r.id) for r in made.orderBy("ord").collect()] == want
        assert made.where(F.col("full_text_ko").isNotNull()).count() == 0
        cited = spark.createDataFrame([("T-9",), ("T-0",)], "id string")
        joined = law_ops.lookup(cited, made)
        assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.id, r.name_ko) for r in joined.collect()) == [("T-0", None), ("T-9", "가9")]
    monkeypatch.setattr("compliance_scan.sources.laws.BROADCAST_BYTES", 10)
    assert "Broadcast" not in law_ops.lookup(cited, load_laws(spark, str(lines)))._jdf.queryExecution().optimizedPlan().toString()
    make(str(docs), {"d.json": json.dumps({"laws": [law(3)]})})
    with pytest.raises(ValueError, match="duplicate law ID: T-3"):
        load_laws(spark, str(docs), multi_line=True)


def test_earliest_response_counts(spark):
    from compliance_scan.operators.laws import refresh
    laws = load_laws(spark).where("id = 'PIPA-15'")
    name = laws.first().name_ko
    body = "<LawSearch><law><조문내용>{}</조문내용></law></LawSearch>".format
    rows = [(name, body("aaa"), 5), (name, body("zzz"), 2), (name, "<LawSearch></LawSearch>", 1), (name, body("bbb"), None)]
    timed = spark.createDataFrame(rows, "query string, body string, arrived long")
    assert refresh(laws, timed).first().full_text == "zzz"
    assert refresh(laws, timed.drop("arrived")).first().full_text == "aaa"
    assert refresh(laws, timed.where("arrived is null")).first().full_text == "bbb"
