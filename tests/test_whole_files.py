"""Whole files are scanned in one pass without a shuffle; lines that carry nothing stay out of the exchange."""

import contextlib
import io
import random

import numpy as np
from conftest import SF0001, java

from compliance_scan import rules
from compliance_scan.functions import re2
from compliance_scan.functions.text import FLAG_BITS
from compliance_scan.plans.scan import carrying, flag_lines, frames, scan, scan_lines
from compliance_scan.sources.corpus import TEMPLATES, corpus_sources
from compliance_scan.sources.files import to_lines

LOG, ENC, CST, MKT, FIN, RET = (d.id for d in rules.DETECTORS)


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def test_scan_reads_and_flags_once_without_a_shuffle(spark):
    for found in (scan(corpus_sources(spark, SF0001)), scan(corpus_sources(spark, SF0001), [LOG])):
        text = plan(found)
        assert text.count("FileScan") == 1
        assert text.count("ArrowEvalPython") == 2  # the flags of a file, the field of a finding
        assert "Window" not in text and "Join" not in text and "hashpartitioning" not in text


def test_detectors_without_a_field_need_no_second_projection(spark):
    assert plan(scan(corpus_sources(spark, SF0001), [CST, MKT])).count("ArrowEvalPython") == 1


def test_lines_that_carry_nothing_never_enter_the_exchange(spark):
    marked = [(f"f{k}.java", "\n".join(["    int total;"] * 99 + ["    private String ssn;"] + ["    int total;"] * 100)) for k in range(50)]
    lines = to_lines(spark.createDataFrame(marked, "file_path string, content string"))
    specs = rules.resolve([ENC, CST])
    assert carrying(flag_lines(lines, specs)).count() == 50
    framed = frames(lines, specs)
    assert framed.count() == 50
    moved = framed._jdf.queryExecution().optimizedPlan().toString()
    below = moved[moved.index("RepartitionByExpression"):]
    assert "OR isnotnull(" in below[:below.index("LogicalRDD")]


def test_annotation_runs_of_whole_files():
    rng = random.Random(4)
    annot, ev = 1 << FLAG_BITS["annot"], 1 << FLAG_BITS["enc_ev"]
    for _ in range(300):
        files = [[rng.choice([0, annot, annot, annot | ev, ev]) for _ in range(rng.randrange(1, 9))] for _ in range(3)]
        want = []
        for f in files:
            for i in range(len(f)):
                j, has = i - 1, False
                while j >= 0 and f[j] & annot:
                    has |= bool(f[j] & ev)
                    j -= 1
                want.append(has)
        starts = np.cumsum([0] + [len(f) for f in files[:-1]])
        assert re2._annotated(np.array(sum(files, [])), starts, ev).tolist() == want


def test_random_files_whole_and_as_lines(spark):
    """Dense mixtures of all templates, empty files, files of one line and trailing newlines."""
    rng = random.Random(9)
    lines = list(TEMPLATES) + ["}", "{", "} {", "{ } }", "    @Encrypted @Mask", '    log.info("x ſſn " + ſſn)', "\r", "//"]
    files = [(f"f{i}.java", "\n".join(rng.choices(lines, k=rng.choice([0, 1, 5, 40, 120]))) + rng.choice(["", "\n"]))
             for i in range(150)] + [("null.java", None), ("empty.java", "")]
    src = spark.createDataFrame(files, "file_path string, content string").repartition(3)
    whole = sorted(map(tuple, scan(src).collect()), key=str)
    assert len({r[1] for r in whole}) == 6
    assert sorted(map(tuple, scan(src, prefilter=False).collect()), key=str) == whole
    for chunk in (2, 13):
        assert sorted(map(tuple, scan_lines(to_lines(src), chunk_lines=chunk).collect()), key=str) == whole


def test_field_is_what_the_rules_dialect_matches(scan_files):
    # RE2 folds the long s and the Kelvin sign, but neither the dotless i nor the dotted capital I
    src = java('log.info("emaıl " + email);', 'log.info("EMAİL " + phone);', 'log.info("paſſword");', "String reſidentNumber;",
               "String booKkeeping, booK; Long TXN_ıD, txn_id;", "String ſſn, ssn;")
    found = scan_files({"a.java": src}, [LOG, ENC, RET])
    assert [(f["line_number"], f["message"].split("(")[1].split(")")[0]) for f in found] == [
        (1, "email"), (2, "phone"), (3, "paſſword"), (4, "reſidentNumber"), (6, "ſſn"), (5, "txn_id")]


def test_counts_take_one_pass_and_equal_the_findings(spark):
    from pyspark.sql import functions as F

    from compliance_scan.operators import report
    from compliance_scan.plans.scan import scan_counts
    src = corpus_sources(spark, SF0001).unionByName(spark.createDataFrame(
        [("src/empty.java", ""), ("src/unread.java", None), ("src/clean.java", "class C {}")], "file_path string, content string"))
    folder = F.regexp_extract(F.col("file_path"), r"^(.*)/[^/]*$", 1)
    for target in (None, "src", folder):
        for ids in (None, [MKT], [RET, LOG]):
            counted = report.header(scan_counts(src, ids, target))
            assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, report.summary(src, scan(src, ids), target).collect()))
    text = plan(scan_counts(corpus_sources(spark, SF0001), target="src"))
    assert text.count("FileScan") == 1 and text.count("ArrowEvalPython") == 1 and "Join" not in text


def test_sparse_corpus_is_mostly_plain(spark):
    src = corpus_sources(spark, SF0001, percent=1)
    specs = rules.resolve(None)
    flagged = flag_lines(to_lines(src), specs)
    kept, every = carrying(flagged).count(), flagged.count()
    assert 0 < kept < every / 50
    assert sorted(map(tuple, scan(src).collect()), key=str) == sorted(map(tuple, scan_lines(to_lines(src)).collect()), key=str)
