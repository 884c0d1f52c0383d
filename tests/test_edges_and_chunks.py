"""Edge rows of the line model and the regex translation; chunked == unchunked."""

from conftest import SF0001, java

from compliance_scan import rules

LOG, ENC, CST, MKT, FIN, RET = (d.id for d in rules.DETECTORS)


def test_line_split_keeps_cr_and_trailing_empty_line(spark):
    from compliance_scan.sources.files import to_lines
    src = spark.createDataFrame([("a", "x\r\ny\n"), ("b", "")], "file_path STRING, content STRING")
    rows = sorted((r.file_path, r.line_no, r.line) for r in to_lines(src).collect())
    assert rows == [("a", 1, "x\r"), ("a", 2, "y"), ("a", 3, ""), ("b", 1, "")]


def test_snippet_trims_unicode_white_space(scan_files):
    src = "　 \t  log.info(\"email\");\u0085 \r"
    found = scan_files({"t.java": src}, [LOG])
    assert found[0]["snippet"] == 'log.info("email");'


def test_crlf_file_still_matches(scan_files):
    src = "class A {\r\n    private String cardNumber;\r\n}\r\n"
    found = scan_files({"w.java": src}, [FIN])
    assert [(f["line_number"], f["snippet"]) for f in found] == [(2, "private String cardNumber;")]


def test_unicode_case_folding_like_re2(scan_files):
    # RE2 folds case by Unicode rules: long s matches 's', the Kelvin sign matches 'k'
    src = java("    private String ſſn;", '    log.info("paſſword " + p);')
    found = scan_files({"u.java": src}, [ENC, LOG])
    assert sorted((f["detector_id"], f["line_number"]) for f in found) == [(ENC, 1), (LOG, 2)]


def test_ascii_word_boundary_next_to_korean(scan_files):
    # \\b is ASCII-only: Korean letters are not word characters
    src = java("    String 가cvv나 = x;", "    String xcvv = y;")
    found = scan_files({"k.java": src}, [FIN])
    assert [f["line_number"] for f in found] == [1]


def test_comment_inside_forward_budget_uses_a_line(scan_files):
    # comments are skipped for evidence but still use up the 10-line budget
    src = java("    private String ssn;", *["    // note"] * 9, "    x = encrypt(v);")
    beyond = java("    private String ssn;", *["    // note"] * 10, "    x = encrypt(v);")
    found = scan_files({"in.java": src, "out.java": beyond}, [ENC])
    assert [f["file_path"] for f in found] == ["out.java"]


def test_anchor_near_end_of_file(scan_files):
    src = java("class A {", "  void a() {}", '  @PostMapping("/z")')
    tail = java('  @PostMapping("/z") void z(String name)')
    found = scan_files({"a.java": src, "b.java": tail}, [CST])
    assert [(f["file_path"], f["line_number"]) for f in found] == [("b.java", 1)]


def test_prefilter_does_not_change_results(scan_files):
    from compliance_scan.sources.corpus import TEMPLATES
    files = {f"p{k}.java": "\n".join(TEMPLATES[(k * 11 + i * 5) % len(TEMPLATES)] for i in range(15))
             for k in range(20)}
    files["clean.java"] = "class Clean { int x; }"
    assert scan_files(files, prefilter=True) == scan_files(files, prefilter=False)


def test_chunked_lines_equal_whole_files(spark):
    """Tiny chunks force halos, cross-chunk annotation carries and file-wide retention."""
    from compliance_scan.plans.scan import scan, scan_lines
    from compliance_scan.sources.corpus import corpus_sources
    from compliance_scan.sources.files import to_lines
    src = corpus_sources(spark, SF0001)
    cols = ["detector_id", "file_path", "line_number", "snippet", "message"]
    whole = sorted(tuple(r) for r in scan(src).select(*cols).collect())
    for chunk in (3, 11, 1 << 16):
        assert sorted(tuple(r) for r in scan_lines(to_lines(src), chunk_lines=chunk).select(*cols).collect()) == whole
    assert len(whole) == 1021  # FIXTURES: sf0.001 total


def test_annotation_run_carried_across_chunks(scan_files):
    src = java("class A {", *["    @Encrypted"] * 9, "    private String ssn;",
               *["    @Column"] * 9, "    private String residentNumber;")
    whole = scan_files({"r.java": src}, [ENC, FIN])
    small = scan_files({"r.java": src}, [ENC, FIN], chunk_lines=4)
    assert whole == small
    # the first field is covered by its annotation run; the second run has no evidence
    assert [f["line_number"] for f in whole] == [21]


def test_retention_first_record_in_a_later_chunk(scan_files):
    src = java(*["    int a;"] * 9, "    private Long orderId;", "    private Long txnId;")
    kept = java("    private Long orderId;", *["    int a;"] * 9, "    Instant archivedAt;")
    whole = scan_files({"a.java": src, "b.java": kept}, [RET])
    assert whole == scan_files({"a.java": src, "b.java": kept}, [RET], chunk_lines=3)
    assert [(f["file_path"], f["line_number"]) for f in whole] == [("a.java", 10)]


def test_one_exchange_before_the_window(spark):
    """The line pass shuffles once, on (file_path, chunk), and sorts once for all frames."""
    from compliance_scan.plans.scan import chunk_with_halo, flag_lines, frame_lines
    from compliance_scan.sources.corpus import corpus_lines
    specs = rules.DETECTORS
    prepared = chunk_with_halo(flag_lines(corpus_lines(spark, SF0001), specs))
    framed = frame_lines(prepared, specs, summary=None)
    plan = framed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(file_path") == 1
    assert plan.count("Sort [file_path") == 1
