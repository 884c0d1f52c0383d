"""Unit cases per detector (own snippets, same shapes as the original's tests)."""

from conftest import java

from compliance_scan import rules

LOG, ENC, CST, MKT, FIN, RET = (d.id for d in rules.DETECTORS)


def _ids(found, det=None):
    return [(f["detector_id"], f["line_number"]) for f in found if det is None or f["detector_id"] == det]


# --- PIPA-LOG-001 -----------------------------------------------------------------

def test_logging_hits_fields_and_comment_lines(scan_files):
    src = java(
        "class A {",
        '  void f() { log.info("user email " + email); }',
        '  void g() { log.debug("Phone: " + p); }',
        '  // log.error("password " + pw);',
        '  void h() { log.warn("이름 " + n); }',
        "}")
    found = scan_files({"A.java": src}, [LOG])
    assert _ids(found) == [(LOG, 2), (LOG, 3), (LOG, 4), (LOG, 5)]
    assert [f["message"].split("(")[1].split(")")[0] for f in found] == ["email", "Phone", "password", "이름"]
    assert found[0]["risk_level"] == "MEDIUM" and found[0]["related_laws"] == ["PIPA-29"]
    assert found[0]["snippet"] == 'void f() { log.info("user email " + email); }'


def test_logging_clean_and_receiver_rules(scan_files):
    src = java('log.info("service started");',
               'logger.info("email " + e);',       # "logger." is not "log."
               'catalog.info("email " + e);')      # unanchored: "catalog." contains "log."
    assert _ids(scan_files({"B.java": src}, [LOG])) == [(LOG, 3)]


# --- PIPA-ENC-001 -----------------------------------------------------------------

def test_encryption_hits_and_annotation_suppression(scan_files):
    src = java(
        "public class Member {",
        "    private String residentNumber;",
        "",
        "    @Encrypted",
        "    private String ssn;",
        "",
        '    @Convert(converter = EncryptConverter.class)',
        "    private String 주민번호;",
        "",
        "    private String 주민번호;",
        "}")
    found = scan_files({"M.java": src}, [ENC])
    assert _ids(found) == [(ENC, 2), (ENC, 10)]
    assert "(residentNumber)" in found[0]["message"] and "(주민번호)" in found[1]["message"]
    assert found[0]["related_laws"] == ["PIPA-24-2", "PIPA-29"]


def test_encryption_blank_line_breaks_annotation_run(scan_files):
    src = java("    @Encrypted", "", "    private String ssn;")
    assert _ids(scan_files({"M.java": src}, [ENC])) == [(ENC, 3)]


def test_encryption_forward_scan_stops_at_next_field(scan_files):
    protected = java("    private String ssn;", "    // set below", "    void set(String v) {",
                     "        this.ssn = encrypt(v);", "    }")
    crossed = java("    private String ssn;", "    private String name;", "    void set(String v) {",
                   "        this.name = encrypt(v);", "    }")
    far = java("    private String ssn;", *["    x();"] * 10, "        this.ssn = encrypt(v);")
    found = scan_files({"a.java": protected, "b.java": crossed, "c.java": far}, [ENC])
    assert [(f["file_path"], f["line_number"]) for f in found] == [("b.java", 1), ("c.java", 1)]


def test_encryption_odd_semantics_kept(scan_files):
    names = java("// private String ssn;",           # comment: skipped
                 "    String className = x;")        # 'ssN' inside className triggers
    unencrypted = java("    String unencryptedSsn = y;")  # any 'encrypt' substring suppresses
    found = scan_files({"d.java": names, "e.java": unencrypted}, [ENC])
    assert [(f["file_path"], f["line_number"]) for f in found] == [("d.java", 2)]


# --- PIPA-CST-001 -----------------------------------------------------------------

def test_consent_missing_and_present(scan_files):
    src = java(
        "class C {",
        '  @PostMapping("/join")',
        "  public void join(Form f) {",
        "    save(f.getEmail());",
        "  }",
        '  @PostMapping("/ok")',
        "  public void ok(Form f) {",
        "    if (!f.isConsentGiven()) { return; }",
        "    save(f.getEmail());",
        "  }",
        '  @GetMapping("/find")',
        "  public void find(String email) { }",
        '  @PutMapping("/dis")',
        "  public void dis(String email) { disagree(); }",
        "}")
    found = scan_files({"C.java": src}, [CST])
    assert _ids(found) == [(CST, 2)]
    assert found[0]["message"].startswith("Endpoint accepts possible personal data")


def test_consent_block_of_braces_in_path(scan_files):
    # the path's braces open and close on the annotation line: the block is that line only
    src = java('  @PutMapping("/a/{id}")', "  public void put(String email) {", "  }")
    assert scan_files({"P.java": src}, [CST]) == []


def test_consent_block_without_closing_brace_runs_to_cap_or_eof(scan_files):
    open_block = java('  @PostMapping("/x")', "  public void x(Form f) {", "    f.getPhone();")
    capped = java('  @PostMapping("/y")', *["    step();"] * 30, "    f.getPhone();")
    found = scan_files({"o.java": open_block, "p.java": capped}, [CST])
    assert [(f["file_path"], f["line_number"]) for f in found] == [("o.java", 1)]


# --- NIA-MKT-001 -----------------------------------------------------------------

def test_marketing_hit_consent_subscription_korean(scan_files):
    hit = java('  String body = "spring promotion";', "  mailer.sendEmail(to, body);")
    consented = java("  if (ledger.consentOf(user).isEmpty()) return;", '  String body = "promotion";',
                     "  mailer.send(to, body);")
    unsub = java('  String body = "newsletter";', '  String f = "to end the subscription write to us";', "  push.notifyAll(to);")
    korean = java('  String body = "광고 안내";', "  sms.dispatch(to, body);")
    comment_intent = java("  // marketing newsletter", "  mailer.send(to, body);")
    declaration = java('  String body = "promotion";', "  void sendPromotion(String to) {}")
    found = scan_files({"h.java": hit, "c.java": consented, "u.java": unsub, "k.java": korean,
                        "m.java": comment_intent, "d.java": declaration}, [MKT])
    assert [(f["file_path"], f["line_number"]) for f in found] == [("h.java", 2), ("k.java", 2), ("u.java", 3)]


def test_marketing_context_radius_is_ten_lines(scan_files):
    near = java('  String b = "promotion";', *["  x();"] * 9, "  mailer.send(to, b);")
    far = java('  String b = "promotion";', *["  x();"] * 10, "  mailer.send(to, b);")
    found = scan_files({"near.java": near, "far.java": far}, [MKT])
    assert [(f["file_path"], f["line_number"]) for f in found] == [("near.java", 11)]


# --- CIA-ENC-001 -----------------------------------------------------------------

def test_financial_hits_bounds_and_protection(scan_files):
    src = java(
        "    private String cardNumber;",
        "    private String accountNonce;",
        "    private String cardNotice;",
        "    private String 카드번호;",
        "    @Mask",
        "    private String account_no;",
        "    String shown = mask(cvv);",
        "    private Integer creditScore;")
    found = scan_files({"F.java": src}, [FIN])
    assert _ids(found) == [(FIN, 1), (FIN, 4), (FIN, 8)]
    assert "(cardNumber)" in found[0]["message"] and "(카드번호)" in found[1]["message"]


# --- ECA-RET-001 -----------------------------------------------------------------

def test_retention_once_per_file_and_suppression(scan_files):
    two = java("class O {", "    private Long orderId;", "    private String paymentId;", "}")
    kept = java("    private Long orderId;", "    private Instant retentionUntil;")
    comment_only = java("    // retention policy TODO", "    private Long orderId;")
    settled = java("    private Long orderId;", "    private Instant closingDay;")
    notes = java("    private String orderNorm;")
    found = scan_files({"two.java": two, "kept.java": kept, "comment.java": comment_only,
                        "settled.java": settled, "notes.java": notes}, [RET])
    assert [(f["file_path"], f["line_number"]) for f in found] == [
        ("comment.java", 2), ("settled.java", 1), ("two.java", 2)]
    assert "(orderId)" in found[0]["message"]


# --- all detectors together -----------------------------------------------------------

def test_scan_all_equals_union_of_single_detectors(scan_files):
    from compliance_scan.sources.corpus import TEMPLATES
    files = {f"t{k}.java": "\n".join(TEMPLATES[(k * 7 + i * 3) % len(TEMPLATES)] for i in range(25))
             for k in range(12)}
    together = scan_files(files)
    separately = sorted((f for d in rules.DETECTORS for f in scan_files(files, [d.id])),
                        key=lambda r: (r["file_path"], r["detector_ord"], r["line_number"]))
    assert together == separately
    assert len(together) > 0


def test_messages_use_hedged_language(spark):
    from conftest import SF0001

    from compliance_scan.plans.scan import scan
    from compliance_scan.sources.corpus import corpus_sources
    msgs = scan(corpus_sources(spark, SF0001)).select("detector_id", "message").distinct().collect()
    assert {r.detector_id for r in msgs} == {d.id for d in rules.DETECTORS}
    for text in [r.message for r in msgs] + [rules.DISCLAIMER]:
        low = text.lower()
        assert not any(w in low for w in rules.FORBIDDEN_WORDS), text
        assert "may" in low or "possible" in low or "not constitute" in low
