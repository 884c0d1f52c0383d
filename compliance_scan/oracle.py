"""DuckDB SQL for every named query (the ``oracle_sql()`` contract).

Written independently of the Spark plans: plain SQL windows over the whole
file (no chunks), the RE2 pattern text, and a character-level running sum
for brace blocks.  The driver registers the parquet tables as views.
"""

from __future__ import annotations

from . import rules
from .sources.corpus import TEMPLATES
from .sources.laws import LAWS


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _re(name: str) -> str:
    return _s(rules.re2(name))


_TRIM = f"regexp_replace(line, {_s(rules.TRIM_RE2)}, '', 'g')"


def _lines_cte(table: str = "customer", key: str = "c_custkey") -> str:
    templates = "[" + ", ".join(_s(t) for t in TEMPLATES) + "]"
    return f"""keys AS (SELECT CAST({key} AS BIGINT) AS k FROM {table}),
gen AS (SELECT k, UNNEST(range(1, k % 29 + 13)) AS n FROM keys),
lines AS (
  SELECT 'src/m' || CAST(k % 7 AS VARCHAR) || '/F' || CAST(k AS VARCHAR) || '.java' AS file_path,
         CAST(n AS INTEGER) AS line_no,
         {templates}[((k * 7919 + n * n * 31 + n * k + n * 17) % {len(TEMPLATES)}) + 1] AS line
  FROM gen)"""


_FLAGS = f"""flags AS (
  SELECT file_path, line_no, line,
         regexp_matches(line, {_re('comment')}) AS c,
         regexp_matches(line, {_re('annot')}) AS annot,
         regexp_matches(line, {_re('decl')}) AS decl,
         regexp_matches(line, {_re('log_call')}) AS log,
         NOT regexp_matches(line, {_re('comment')}) AND regexp_matches(line, {_re('identifier')}) AS ident,
         regexp_matches(line, {_re('encrypted')}) AS enc_ev,
         regexp_matches(line, {_re('mapping')}) AS mapping,
         regexp_matches(line, {_re('personal')}) AS personal,
         regexp_matches(line, {_re('consent')}) AS consent,
         NOT regexp_matches(line, {_re('comment')}) AND regexp_matches(line, {_re('send')}) AS send,
         NOT regexp_matches(line, {_re('comment')}) AND regexp_matches(line, {_re('intent')}) AS intent,
         NOT regexp_matches(line, {_re('comment')}) AND regexp_matches(line, {_re('opt_in')}) AS optin,
         NOT regexp_matches(line, {_re('comment')}) AND regexp_matches(line, {_re('financial')}) AS fin,
         regexp_matches(line, {_re('protected')}) AS prot_ev,
         NOT regexp_matches(line, {_re('comment')}) AND regexp_matches(line, {_re('record')}) AS record,
         NOT regexp_matches(line, {_re('comment')}) AND regexp_matches(line, {_re('retained')}) AS retained
  FROM lines)"""

_FRAMES = """fr AS (
  SELECT *,
    max(CASE WHEN NOT annot THEN line_no END) OVER wb AS prev_brk,
    max(CASE WHEN annot AND enc_ev THEN line_no END) OVER wb AS prev_enc,
    max(CASE WHEN annot AND prot_ev THEN line_no END) OVER wb AS prev_prot,
    min(CASE WHEN NOT c AND (decl OR annot) THEN line_no END) OVER wf AS fwd_stop,
    min(CASE WHEN NOT c AND NOT decl AND NOT annot AND enc_ev THEN line_no END) OVER wf AS fwd_enc,
    min(CASE WHEN NOT c AND NOT decl AND NOT annot AND prot_ev THEN line_no END) OVER wf AS fwd_prot,
    bool_or(intent) OVER wc AS ctx_intent,
    bool_or(optin) OVER wc AS ctx_optin
  FROM flags
  WINDOW wb AS (PARTITION BY file_path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         wf AS (PARTITION BY file_path ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING),
         wc AS (PARTITION BY file_path ORDER BY line_no ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
ev AS (
  SELECT *,
    coalesce(prev_enc > coalesce(prev_brk, 0), false) AS annot_encrypt,
    coalesce(prev_prot > coalesce(prev_brk, 0), false) AS annot_protect,
    coalesce(fwd_enc < coalesce(fwd_stop, 2147483647), false) AS fwd_encrypt,
    coalesce(fwd_prot < coalesce(fwd_stop, 2147483647), false) AS fwd_protect
  FROM fr)"""

_BLOCKS = """anchors AS (SELECT file_path, line_no AS anchor_line FROM flags WHERE mapping),
blk AS (
  SELECT a.file_path, a.anchor_line, l.line_no, l.line, l.personal, l.consent
  FROM anchors a JOIN flags l
    ON l.file_path = a.file_path AND l.line_no BETWEEN a.anchor_line AND a.anchor_line + 30),
braces AS (
  SELECT file_path, anchor_line, line_no, regexp_replace(line, '[^{}]', '', 'g') AS b FROM blk),
chars AS (
  SELECT file_path, anchor_line, line_no, p, substr(b, CAST(p AS INTEGER), 1) AS ch
  FROM (SELECT *, UNNEST(range(1, length(b) + 1)) AS p FROM braces WHERE length(b) > 0)),
depth AS (
  SELECT *,
    sum(CASE WHEN ch = '{' THEN 1 ELSE -1 END) OVER w AS d,
    max(CASE WHEN ch = '{' THEN 1 ELSE 0 END) OVER w AS opened
  FROM chars
  WINDOW w AS (PARTITION BY file_path, anchor_line ORDER BY line_no, p ROWS UNBOUNDED PRECEDING)),
ends AS (
  SELECT file_path, anchor_line, min(line_no) AS close_line
  FROM depth WHERE ch = '}' AND d = 0 AND opened = 1 GROUP BY file_path, anchor_line),
blocks AS (
  SELECT b.file_path, b.anchor_line,
    CAST(coalesce(min(e.close_line), max(b.line_no)) AS INTEGER) AS end_line,
    coalesce(bool_or(b.personal) FILTER (WHERE b.line_no <= coalesce(e.close_line, 2147483647)), false) AS has_personal,
    coalesce(bool_or(b.consent) FILTER (WHERE b.line_no <= coalesce(e.close_line, 2147483647)), false) AS has_consent
  FROM blk b LEFT JOIN ends e ON e.file_path = b.file_path AND e.anchor_line = b.anchor_line
  GROUP BY b.file_path, b.anchor_line)"""

_PER_FILE = """per_file AS (
  SELECT file_path, bool_or(record) AS has_record, bool_or(retained) AS has_retention,
         min(CASE WHEN record THEN line_no END) AS first_line
  FROM flags GROUP BY file_path)"""


def _finding_select(spec: rules.DetectorSpec, source: str, where: str) -> str:
    if spec.field_group is None:
        message = _s(spec.message)
    else:
        field = f"regexp_extract(line, {_re(spec.trigger)}, {spec.field_group})"
        head, tail = spec.message.split("%s")
        message = f"{_s(head)} || {field} || {_s(tail)}"
    laws = "[" + ", ".join(_s(x) for x in spec.related_laws) + "]"
    return (f"SELECT {spec.ord} AS detector_ord, {_s(spec.id)} AS detector_id, "
            f"{_s(spec.risk_level)} AS risk_level, file_path, CAST(line_no AS INTEGER) AS line_number, "
            f"{_TRIM} AS snippet, {message} AS message, {laws} AS related_laws "
            f"FROM {source} WHERE {where}")


_DETECTOR_SQL = {
    rules.LOGGING: ("flags", "log"),
    rules.ENCRYPTION: ("ev", "ident AND NOT (enc_ev OR annot_encrypt OR fwd_encrypt)"),
    rules.CONSENT: ("(SELECT f.*, k.has_personal, k.has_consent FROM flags f JOIN blocks k "
                    "ON k.file_path = f.file_path AND k.anchor_line = f.line_no)",
                    "has_personal AND NOT has_consent"),
    rules.MARKETING: ("ev", "send AND ctx_intent AND NOT ctx_optin"),
    rules.FINANCIAL: ("ev", "fin AND NOT (prot_ev OR annot_protect OR fwd_protect)"),
    rules.RETENTION: ("(SELECT f.* FROM per_file p JOIN flags f "
                      "ON f.file_path = p.file_path AND f.line_no = p.first_line "
                      "WHERE p.has_record AND NOT p.has_retention)", "true"),
}


def _findings_cte(detector_ids=None) -> str:
    specs = rules.resolve(detector_ids)
    parts = [_finding_select(s, *_DETECTOR_SQL[s.id]) for s in specs]
    return "findings AS (\n  " + "\n  UNION ALL\n  ".join(parts) + ")"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _all_ctes(detector_ids=None) -> str:
    return _with(_lines_cte(), _FLAGS, _FRAMES, _BLOCKS, _PER_FILE, _findings_cte(detector_ids))


_FLAT = ("SELECT detector_id, risk_level, file_path, line_number, snippet, message, "
         "array_to_string(related_laws, ',') AS related_laws FROM findings")

_LAWS_VALUES = ",\n  ".join(
    f"({i + 1}, {_s(lid)}, {_s(ko)}, {_s(en)}, {_s(url)}, {_s(risk)}, {_s(summary)})"
    for i, (lid, ko, en, url, risk, summary) in enumerate(LAWS))
_LAWS_CTE = (f"laws AS (SELECT * FROM (VALUES\n  {_LAWS_VALUES}) "
             "AS t(ord, id, name_ko, name_en, url, risk_level, summary))")

_CATALOG_VALUES = ",\n  ".join(
    f"({d.ord}, {_s(d.id)}, {_s(d.name)}, {_s(d.description)}, {_s(','.join(d.related_laws))}, {_s(d.risk_level)})"
    for d in rules.DETECTORS)
_CATALOG_CTE = (f"catalog AS (SELECT * FROM (VALUES\n  {_CATALOG_VALUES}) "
                "AS t(detector_ord, id, name, description, related_laws, risk_level))")

_CITED = "cited AS (SELECT UNNEST(related_laws) AS id FROM findings)"

_REQUESTED = ("requested AS (SELECT id FROM cited UNION "
              "SELECT 'REQ-' || CAST(k % 7 AS VARCHAR) FROM keys)")

_BLOCK_FMT = ("--- Finding %d ---\n  Detector:  %s\n  Risk:      %s\n  Location:  %s:%d\n"
              "  Snippet:   %s\n  Message:   %s\n  Laws:      %s\n\n")

_MATCHED = "\nUNION ALL\n".join(
    f"SELECT file_path, line_no, {_s(p)} AS pattern, regexp_extract(line, {_re(p)}, {g}) AS field "
    f"FROM lines WHERE regexp_matches(line, {_re(p)})"
    for p, g in (("log_call", 2), ("identifier", 0), ("financial", 0), ("record", 0)))

_FOLDED = """, lines AS (SELECT file_path, line_no, CASE line_no % 3
  WHEN 0 THEN translate(line, 'skSK', 'ſKſK') WHEN 1 THEN translate(line, 'iI', 'ıİ')
  ELSE translate(line, 'ski', 'SKİ') END AS line FROM plain)
"""

_AT = "2026-03-23T14:30:00Z"


def _escaped(json: str) -> str:
    for ch in "<>&":
        json = f"replace({json}, '{ch}', '\\u{ord(ch):04x}')"
    return json


def _documents(target: str, text: bool) -> str:
    """Fragments of the reports of all targets; ``target`` is SQL over ``file_path``."""
    if text:
        opening = (f"printf('compliance scan report\nScanned: {_AT}\nTarget:  %s\nFiles:   %d\nFindings: %d\n\n', "
                   "target_path, files, n)")
        body = (f"printf({_s(_BLOCK_FMT)}, seq, detector_id, risk_level, file_path, line_number, snippet, message, "
                "array_to_string(related_laws, ', '))")
        closing = _s(rules.DISCLAIMER + "\n")
    else:
        opening = (f"'{{\"scanned_at\":\"{_AT}\",\"target_path\":' || {_escaped('to_json(target_path)::VARCHAR')} || "
                   "',\"files_scanned\":' || files || ',\"total_findings\":' || n || ',\"findings\":['")
        one = _escaped("to_json(struct_pack(detector_id := detector_id, risk_level := risk_level, file_path := file_path, "
                       "line_number := line_number, snippet := snippet, message := message, "
                       "related_laws := related_laws))::VARCHAR")
        body = f"CASE WHEN seq > 1 THEN ',' ELSE '' END || {one}"
        closing = _s('],"disclaimer":"' + rules.DISCLAIMER + '"}')
    return f""", targets AS (SELECT {target} AS target_path, count(*) AS files FROM (SELECT DISTINCT file_path FROM lines) GROUP BY 1),
placed AS (SELECT *, {target} AS target_path, row_number() OVER (
  PARTITION BY {target} ORDER BY string_split(file_path, '/'), detector_ord, line_number) AS seq FROM findings),
heads AS (SELECT t.target_path, t.files, count(p.seq) AS n FROM targets t LEFT JOIN placed p USING (target_path) GROUP BY ALL)
SELECT target_path, 0::BIGINT AS seq, {opening} AS text FROM heads
UNION ALL SELECT target_path, seq, {body} FROM placed
UNION ALL SELECT target_path, n + 1, {closing} FROM heads"""


_BY_KEY = ("SELECT CAST(regexp_extract(file_path, '/F([0-9]+)', 1) AS BIGINT) AS k, detector_id, line_number, snippet, message "
           "FROM findings")


def oracle_sql() -> dict[str, str]:
    base = _with(_lines_cte())
    fl = _with(_lines_cte(), _FLAGS)
    fr = _with(_lines_cte(), _FLAGS, _FRAMES)
    bl = _with(_lines_cte(), _FLAGS, _BLOCKS)
    allc = _all_ctes()
    out = {
        "source_lines": base + "SELECT file_path, line_no, line FROM lines",
        "tree_files": base + (
            "SELECT CAST(regexp_extract(file_path, '/F([0-9]+)', 1) AS BIGINT) AS k, sum(strlen(line) + 1)::BIGINT AS size, "
            "true AS readable, sum(strlen(line) + 1)::BIGINT AS bytes FROM lines GROUP BY file_path"),
        "tree_findings": allc + _BY_KEY,
        "split_lines": base + (
            "SELECT CAST(regexp_extract(file_path, '/F([0-9]+)', 1) AS BIGINT) AS k, line_no, line FROM lines "
            "UNION ALL SELECT k, (k % 29 + 13)::INTEGER, '' FROM keys"),
        "path_findings": allc + _BY_KEY,
        "line_snippets": base + f"SELECT file_path, line_no, {_TRIM} AS snippet FROM lines",
        "line_flags": fl + ("SELECT file_path, line_no, c, annot, decl, log, ident, enc_ev, mapping, "
                            "personal, consent, send, intent, optin, fin, prot_ev, record, retained FROM flags"),
        "matched_field": base + _MATCHED,
        "matched_field_folded": base.replace("lines AS (", "plain AS (")[:-1] + _FOLDED + _MATCHED,
        "annotation_evidence": fr + "SELECT file_path, line_no, annot_encrypt, annot_protect FROM ev",
        "forward_evidence": fr + "SELECT file_path, line_no, fwd_encrypt, fwd_protect FROM ev",
        "marketing_context": fr + "SELECT file_path, line_no, ctx_intent, ctx_optin FROM ev",
        "method_blocks": bl + "SELECT file_path, anchor_line, end_line, has_personal, has_consent FROM blocks",
        "scan_all": allc + _FLAT,
        "scan_ordered": allc + (
            "SELECT row_number() OVER (ORDER BY string_split(file_path, '/'), detector_ord, line_number) "
            "AS ordinal, file_path, detector_id, line_number FROM findings"),
        "report_summary": allc + (
            "SELECT 'src' AS target_path, CAST((SELECT count(*) FROM keys) AS BIGINT) AS files_scanned, "
            f"CAST((SELECT count(*) FROM findings) AS BIGINT) AS total_findings, {_s(rules.DISCLAIMER)} AS disclaimer"),
        "report_row": allc + (
            "SELECT t.file_path AS target_path, 1 AS files_scanned, "
            "CAST(count(f.file_path) AS BIGINT) AS total_findings, "
            f"{_s(rules.DISCLAIMER)} AS disclaimer "
            "FROM (SELECT DISTINCT file_path FROM lines) t LEFT JOIN findings f ON f.file_path = t.file_path "
            "GROUP BY t.file_path"),
        "report_by_folder": allc + (
            "SELECT t.folder AS target_path, CAST(count(DISTINCT t.file_path) AS BIGINT) AS files_scanned, "
            "CAST(count(f.file_path) AS BIGINT) AS total_findings, "
            f"{_s(rules.DISCLAIMER)} AS disclaimer "
            "FROM (SELECT DISTINCT file_path, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS folder FROM lines) t "
            "LEFT JOIN findings f ON f.file_path = t.file_path GROUP BY t.folder"),
        "report_json": allc + (
            "SELECT file_path, line_number, detector_id, CAST(to_json(struct_pack("
            "detector_id := detector_id, risk_level := risk_level, file_path := file_path, "
            "line_number := line_number, snippet := snippet, message := message, "
            "related_laws := related_laws)) AS VARCHAR) AS json FROM findings"),
        "report_text": allc + (
            "SELECT file_path AS target_path, ordinal, printf(" + _s(_BLOCK_FMT) + ", ordinal, detector_id, "
            "risk_level, file_path, line_number, snippet, message, array_to_string(related_laws, ', ')) AS text "
            "FROM (SELECT *, CAST(row_number() OVER (PARTITION BY file_path ORDER BY detector_ord, line_number) "
            "AS BIGINT) AS ordinal FROM findings)"),
        "report_stamp": _all_ctes([rules.MARKETING]) + (
            "SELECT t.folder AS target_path, CAST(count(DISTINCT t.file_path) AS BIGINT) AS files_scanned, "
            "CAST(count(f.file_path) AS BIGINT) AS total_findings, true AS well_formed, true AS just_past "
            "FROM (SELECT DISTINCT file_path, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS folder FROM lines) t "
            "LEFT JOIN findings f ON f.file_path = t.file_path GROUP BY t.folder"),
        "scan_with_own_detector": _all_ctes([rules.LOGGING])[:-1] + f""", together AS (
  SELECT detector_ord, detector_id, file_path, line_number, snippet, array_to_string(related_laws, ',') AS related_laws FROM findings
  UNION ALL SELECT 99, 'OWN-001', file_path, line_no, {_TRIM}, 'OWN-1,OWN-2' FROM lines WHERE contains(line, 'int total'))
SELECT row_number() OVER (ORDER BY string_split(file_path, '/'), detector_ord, line_number) AS ordinal,
       detector_id, file_path, line_number, snippet, related_laws FROM together""",
        "law_override": base + (
            "SELECT CAST(row_number() OVER (ORDER BY k DESC) AS INTEGER) AS ord, 'OWN-' || k AS id, '법 ' || k AS name_ko, "
            "CASE WHEN k % 3 > 0 THEN 'Act ' || k || ' \"<&>\"' END AS name_en, 'own' AS summary, "
            "CASE WHEN k % 2 > 0 THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level, NULL::VARCHAR AS full_text_ko FROM keys"),
        "report_directory_text": allc[:-1] + _documents("'src'", True),
        "report_file_text": allc[:-1] + _documents("file_path", True),
        "report_directory_json": allc[:-1] + _documents("'src'", False),
        "report_file_json": allc[:-1] + _documents("file_path", False),
        "detector_summary": allc[:-1] + ",\n" + _CATALOG_CTE + "\n" + (
            "SELECT c.detector_ord, c.id, c.name, c.description, c.related_laws, c.risk_level, "
            "CAST(count(f.detector_id) AS BIGINT) AS findings "
            "FROM catalog c LEFT JOIN findings f ON f.detector_id = c.id "
            "GROUP BY c.detector_ord, c.id, c.name, c.description, c.related_laws, c.risk_level"),
        "law_list": allc[:-1] + ",\n" + _LAWS_CTE + ",\n" + _CITED + "\n" + (
            "SELECT l.ord, l.id, l.name_ko, l.name_en, l.summary, l.url, l.risk_level, "
            "CAST((SELECT count(*) FROM cited c WHERE c.id = l.id) AS BIGINT) AS findings FROM laws l"),
        "law_lookup": allc[:-1] + ",\n" + _LAWS_CTE + ",\n" + _CITED + ",\n" + _REQUESTED + "\n" + (
            "SELECT r.id, l.name_ko, l.name_en, l.summary, l.url, l.risk_level "
            "FROM requested r LEFT JOIN laws l ON l.id = r.id"),
        "law_unknown_ids": allc[:-1] + ",\n" + _LAWS_CTE + ",\n" + _CITED + ",\n" + _REQUESTED + "\n" + (
            "SELECT id FROM requested WHERE id NOT IN (SELECT id FROM laws)"),
        "detector_law_coverage": allc[:-1] + ",\n" + _LAWS_CTE + ",\n" + _CATALOG_CTE + "\n" + (
            "SELECT n.id AS detector_id, n.law_id, n.law_id IN (SELECT id FROM laws) AS known, "
            "CAST((SELECT count(*) FROM findings f WHERE f.detector_id = n.id) AS BIGINT) AS findings "
            "FROM (SELECT id, UNNEST(string_split(related_laws, ',')) AS law_id FROM catalog) n"),
        "law_refresh": allc[:-1] + ",\n" + _LAWS_CTE + "\n" + (
            "SELECT l.id, l.name_ko, (SELECT arg_min('text ' || CAST(k AS VARCHAR), k * 7919 % 10007) FROM keys "
            "WHERE k % 37 + 1 = l.ord AND k % 5 IN (0, 4)) AS full_text FROM laws l"),
        "findings_with_laws": allc[:-1] + ",\n" + _LAWS_CTE + "\n" + (
            "SELECT f.file_path, f.line_number, f.detector_id, x.law_id, l.name_en AS law_name_en, "
            "l.risk_level AS law_risk_level "
            "FROM findings f, LATERAL (SELECT UNNEST(f.related_laws) AS law_id) x "
            "LEFT JOIN laws l ON l.id = x.law_id"),
    }
    for name, d in (("detect_logging", rules.LOGGING), ("detect_encryption", rules.ENCRYPTION),
                    ("detect_consent", rules.CONSENT), ("detect_marketing", rules.MARKETING),
                    ("detect_financial", rules.FINANCIAL), ("detect_retention", rules.RETENTION)):
        out[name] = _all_ctes([d]) + _FLAT
    return out
