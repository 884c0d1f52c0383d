"""Rule data: detector metadata, messages and regular expressions.

Everything in the FIXED VALUES blocks must stay equal to the scanner whose
behaviour this package reproduces: detector ids, names, descriptions, risk
levels, related provision ids, message wording, the disclaimer and the
patterns.  Patterns are RE2, the dialect in which they were written: it folds
case by Unicode rules, and its ``\\b``, ``\\s`` and ``\\w`` are ASCII.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# FIXED VALUES -- report text
# ---------------------------------------------------------------------------
DISCLAIMER = (
    "This report identifies possible compliance risks for review. "
    "It does not constitute legal advice. "
    "Consult qualified legal counsel for definitive guidance."
)

DEFAULT_PATTERN = "*.java"

# ---------------------------------------------------------------------------
# FIXED VALUES -- regular expressions (RE2)
# ---------------------------------------------------------------------------
PATTERNS: dict[str, str] = {
    "log_call":
        r"(?i)log\.(info|debug|warn|error)\(.*?(email|phone|ssn|password|주민|이름|전화|이메일)",
    "identifier":
        r"(?i)(residentNumber|ssn|주민번호|resident.*[Nn]o)",
    "encrypted":
        r"(?i)encrypt",
    "annot":
        r"^\s*@\w+",
    "comment":
        r"^\s*//",
    "decl":
        r"^\s*(private|protected|public|final|static).*\s+\w+\s*;",
    "mapping":
        r"@(Post|Put)Mapping",
    "personal":
        r"(?i)(email|phone|name|ssn|이메일|전화|이름|주민)",
    "consent":
        r"(?i)(consent|동의|agree)",
    "send":
        r"(?i)\.\s*(send|push|dispatch|notify)\w*\s*\(",
    "intent":
        r"(?i)(marketing|advertis|promotion|newsletter|광고|마케팅|홍보|프로모션)",
    "opt_in":
        r"(?i)(consent|optin|opt_in|opt-in|동의)",
    "financial":
        r"(?i)(\b(card_?number|card_?no|account_?number|account_?no|cvv|cvc|credit_?score|credit_?rating)\b|카드번호|계좌번호|신용등급|신용점수)",
    "protected":
        r"(?i)(encrypt|mask|마스킹|토큰|tokeni[sz]e)",
    "record":
        r"(?i)(\b(order_?id|order_?no|payment_?id|transaction_?id|txn_?id|purchase_?id)\b|주문번호|결제정보|거래내역|주문내역)",
    "retained":
        r"(?i)(retention|retain|preserv|expir|deleted_?at|archive|\bttl\b|보존|보관기간|파기)",
}

# Snippets are trimmed of Unicode white space at both ends (not only ASCII).
WHITE_SPACE = ("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")
TRIM_RE2 = r"^[\s\x{0B}\x{85}\p{Z}]+|[\s\x{0B}\x{85}\p{Z}]+$"


def re2(name: str) -> str:
    return PATTERNS[name]


# ---------------------------------------------------------------------------
# Context sizes of the line frames
# ---------------------------------------------------------------------------
FORWARD_EVIDENCE_LINES = 10   # look-ahead for encryption / masking evidence
METHOD_BLOCK_LINES = 31       # brace block cap, anchor line included
MARKETING_RADIUS = 10         # +-lines of context around a send call


@dataclass(frozen=True)
class DetectorSpec:
    ord: int
    id: str
    name: str
    description: str
    risk_level: str
    related_laws: tuple[str, ...]
    # message template; "%s" is the matched field where the detector has one
    message: str
    trigger: str          # pattern whose match marks a candidate line
    field_group: int | None  # capture group reported as the field (None: no field)


# ---------------------------------------------------------------------------
# FIXED VALUES -- detector catalogue, in registration order
# ---------------------------------------------------------------------------
DETECTORS: tuple[DetectorSpec, ...] = (
    DetectorSpec(
        1, "PIPA-LOG-001", "Personal Data Logging Risk",
        "Detects log statements that may contain personal data fields",
        "MEDIUM", ("PIPA-29",),
        "Possible personal data (%s) in log output — may require review under PIPA Article 29",
        "log_call", 2),
    DetectorSpec(
        2, "PIPA-ENC-001", "Unencrypted Personal Data Risk",
        "Detects personal identifier fields stored without apparent encryption",
        "HIGH", ("PIPA-24-2", "PIPA-29"),
        "Possible unencrypted personal identifier (%s) — may require review under PIPA Article 24-2",
        "identifier", 0),
    DetectorSpec(
        3, "PIPA-CST-001", "Missing Consent Check Risk",
        "Detects endpoints accepting personal data without apparent consent verification",
        "HIGH", ("PIPA-15",),
        "Endpoint accepts possible personal data without apparent consent mechanism — may require review under PIPA Article 15",
        "mapping", None),
    DetectorSpec(
        4, "NIA-MKT-001", "Marketing Message Consent Risk",
        "Detects advertising or marketing messages sent without an apparent opt-in consent check",
        "MEDIUM", ("NIA-50",),
        "Possible advertising message sent without an apparent opt-in consent check — may require review under Network Act Article 50",
        "send", None),
    DetectorSpec(
        5, "CIA-ENC-001", "Unprotected Credit Information Risk",
        "Detects credit or financial identifier fields stored without apparent encryption or masking",
        "HIGH", ("CIA-19",),
        "Possible unprotected credit information (%s) — may require review under Credit Information Act Article 19",
        "financial", 0),
    DetectorSpec(
        6, "ECA-RET-001", "Transaction Record Retention Risk",
        "Detects transaction record fields stored without apparent retention or preservation handling",
        "MEDIUM", ("ECA-6",),
        "Possible transaction records (%s) stored without apparent retention or preservation handling — may require review under E-Commerce Act Article 6",
        "record", 0),
)

BY_ID = {d.id: d for d in DETECTORS}

LOGGING, ENCRYPTION, CONSENT, MARKETING, FINANCIAL, RETENTION = (d.id for d in DETECTORS)

# Words that must never appear in produced text (hedged wording only).
FORBIDDEN_WORDS = ("violation", "illegal", "non-compliant", "you must", "fails to comply")


def resolve(detectors) -> tuple[DetectorSpec, ...]:
    """Normalise a detector selection (ids or specs, None = all) in registration order."""
    if detectors is None:
        return DETECTORS
    ids = {d if isinstance(d, str) else d.id for d in detectors}
    unknown = ids - set(BY_ID)
    if unknown:
        raise ValueError(f"unknown detector id(s): {sorted(unknown)}")
    return tuple(d for d in DETECTORS if d.id in ids)
