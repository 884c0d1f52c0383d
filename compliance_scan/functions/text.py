"""Scalar column functions: line split, snippet trim, unpacked flags.

All of these are built-in Spark expressions (JVM side, inside whole-stage
codegen); no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules


def split_lines(content: Column) -> Column:
    """Split on ``\\n`` only (``\\r`` stays in the line); keeps a trailing empty line."""
    return F.split(content, "\n", -1)


def unicode_trim(line: Column) -> Column:
    """Trim Unicode white space at both ends (``F.trim`` only strips ASCII blanks)."""
    return F.btrim(line, F.lit(rules.WHITE_SPACE))


# ---------------------------------------------------------------------------
# Line flags, packed into one INT so the line shuffle carries 4 bytes of
# flags instead of one column per predicate.
# ---------------------------------------------------------------------------
FLAG_BITS = {
    "c": 0,          # comment line  ^\s*//
    "annot": 1,      # annotation line  ^\s*@\w+
    "decl": 2,       # field declaration
    "log": 3,        # log call with a personal-data field (comments count)
    "ident": 4,      # personal identifier, non-comment
    "enc_ev": 5,     # "encrypt" evidence
    "mapping": 6,    # @PostMapping / @PutMapping (comments count)
    "personal": 7,   # personal-data token (comments count)
    "consent": 8,    # consent token (comments count)
    "send": 9,       # message dispatch call, non-comment
    "intent": 10,    # advertising intent, non-comment
    "optin": 11,     # opt-in evidence, non-comment
    "fin": 12,       # credit / financial identifier, non-comment
    "prot_ev": 13,   # encryption / masking / tokenising evidence
    "record": 14,    # transaction record field, non-comment
    "retained": 15,  # retention / destruction evidence, non-comment
}

# set on whole texts only: the annotation lines right above hold such evidence; a line that ends
# the look-ahead (a declaration or an annotation); plain code with such evidence
RUN_BITS = {"run_enc": 16, "run_prot": 17, "stop": 18, "plain_enc": 19, "plain_prot": 20}

# which flags each detector reads
DETECTOR_FLAGS = {
    rules.LOGGING: ("log",),
    rules.ENCRYPTION: ("c", "annot", "decl", "ident", "enc_ev"),
    rules.CONSENT: ("mapping", "personal", "consent"),
    rules.MARKETING: ("send", "intent", "optin"),
    rules.FINANCIAL: ("c", "annot", "decl", "fin", "prot_ev"),
    rules.RETENTION: ("record", "retained"),
}

# flags whose line text is needed after the shuffle (snippet / field)
TRIGGER_FLAGS = ("log", "ident", "mapping", "send", "fin", "record")


def needed_flags(detector_ids) -> tuple[str, ...]:
    wanted = set()
    for d in detector_ids:
        wanted.update(DETECTOR_FLAGS[d])
    return tuple(sorted(wanted, key=FLAG_BITS.__getitem__))


def mask(*names: str) -> int:
    """The bits of ``names``."""
    return sum(1 << (FLAG_BITS[n] if n in FLAG_BITS else RUN_BITS[n]) for n in names)


def flag(flags: Column, *names: str) -> Column:
    """Whether one of the named flags is set in the bitmask."""
    return flags.bitwiseAND(F.lit(mask(*names))) != 0
