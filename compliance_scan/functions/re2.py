"""Line flags evaluated with RE2 in Arrow batches.

``file_flags`` does it for whole texts (one list of flags per file, in the pass
that also drops files without a candidate), ``line_flags`` for tables of lines,
and ``matched_field`` takes the reported field out of candidate lines.

Why not ``rlike``: ``java.util.regex`` backtracks through every alternative
at every position; RE2 is a DFA engine and the dialect the rules are written
in.  So the flag projection -- and only it -- runs as a
scalar Arrow UDF: Spark hands each task's lines to Python as an Arrow
array, ``pyarrow.compute`` evaluates the RE2 patterns vectorised (C++), and
an INT bitmask comes back.  No per-row Python.  The flag UDFs are declared
non-deterministic, which they are not, so that a filter on their result stays
above them instead of evaluating them a second time.  Contexts, windows, joins and
aggregations stay in Spark.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from .. import rules
from .text import FLAG_BITS, mask

# flag -> (pattern name, only on non-comment lines)
FLAG_PATTERNS = {
    "c": ("comment", False),
    "annot": ("annot", False),
    "decl": ("decl", False),
    "log": ("log_call", False),
    "ident": ("identifier", True),
    "enc_ev": ("encrypted", False),
    "mapping": ("mapping", False),
    "personal": ("personal", False),
    "consent": ("consent", False),
    "send": ("send", True),
    "intent": ("intent", True),
    "optin": ("opt_in", True),
    "fin": ("financial", True),
    "prot_ev": ("protected", False),
    "record": ("record", True),
    "retained": ("retained", True),
}


def _flag_kernel(names: tuple[str, ...], with_braces: bool):
    specs = [(1 << FLAG_BITS[n], rules.re2(FLAG_PATTERNS[n][0]), FLAG_PATTERNS[n][1]) for n in names]
    need_comment = any(code_only for _, _, code_only in specs)
    comment_re = rules.re2("comment")

    def kernel(lines: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        zero = pa.scalar(0, pa.int32())
        acc = pc.if_else(pc.is_valid(lines), zero, zero)  # int32 zeros of the batch length
        code = None
        if need_comment:
            code = pc.invert(pc.fill_null(pc.match_substring_regex(lines, comment_re), False))
        for bit, pattern, code_only in specs:
            hit = pc.fill_null(pc.match_substring_regex(lines, pattern), False)
            if code_only:
                hit = pc.and_(hit, code)
            acc = pc.bit_wise_or(acc, pc.if_else(hit, pa.scalar(bit, pa.int32()), zero))
        if not with_braces:
            return acc
        braces = pc.replace_substring_regex(lines, "[^{}]", "")
        braces = pc.if_else(pc.equal(braces, ""), pa.scalar(None, pa.string()), braces)
        return pa.StructArray.from_arrays([acc, braces], names=["flags", "braces"])

    return kernel


def line_flags(line: Column, names, with_braces: bool = False) -> Column:
    """INT bitmask of ``names`` (or ``struct<flags, braces>`` with the line's brace characters)."""
    names = tuple(names)
    rtype = "struct<flags:int,braces:string>" if with_braces else "int"
    return arrow_udf(_flag_kernel(names, with_braces), rtype).asNondeterministic()(line)


def _any_match(texts: pa.Array, patterns) -> pa.Array:
    import pyarrow.compute as pc

    out = pa.nulls(len(texts), pa.bool_()).fill_null(False)
    for p in patterns:
        out = pc.or_(out, pc.fill_null(pc.match_substring_regex(texts, p), False))
    return out


def matches_any(text: Column, pattern_names) -> Column:
    """True where ``text`` contains a match of any named pattern (RE2, unanchored)."""
    pats = tuple(rules.re2(n) for n in sorted(set(pattern_names)))
    return arrow_udf(lambda texts: _any_match(texts, pats), "boolean")(text)


def _annotated(flags: np.ndarray, starts: np.ndarray, evidence: int) -> np.ndarray:
    """Whether the annotation lines right above a line hold ``evidence`` (files begin at ``starts``)."""
    at = np.arange(len(flags))
    annot = flags & mask("annot") != 0
    first = np.zeros(len(flags), dtype=np.int64)
    first[starts] = starts
    first = np.maximum.accumulate(first)  # a file's first line
    last_break = np.maximum.accumulate(np.where(annot, -1, at))
    last_evidence = np.maximum.accumulate(np.where(annot & (flags & evidence != 0), at, -1))
    above = np.maximum(at - 1, 0)
    return (at > first) & (last_evidence[above] > np.maximum(last_break[above], first - 1))


def _file_kernel(names: tuple[str, ...], triggers: tuple[str, ...]):
    per_line = _flag_kernel(names, False)
    runs = [(mask(e), mask(run), mask(plain)) for e, run, plain in (
        ("enc_ev", "run_enc", "plain_enc"), ("prot_ev", "run_prot", "plain_prot")) if e in names]

    def kernel(texts: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        kept = _any_match(texts, triggers) if triggers else pc.is_valid(texts)
        lists = pc.split_pattern(texts.filter(kept), "\n")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flags = per_line(lists.flatten()).to_numpy(zero_copy_only=False).copy()
        starts = np.cumsum(sizes) - sizes
        if runs:
            code = flags & mask("c") == 0
            ends = code & (flags & mask("decl", "annot") != 0)
            flags[ends] |= mask("stop")
        for evidence, run, plain in runs:
            flags[_annotated(flags, starts, evidence)] |= run
            flags[code & ~ends & (flags & evidence != 0)] |= plain
        none = ~kept.to_numpy(zero_copy_only=False)
        offsets = np.zeros(len(texts) + 1, dtype=np.int32)
        offsets[1:][~none] = sizes
        return pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(flags), mask=pa.array(none))

    return kernel


def file_flags(content: Column, names, triggers=()) -> Column:
    """``array<int>``: the flags of every line of a text, by lines split on ``\\n``.

    Where evidence of an annotation run is asked for, a line also has the flag
    of the run right above it.  With ``triggers`` (pattern names) the result is
    NULL for texts that match none of them anywhere; no trigger uses ``^`` or
    ``$``, so a line that matches is also a match in its text.
    """
    pats = tuple(rules.re2(n) for n in sorted(set(triggers)))
    return arrow_udf(_file_kernel(tuple(names), pats), "array<int>").asNondeterministic()(content)


_GROUP = re.compile(r"(?<!\\)\((?!\?)")


def _named(pattern: str) -> str:
    """``pattern`` as group ``g0``, with its groups named ``g1``, ``g2`` ... in order."""
    numbers = iter(range(1, 100))
    return "(?P<g0>" + _GROUP.sub(lambda _: f"(?P<g{next(numbers)}>", pattern) + ")"


def _field_kernel(fields: tuple[tuple[int, str, int], ...]):
    def kernel(lines: pa.Array, which: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        out = pa.nulls(len(lines), pa.string())
        for number, pattern, group in fields:
            mine = pc.fill_null(pc.equal(which, number), False)
            found = pc.struct_field(pc.extract_regex(lines.filter(mine), _named(pattern)), f"g{group}")
            out = pc.replace_with_mask(out, mine, found)
        return out

    return kernel


def matched_field(line: Column, which: Column, fields) -> Column:
    """Leftmost-first match, or a group of it, of the pattern that ``which`` numbers; NULL without a match.

    ``fields`` lists ``(number, pattern name, group)``; group 0 is the whole match.
    """
    return arrow_udf(_field_kernel(tuple((n, rules.re2(p), g) for n, p, g in fields)), "string")(line, which)
