"""Line contexts of whole files (W1-W7), without a shuffle.

A file is one row: its text and the array of its line flags
(``functions.re2.file_flags``).  Everything a detector looks at lies in that
row, so a candidate line takes along slices of bounded size -- the flags of the
next 10 lines, of the lines 10 around it, the text and flags of the next 31 --
and nothing else of the file.  Only candidate lines are exploded; a line
without a candidate flag never becomes a row.

``plans.scan`` uses this for ``(file_path, content)`` tables; tables of
lines, in which a file may be larger than a row, go through
``operators.frames``.  Both give the same columns to ``operators.detectors``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import flag, split_lines

R = rules.MARKETING_RADIUS
N = rules.FORWARD_EVIDENCE_LINES
BLOCK = rules.METHOD_BLOCK_LINES

# the flag that makes a line a candidate of each detector
TRIGGER_FLAG_OF = {rules.LOGGING: "log", rules.ENCRYPTION: "ident", rules.CONSENT: "mapping",
                   rules.MARKETING: "send", rules.FINANCIAL: "fin", rules.RETENTION: "record"}


def _has(flags: Column, name: str) -> Column:
    return F.exists(flags, lambda f: flag(f, name))


def _first(array: Column, test) -> Column:
    """1-based place of the first element that passes, 0 if none does."""
    return F.array_position(F.transform(array, test), F.lit(True))


def candidate_lines(files: DataFrame, specs, every_file: bool = False) -> DataFrame:
    """One row per candidate line of ``(file_path, content, flags)``, with its slices of the file.

    With ``every_file`` a file without candidates has one row too, of NULLs, and
    ``pos`` is 0 or NULL on exactly one row of each file.
    """
    ids = {s.id for s in specs}
    text = files.select("file_path", "flags", split_lines(F.col("content")).alias("lines"))
    flags, lines = F.col("flags"), F.col("lines")
    triggers = [TRIGGER_FLAG_OF[i] for i in sorted(ids)]

    def taken(f, i):  # i counts from 0, slices from 1
        n = (i + 1).cast("int")
        cols = [n.alias("line_no"), F.get(lines, i).alias("line"), f.alias("flags")]
        fields = [t for t in ("ident", "fin") if t in triggers]
        if fields:
            cols.append(F.when(flag(f, *fields), F.slice(flags, n + 1, N)).alias("ahead"))
        if "send" in triggers:
            start = F.greatest(n - R, F.lit(1))
            cols.append(F.when(flag(f, "send"), F.slice(flags, start, n + R + 1 - start)).alias("around"))
        if "mapping" in triggers:
            cols.append(F.when(flag(f, "mapping"), F.slice(flags, n, BLOCK)).alias("blk_flags"))
            cols.append(F.when(flag(f, "mapping"), F.array_join(F.slice(lines, n, BLOCK), "\n")).alias("blk_text"))
        return F.when(flag(f, *triggers), F.struct(*cols))

    found = F.filter(F.transform(flags, taken), lambda x: x.isNotNull())
    exploded = F.posexplode_outer(found).alias("pos", "t") if every_file else F.explode(found).alias("t")
    cols, told = [F.col("file_path"), exploded], ["file_path", *(["pos"] if every_file else []), "t.*"]
    if rules.RETENTION in ids:
        first = _first(flags, lambda f: flag(f, "record"))
        cols += [_has(flags, "retained").alias("file_has_retention"), first.cast("int").alias("file_first_record")]
        told += ["file_has_retention", "file_first_record", (F.col("file_first_record") > 0).alias("file_has_record")]
    return text.select(*cols).select(*told)


# --- W3: forward scan of the next lines, stopping at a new field ------------------------

def forward_has(ahead: Column, evidence: str) -> Column:
    """Plain code with ``evidence`` comes before the first declaration or annotation (comments are skipped)."""
    stop = _first(ahead, lambda f: flag(f, "stop"))
    found = _first(ahead, lambda f: flag(f, evidence))
    return (found > 0) & ((stop == 0) | (found < stop))


# --- W5: brace-delimited method block ---------------------------------------------------

def block_lines(text: Column) -> Column:
    """Lines of the block that starts ``text``: up to the first ``}`` that brings the depth
    back to 0 after a ``{``; NULL if that does not happen.  Depth may go negative
    before the first ``{``; it is not clamped.
    """
    marks = F.split(F.regexp_replace(text, "[^{}\n]", ""), "")

    def state(depth, opened, line, end):
        return F.struct(depth.alias("depth"), opened.alias("opened"), line.alias("line"), end.alias("end"))

    def step(a, ch):
        return (F.when(a["end"].isNotNull(), a)
                .when(ch == "\n", state(a["depth"], a["opened"], a["line"] + 1, a["end"]))
                .when(ch == "{", state(a["depth"] + 1, F.lit(True), a["line"], a["end"]))
                .when(ch == "}", state(a["depth"] - 1, a["opened"], a["line"],
                                       F.when(a["opened"] & (a["depth"] == 1), a["line"])))
                .otherwise(a))

    none = F.lit(None).cast("int")
    return F.aggregate(marks, state(F.lit(0), F.lit(False), F.lit(1), none), step)["end"]


def framed(files: DataFrame, specs, every_file: bool = False) -> DataFrame:
    """Candidate lines with the columns that ``operators.detectors.condition`` reads."""
    ids = {s.id for s in specs}
    out = candidate_lines(files, specs, every_file)
    f = F.col("flags")
    for d, evidence, run, plain in ((rules.ENCRYPTION, "enc_ev", "run_enc", "plain_enc"),
                                    (rules.FINANCIAL, "prot_ev", "run_prot", "plain_prot")):
        if d in ids:
            out = out.withColumn(f"protected_{evidence}", flag(f, evidence, run)
                                 | F.coalesce(forward_has(F.col("ahead"), plain), F.lit(False)))
    if rules.MARKETING in ids:
        out = out.withColumns({f"ctx_{n}": _has(F.col("around"), n) for n in ("intent", "optin")})
    if rules.CONSENT in ids:
        out = out.withColumn("blk_size", F.coalesce(block_lines(F.col("blk_text")), F.lit(BLOCK)))
        inside = F.slice("blk_flags", F.lit(1), F.col("blk_size"))
        out = out.withColumns({f"blk_{n}": _has(inside, n) for n in ("personal", "consent")})
    return out.drop("ahead", "around", "blk_text", "blk_flags", "blk_size")
