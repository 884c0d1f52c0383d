"""Row-frame operators over the lines of a file.

All frames share one window specification -- partition by ``(file_path,
chunk)``, order by ``line_no`` -- so Catalyst evaluates them in a single
sort of each partition.  A *chunk* is a fixed-size run of lines of one file
plus halo rows copied from its neighbours (see ``plans.scan``), which keeps a
single huge file from becoming a single task.  Only *core* rows are reported;
halo rows are context.

Frames are RANGE frames on the line number, so lines that carry no flag and
no brace need not be there at all: the scan leaves them out before the
exchange.

W2 (backward annotation run) is unbounded, so its per-chunk part here is
completed by a carry from earlier chunks (``plans.scan.chunk_summary``).
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import flag

UNBOUNDED = Window.unboundedPreceding


def line_order():
    """The shared window: lines of one chunk of one file, in line order."""
    return Window.partitionBy("file_path", "chunk").orderBy("line_no")

# widest context the frames look at, in lines
FORWARD_HALO = max(rules.METHOD_BLOCK_LINES - 1, rules.FORWARD_EVIDENCE_LINES, rules.MARKETING_RADIUS)
BACKWARD_HALO = rules.MARKETING_RADIUS

_MAX_LINE = 2**31 - 1


def _f(name: str) -> Column:
    return flag(F.col("flags"), name)


# --- W2: backward contiguous run of annotation lines ------------------------

def previous_annotation() -> Column:
    """Last core annotation line before this one."""
    return F.max(F.when(F.col("core") & _f("annot"), F.col("line_no"))).over(
        line_order().rowsBetween(UNBOUNDED, -1))


def run_start(prev_annotation: Column) -> Column:
    """The line number where a run of annotation lines begins, NULL on all other lines."""
    follows = F.coalesce(prev_annotation == F.col("line_no") - 1, F.lit(False))
    return F.when(F.col("core") & _f("annot") & ~follows, F.col("line_no"))


def previous_break(prev_annotation: Column, start: Column, first_line: Column) -> Column:
    """Last line of the chunk before this one that is not an annotation (ends any run); NULL if there is none.

    Lines that are not there are no annotations, so the line before a run is
    the break of every line in it and right after it.
    """
    last_start = F.max(start).over(line_order().rowsBetween(UNBOUNDED, -1))
    in_run = prev_annotation == F.col("line_no") - 1
    return (F.when(F.col("line_no") == first_line, F.lit(None).cast("int"))
            .when(in_run, F.when(last_start > first_line, last_start - 1))
            .otherwise(F.col("line_no") - 1))


def previous_annotated_evidence(evidence: str) -> Column:
    """Last core annotation line before this one carrying ``evidence``."""
    return F.max(F.when(F.col("core") & _f("annot") & _f(evidence), F.col("line_no"))).over(
        line_order().rowsBetween(UNBOUNDED, -1))


def annotation_run_has(prev_evidence: Column, prev_break: Column) -> Column:
    """Evidence lies inside the unbroken annotation run right above the line."""
    return F.coalesce(prev_evidence > F.coalesce(prev_break, F.lit(0)), F.lit(False))


# --- W3: forward scan of the next N physical lines, stopping at a new field --

def forward_stop() -> Column:
    """First non-comment declaration or annotation line among the next N lines."""
    return F.min(F.when(~_f("c") & (_f("decl") | _f("annot")), F.col("line_no"))).over(
        line_order().rangeBetween(1, rules.FORWARD_EVIDENCE_LINES))


def forward_evidence_line(evidence: str) -> Column:
    """First plain code line with ``evidence`` among the next N lines (comments are skipped)."""
    plain = ~_f("c") & ~_f("decl") & ~_f("annot")
    return F.min(F.when(plain & _f(evidence), F.col("line_no"))).over(
        line_order().rangeBetween(1, rules.FORWARD_EVIDENCE_LINES))


def forward_has(evidence_line: Column, stop_line: Column) -> Column:
    return F.coalesce(evidence_line < F.coalesce(stop_line, F.lit(_MAX_LINE)), F.lit(False))


# --- W4: symmetric frame -------------------------------------------------------

def context_any(name: str) -> Column:
    """Any line within +-radius carries ``name`` (the flag already excludes comments)."""
    r = rules.MARKETING_RADIUS
    return F.max(_f(name)).over(line_order().rangeBetween(-r, r))


# --- W5: brace-delimited method block ----------------------------------------

def block_items() -> Column:
    """Brace-carrying lines among the next 31 (anchor included), in line order.

    Lines without braces are dropped (``collect_list`` skips NULLs), so the
    arrays stay short; tokens are tracked by ``first_in_block`` instead.
    """
    item = F.struct(F.col("line_no").alias("line_no"), F.col("braces").alias("braces"))
    return F.collect_list(F.when(F.col("braces").isNotNull(), item)).over(
        line_order().rangeBetween(0, rules.METHOD_BLOCK_LINES - 1))


def first_in_block(name: str) -> Column:
    """First line carrying ``name`` among the next 31 (anchor included)."""
    return F.min(F.when(_f(name), F.col("line_no"))).over(
        line_order().rangeBetween(0, rules.METHOD_BLOCK_LINES - 1))


def block_last_line() -> Column:
    """Last line the block budget reaches (anchor + 30, clipped at end of file), where all lines are there."""
    return F.max("line_no").over(line_order().rangeBetween(0, rules.METHOD_BLOCK_LINES - 1))


def block_end(items: Column) -> Column:
    """Last line of the block: the line of the first ``}`` that brings the depth
    back to 0 after a ``{`` was seen; NULL if that does not happen within the
    31-line budget (then the block is the whole budget, clipped at end of file).
    Depth may go negative before the first ``{``; it is not clamped.
    """
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("opened"),
                    F.lit(None).cast("int").alias("end"))

    def per_line(acc, x):
        def per_char(a, ch):
            return (F.when(a["end"].isNotNull(), a)
                    .when(ch == "{", F.struct((a["depth"] + 1).alias("depth"),
                                              F.lit(True).alias("opened"),
                                              a["end"].alias("end")))
                    .when(ch == "}", F.struct((a["depth"] - 1).alias("depth"),
                                              a["opened"].alias("opened"),
                                              F.when(a["opened"] & (a["depth"] == 1),
                                                     x["line_no"]).alias("end")))
                    .otherwise(a))
        return F.aggregate(F.split(F.coalesce(x["braces"], F.lit("")), ""), acc, per_char)

    return F.aggregate(items, zero, per_line)["end"]


def block_has(first_line: Column, end_line: Column) -> Column:
    """The block (anchor .. end, or the whole budget) contains ``first_line``."""
    return F.coalesce(first_line <= F.coalesce(end_line, F.lit(_MAX_LINE)), F.lit(False))
