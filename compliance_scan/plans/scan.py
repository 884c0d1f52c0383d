"""The scan plan: sources -> line flags -> candidate lines with their context -> findings.

**Whole files** (``scan``, a ``(file_path, content)`` table): one pass, no shuffle.

1. one Arrow projection (RE2) drops texts in which no trigger of the selected
   detectors matches, and gives the others the array of their line flags: every
   regex is evaluated once per line, and the corpus is read once;
2. ``operators.contexts`` lets every candidate line take along bounded slices of
   its file (10 lines ahead, 10 around, a block of 31) and explodes these alone;
3. one explode emits the findings of all detectors, and a second, small Arrow
   projection takes the reported field out of the finding lines.

Tasks hold files one by one; nothing is collected into one task, one group or
the driver.  A file has to fit into a row here.

**Tables of lines** (``scan_lines``, where a file may be larger than a row):

1. the same flags per line, packed into an INT bitmask;
2. lines with neither a flag nor a brace are left out; the others are tagged with
   their *chunk* (``(line_no-1) div chunk_lines``), copied into neighbouring
   chunks whose frames reach them (halo: 10 lines back, 30 forward), and shuffled
   ONCE on ``(file_path, chunk)``; all frames are one sort + window pass;
3. per ``(file, chunk)``, a fixed-width HashAggregate with map-side combine and a
   window over that small table give the carry of the unbounded annotation run
   and the file-wide retention evidence; candidate lines join it on ``(file_path,
   chunk)``.  Flags feed both consumers; ``materialized=True`` computes them once
   with a reliable checkpoint.

A file of any size is thus spread over ``lines / chunk_lines`` tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import re2
from ..functions.text import TRIGGER_FLAGS, flag, needed_flags
from ..operators import contexts as ctx
from ..operators import detectors as det
from ..operators import frames as fr
from ..session import materialize
from ..sources.files import read_lines, read_sources, walked

DEFAULT_CHUNK_LINES = 1 << 16
ROW_BYTES = 256 << 20  # files larger than this are not held in one row


def _f(name: str):
    return flag(F.col("flags"), name)


def flag_files(sources: DataFrame, specs, prefilter: bool = True) -> DataFrame:
    """``(file_path, content, flags)``: one row per file that can have findings, with the flags of its lines."""
    triggers = [s.trigger for s in specs] if prefilter else ()
    flagged = _with_flags(sources, specs, triggers)
    return flagged.where("flags is not null")


def _with_flags(sources: DataFrame, specs, triggers) -> DataFrame:
    flags = re2.file_flags(F.col("content"), needed_flags([s.id for s in specs]), triggers)
    return sources.select("file_path", "content", flags.alias("flags"))


def flag_lines(lines: DataFrame, specs) -> DataFrame:
    """One row per line: ``(file_path, line_no, flags, line, braces)``; no shuffle.

    ``line`` is kept only on trigger lines (snippet / field source) and
    ``braces`` only where the line has a brace, so the table is mostly
    file path, two INTs and NULLs.
    """
    ids = [s.id for s in specs]
    names = needed_flags(ids)
    with_braces = rules.CONSENT in ids
    lf = re2.line_flags(F.col("line"), names, with_braces)
    flagged = lines.select("file_path", "line_no", "line", lf.alias("lf"))
    flags = F.col("lf.flags") if with_braces else F.col("lf")
    braces = F.col("lf.braces") if with_braces else F.lit(None).cast("string")
    triggers = [flag(flags, n) for n in TRIGGER_FLAGS if n in names]
    keep_text = reduce(lambda a, b: a | b, triggers) if triggers else F.lit(False)
    return flagged.select(F.col("file_path"), F.col("line_no").cast("int").alias("line_no"),
                          flags.alias("flags"), F.when(keep_text, F.col("line")).alias("line"),
                          braces.alias("braces"))


def carrying(flagged: DataFrame) -> DataFrame:
    """The lines that carry a flag or a brace; frames go by line number and miss no other."""
    return flagged.where((F.col("flags") != 0) | F.col("braces").isNotNull())


def chunk_with_halo(flagged: DataFrame, chunk_lines: int = DEFAULT_CHUNK_LINES,
                    num_partitions: int | None = None) -> DataFrame:
    """Tag chunks, copy halo rows, shuffle once on ``(file_path, chunk)``."""
    if chunk_lines <= 0:
        raise ValueError("chunk_lines must be positive")
    i = F.col("line_no") - 1
    first = F.greatest(F.lit(0), F.floor((i - fr.FORWARD_HALO) / chunk_lines)).cast("int")
    last = F.floor((i + fr.BACKWARD_HALO) / chunk_lines).cast("int")
    chunked = (flagged.withColumn("chunk", F.explode(F.sequence(first, last)))
               .withColumn("core", F.col("chunk") == (i / chunk_lines).cast("int")))
    parts = [num_partitions] if num_partitions else []
    return chunked.repartition(*parts, "file_path", "chunk")


_EVIDENCE = ((rules.ENCRYPTION, "enc_ev"), (rules.FINANCIAL, "prot_ev"))


def chunk_summary(flagged: DataFrame, specs, chunk_lines: int = DEFAULT_CHUNK_LINES) -> DataFrame | None:
    """Per ``(file_path, chunk)``: what a line needs to know about the rest of its file.

    * ``carry_brk`` / ``carry_<evidence>``: last non-annotation line and last
      annotated evidence line in all earlier chunks (W2 across chunks);
    * ``file_has_record``, ``file_has_retention``, ``file_first_record``: the
      file-wide retention check (W6/W7).

    Fixed-width aggregates only (HashAggregate, partial before the shuffle);
    then a window over the chunks of each file -- one row per chunk, so even a
    file with a third of all lines has only ``lines / chunk_lines`` rows here.
    Without the retention detector only chunks > 0 are kept (multi-chunk
    files), so the table is tiny and AQE broadcasts it.
    """
    ids = {s.id for s in specs}
    evidences = [e for d, e in _EVIDENCE if d in ids]
    retention = rules.RETENTION in ids
    if not evidences and not retention:
        return None
    ln = F.col("line_no")
    aggs = []
    if evidences:
        aggs.append(F.max(F.when(~_f("annot"), ln)).alias("brk"))
        aggs += [F.max(F.when(_f("annot") & _f(e), ln)).alias(f"aev_{e}") for e in evidences]
    if retention:
        aggs += [F.max(_f("record")).alias("has_record"), F.max(_f("retained")).alias("has_retention"),
                 F.min(F.when(_f("record"), ln)).alias("first_record")]
    per_chunk = (flagged.select("file_path", "line_no", "flags",
                                ((ln - 1) / chunk_lines).cast("int").alias("chunk"))
                 .groupBy("file_path", "chunk").agg(*aggs))
    by_file = Window.partitionBy("file_path").orderBy("chunk")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cols = [F.col("file_path"), F.col("chunk")]
    if evidences:
        cols.append(F.max("brk").over(before).alias("carry_brk"))
        cols += [F.max(f"aev_{e}").over(before).alias(f"carry_{e}") for e in evidences]
    if retention:
        cols += [F.max("has_record").over(whole).alias("file_has_record"),
                 F.max("has_retention").over(whole).alias("file_has_retention"),
                 F.min("first_record").over(whole).alias("file_first_record")]
    summary = per_chunk.select(*cols)
    return summary if retention else summary.where(F.col("chunk") > 0)


def frame_lines(prepared: DataFrame, specs, summary: DataFrame | None = None,
                only_triggers: bool = True, chunk_lines: int = DEFAULT_CHUNK_LINES) -> DataFrame:
    """All frame columns of the selected detectors for core lines, in one window pass.

    ``prepared`` comes from ``chunk_with_halo``; ``summary`` from
    ``chunk_summary`` over the same lines.  With ``only_triggers`` the rows
    are cut to trigger lines before the summary is joined.
    """
    ids = {s.id for s in specs}
    evidences = [e for d, e in _EVIDENCE if d in ids]
    cols = [F.col(c) for c in ("file_path", "chunk", "line_no", "core", "flags", "line")]
    if evidences:
        first_line = F.col("chunk") * chunk_lines + 1
        prepared = prepared.withColumn("prev_annot", fr.previous_annotation())
        prepared = prepared.withColumn("run_start", fr.run_start(F.col("prev_annot")))
        cols.append(fr.previous_break(F.col("prev_annot"), F.col("run_start"), first_line).alias("prev_brk"))
        cols.append(fr.forward_stop().alias("fwd_stop"))
        for e in evidences:
            cols.append(fr.previous_annotated_evidence(e).alias(f"prev_{e}"))
            cols.append(fr.forward_evidence_line(e).alias(f"fwd_{e}"))
    if rules.MARKETING in ids:
        cols.append(fr.context_any("intent").alias("ctx_intent"))
        cols.append(fr.context_any("optin").alias("ctx_optin"))
    if rules.CONSENT in ids:
        cols.append(fr.block_items().alias("blk"))
        cols.append(fr.first_in_block("personal").alias("blk_first_personal"))
        cols.append(fr.first_in_block("consent").alias("blk_first_consent"))
        cols.append(fr.block_last_line().alias("blk_last"))
    framed = prepared.select(*cols).where(F.col("core"))

    if only_triggers:
        trig = [_f(ctx.TRIGGER_FLAG_OF[d]) for d in sorted(ids)]
        framed = framed.where(reduce(lambda a, b: a | b, trig))

    if rules.CONSENT in ids:
        end = F.when(_f("mapping"), fr.block_end(F.col("blk")))
        framed = (framed.withColumn("blk_end", end)
                  .withColumn("blk_personal", fr.block_has(F.col("blk_first_personal"), F.col("blk_end")))
                  .withColumn("blk_consent", fr.block_has(F.col("blk_first_consent"), F.col("blk_end"))))

    if summary is not None:
        framed = framed.join(summary, ["file_path", "chunk"], "left")
    elif evidences:  # single-chunk files only: nothing to carry
        framed = framed.withColumns({c: F.lit(None).cast("int")
                                     for c in ["carry_brk"] + [f"carry_{e}" for e in evidences]})
    if evidences:
        brk = F.coalesce(F.col("prev_brk"), F.col("carry_brk"))
        for d, e in _EVIDENCE:
            if d not in ids:
                continue
            by_annotation = fr.annotation_run_has(F.coalesce(F.col(f"prev_{e}"), F.col(f"carry_{e}")), brk)
            forward = fr.forward_has(F.col(f"fwd_{e}"), F.col("fwd_stop"))
            framed = (framed.withColumn(f"annot_{e}", by_annotation)
                      .withColumn(f"forward_{e}", forward)
                      .withColumn(f"protected_{e}", _f(e) | by_annotation | forward))
    return framed


def frames(lines: DataFrame, specs, chunk_lines: int = DEFAULT_CHUNK_LINES,
           num_partitions: int | None = None, only_triggers: bool = True,
           materialized: bool = False, dense: bool | None = None) -> DataFrame:
    """Flag lines, then frame them; see the module docstring for the plan.

    ``dense`` keeps lines that carry nothing, which is the default where all lines are asked for.
    """
    flagged = flag_lines(lines, specs)
    if only_triggers and all(s.id == rules.LOGGING for s in specs):
        return flagged.where(F.col("line").isNotNull())  # a line tells it alone: no frame, no shuffle
    if materialized:
        flagged = materialize(flagged)
    summary = chunk_summary(flagged, specs, chunk_lines)
    whole = dense if dense is not None else not only_triggers
    prepared = chunk_with_halo(flagged if whole else carrying(flagged), chunk_lines, num_partitions)
    return frame_lines(prepared, specs, summary, only_triggers, chunk_lines)


def scan_lines(lines: DataFrame, detectors=None, chunk_lines: int = DEFAULT_CHUNK_LINES,
               num_partitions: int | None = None, materialized: bool = False) -> DataFrame:
    """Findings of the selected detectors (default all six) over a ``(file_path, line_no, line)`` table."""
    specs = rules.resolve(detectors)
    framed = frames(lines, specs, chunk_lines, num_partitions, True, materialized)
    return det.line_findings(framed, specs)


def own_findings(sources: DataFrame, detector, place: int) -> DataFrame:
    """Findings of a caller's detector, the ``place``-th of them, in the columns of the others."""
    after = max(s.ord for s in rules.DETECTORS) + 1 + place
    types = {f.name: f.dataType for f in det.FINDING_SCHEMA}
    return detector(sources).select(F.lit(after).alias("detector_ord"),
                                    *[F.col(c).cast(types[c]).alias(c) for c in det.FINDING_FIELDS])


def scan(sources: DataFrame, detectors=None, prefilter: bool = True) -> DataFrame:
    """Findings for a ``(file_path, content)`` table (one row per file).

    Nothing runs and nothing is written when this is called.

    ``detectors`` may also hold callables of one's own: each takes the sources
    and returns the finding columns (``FINDING_FIELDS``); its findings stand
    after those of the built-in detectors, in the order of the list.
    """
    own = [d for d in detectors or () if callable(d)]
    named = None if detectors is None else [d for d in detectors if not callable(d)]
    parts = [own_findings(sources, d, i) for i, d in enumerate(own)]
    if named is None or named or not own:
        specs = rules.resolve(named)
        parts.insert(0, det.line_findings(ctx.framed(flag_files(sources, specs, prefilter), specs), specs))
    return reduce(lambda a, b: a.unionByName(b), parts)


def scan_counts(sources: DataFrame, detectors=None, target: Column | str | None = None) -> DataFrame:
    """``target_path, files_scanned, total_findings`` in one pass over the sources.

    The findings are counted where their candidates stand; no finding row is
    made, and files without any, or without content, count as scanned.  ``target``
    is a column over ``file_path`` or a constant; by default every file is one.
    """
    specs = rules.resolve(detectors)
    target = F.col("file_path") if target is None else F.lit(target) if isinstance(target, str) else target
    framed = ctx.framed(_with_flags(sources, specs, [s.trigger for s in specs]), specs, every_file=True)
    hits = reduce(lambda a, b: a + b, [F.coalesce(det.condition(s), F.lit(False)).cast("long") for s in specs])
    first = (F.coalesce(F.col("pos"), F.lit(0)) == 0).cast("long")
    return (framed.select(target.alias("target_path"), first.alias("f"), hits.alias("n"))
            .groupBy("target_path").agg(F.sum("f").alias("files_scanned"), F.sum("n").alias("total_findings")))


def scan_path(spark: SparkSession, path: str, pattern: str | None = None, detectors=None,
              row_bytes: int = ROW_BYTES, materialized: bool = False) -> DataFrame:
    """Findings of the files under ``path``: files up to ``row_bytes`` whole, larger ones as tables of lines."""
    found = walked(spark, path, pattern)
    whole = scan(read_sources(spark, path, pattern, row_bytes, found), detectors)
    return whole.unionByName(scan_lines(read_lines(spark, path, pattern, row_bytes, found), detectors, materialized=materialized))
