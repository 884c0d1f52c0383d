"""Detectors D1-D6 as column expressions over framed lines.

Each detector is a ``when(condition, finding_struct)`` over a framed
candidate line; the scan puts all selected detectors in one array per line and
explodes it, so the lines are read once for all of them.  The reported field
is taken out of the finding rows by RE2, the dialect of the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from ..functions import re2
from ..functions.text import flag, unicode_trim

FINDING_FIELDS = ("detector_id", "risk_level", "file_path", "line_number",
                  "snippet", "message", "related_laws")

FINDING_SCHEMA = T.StructType([
    T.StructField("detector_ord", T.IntegerType(), False),
    T.StructField("detector_id", T.StringType(), False),
    T.StructField("risk_level", T.StringType(), False),
    T.StructField("file_path", T.StringType(), True),
    T.StructField("line_number", T.IntegerType(), True),
    T.StructField("snippet", T.StringType(), True),
    T.StructField("message", T.StringType(), True),
    T.StructField("related_laws", T.ArrayType(T.StringType(), False), False),
])


def _f(name: str) -> Column:
    return flag(F.col("flags"), name)


def finding(spec: rules.DetectorSpec, file_path: Column, line_no: Column, line: Column) -> Column:
    """A finding without its message: ``line`` is kept until the field is taken out of it."""
    return F.struct(
        F.lit(spec.ord).alias("detector_ord"),
        F.lit(spec.id).alias("detector_id"),
        F.lit(spec.risk_level).alias("risk_level"),
        file_path.alias("file_path"),
        line_no.cast("int").alias("line_number"),
        line.alias("line"),
        F.array(*[F.lit(x) for x in spec.related_laws]).alias("related_laws"),
    )


def with_message(found: DataFrame, specs) -> DataFrame:
    """``found`` with the detector's message, and in it the field that its trigger matched in the line."""
    fields = [(s.ord, s.trigger, s.field_group) for s in specs if s.field_group is not None]
    which = F.col("detector_ord")
    out = found.withColumn("field", re2.matched_field(F.col("line"), which, fields) if fields else F.lit(""))
    text = F.lit(None).cast("string")
    for s in specs:
        head, named, tail = s.message.partition("%s")
        text = F.when(which == s.ord, F.concat(F.lit(head), F.col("field"), F.lit(tail)) if named else F.lit(head)).otherwise(text)
    return out.withColumn("message", text)


# --- conditions on a framed line (columns produced by plans.scan.frame_lines) --

def condition(spec: rules.DetectorSpec) -> Column:
    d = spec.id
    if d == rules.LOGGING:
        return _f("log")
    if d == rules.ENCRYPTION:
        return _f("ident") & ~F.col("protected_enc_ev")
    if d == rules.CONSENT:
        return _f("mapping") & F.col("blk_personal") & ~F.col("blk_consent")
    if d == rules.MARKETING:
        return _f("send") & F.col("ctx_intent") & ~F.col("ctx_optin")
    if d == rules.FINANCIAL:
        return _f("fin") & ~F.col("protected_prot_ev")
    if d == rules.RETENTION:
        # the first record line of a file with no retention evidence anywhere
        return (_f("record") & (F.col("line_no") == F.col("file_first_record"))
                & F.col("file_has_record") & ~F.col("file_has_retention"))
    raise ValueError(f"unknown detector {d}")


def line_findings(framed: DataFrame, specs) -> DataFrame:
    """One row per finding of the line-level detectors, in one pass over ``framed``."""
    per_line = [F.when(condition(s), finding(s, F.col("file_path"), F.col("line_no"), F.col("line")))
                for s in specs]
    arr = F.filter(F.array(*per_line), lambda x: x.isNotNull())
    found = framed.select(F.explode(arr).alias("f")).select("f.*")
    return with_message(found, specs).select(
        "detector_ord", "detector_id", "risk_level", "file_path", "line_number",
        unicode_trim(F.col("line")).alias("snippet"), "message", "related_laws")


def detector_catalog(spark: SparkSession) -> DataFrame:
    """The detector catalogue in registration order (6 rows)."""
    rows = [(d.ord, d.id, d.name, d.description, list(d.related_laws), d.risk_level)
            for d in rules.DETECTORS]
    schema = "detector_ord INT, id STRING, name STRING, description STRING, " \
             "related_laws ARRAY<STRING>, risk_level STRING"
    return spark.createDataFrame(rows, schema)
