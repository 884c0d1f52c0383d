"""Law lookups as joins.

The law table is a dimension table of any size: joins carry no hint, so Spark
broadcasts it below its size threshold and shuffles it beyond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(requests: DataFrame, laws: DataFrame, id_col: str = "id") -> DataFrame:
    """Every requested ID with its law row (NULL columns where unknown)."""
    dim = laws
    return requests.join(dim, requests[id_col] == dim["id"], "left").drop(dim["id"])


def unknown_ids(requests: DataFrame, laws: DataFrame, id_col: str = "id") -> DataFrame:
    """A6 error case: requested IDs with no law row (left anti join)."""
    dim = laws.select("id")
    return requests.join(dim, requests[id_col] == dim["id"], "left_anti")


def list_laws(laws: DataFrame) -> DataFrame:
    """All laws in load order."""
    return laws.orderBy("ord")


def expand_findings(findings: DataFrame, laws: DataFrame) -> DataFrame:
    """One row per (finding, related law) with the law's columns."""
    exploded = findings.select("*", F.posexplode("related_laws").alias("law_pos", "law_id"))
    dim = laws.select(F.col("id").alias("law_id"), F.col("name_en").alias("law_name_en"),
                            F.col("name_ko").alias("law_name_ko"),
                            F.col("risk_level").alias("law_risk_level"), F.col("url").alias("law_url"))
    return exploded.join(dim, "law_id", "left")


def detector_law_gaps(detectors: DataFrame, laws: DataFrame) -> DataFrame:
    """Related-law IDs of detectors that the law table lacks (expected: none)."""
    ids = detectors.select("id", F.explode("related_laws").alias("law_id"))
    return unknown_ids(ids, laws, "law_id")


# the live response format: <LawSearch><law><법령명_한글/><조문내용/></law>...</LawSearch>
RESPONSE_SCHEMA = "law ARRAY<STRUCT<`법령명_한글`: STRING, `조문내용`: STRING>>"


def refresh(laws: DataFrame, responses: DataFrame) -> DataFrame:
    """A10: laws with ``full_text`` from landed search responses ``(query, body)`` and, if there is one, ``arrived``.

    A law's query is its ``name_ko``.  The first ``law`` entry of a response
    rooted at ``LawSearch`` (comments may precede it) gives the text; a missing, empty, non-XML or
    differently rooted response leaves ``full_text`` NULL (the bundled row is
    kept, as the live lookup falls back to it).  Of several responses to a
    query the earliest with a text counts; those that arrived together, or
    have no ``arrived``, by the text.
    """
    arrived = F.col("arrived") if "arrived" in responses.columns else F.lit(None).cast("long")
    parsed = responses.select(
        F.col("query"), arrived.alias("arrived"),
        F.when(F.col("body").rlike(r"(?s)^\s*(<\?xml[^>]*\?>\s*)?(?><!--.*?-->\s*)*<LawSearch[\s>]"),
               F.get(F.from_xml("body", RESPONSE_SCHEMA)["law"], 0)["조문내용"]).alias("full_text"))
    last = F.struct(F.col("arrived").isNull(), F.col("arrived"), F.col("full_text"))  # without a time after all others
    per_query = (parsed.where("full_text is not null").groupBy("query")
                 .agg(F.min_by("full_text", last).alias("full_text")))
    return laws.join(per_query, laws["name_ko"] == per_query["query"], "left").drop("query")
