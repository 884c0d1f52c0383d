"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over training windows.

Texts are lower-cased (A-Z) and cut into words at ASCII characters that are
neither digits nor letters.  A window is thirteen consecutive words of a
benchmark item; an item with fewer words is one window.  In each document the
word numbers (from the benchmark's vocabulary) are turned into rolling hashes,
looked up in the sorted hashes of the windows, and every hit is verified word
by word.

Plan: the benchmark is dealt into blocks of at most ``block_bytes`` of text by
a hash of the item.  A block is small by construction, so it is collected and
broadcast; the documents pass through one map per block, without a shuffle,
and between blocks the found spans are written to the shared folder.  An
ordinary benchmark is one block.

Defined results: null texts have no words; items without words are ignored; a
null item id counts as the text ``null``; repeated items and repeated
documents are treated alike, each row for itself; an empty benchmark or an
empty table hits nothing.  Input columns named like an output column are
replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read
from .words import words_of

WINDOW = 13
SHARE = 20  # contaminated: one word in SHARE or more is hit
BLOCK_BYTES = 16 << 20

_WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010FFFF]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)

SPAN = "struct<start:int,end:int,item:string>"


class Windows:
    """The windows of one block of items: rolling hashes by window length, and what they stand for."""

    def __init__(self, items: list[tuple[str, str | None]], length: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        known: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            n = min(length, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                known.setdefault(n, {}).setdefault(tuple(ids[i:i + n]), set()).add(item)
        self.windows = known
        self.hashes = {n: np.unique([_roll(np.array(w, dtype=np.uint64), n)[0] for w in found])
                       for n, found in known.items()}

    def spans(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """(first word, end, item) of every occurrence of a window among ``words``."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words], dtype=np.uint64)
        out = []
        for n, hashes in self.hashes.items():
            if len(ids) < n:
                continue
            rolled = _roll(ids, n)
            at = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
            for i in np.nonzero(hashes[at] == rolled)[0].tolist():
                for item in self.windows[n].get(tuple(ids[i:i + n].tolist()), ()):
                    out.append((i, i + n, item))
        return out


def _roll(ids: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(ids) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * _BASE + ids[i:len(ids) - n + 1 + i]
            out ^= out >> np.uint64(29)
    return out


def _merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """One span for runs of occurrences of the same item that touch or overlap."""
    out: list[tuple[int, int, str]] = []
    for start, end, item in sorted(spans, key=lambda s: (s[2], s[0])):
        if out and out[-1][2] == item and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), item)
        else:
            out.append((start, end, item))
    return out


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str | None]]]:
    """The items, dealt by hash into lists of about ``block_bytes`` of text each."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        yield [(r.item, r.text) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()]


def _occurrences(shared):
    @F.arrow_udf(f"array<{SPAN}>")
    def occurrences(texts: pa.Array) -> pa.Array:
        windows = shared.value
        found = [[dict(zip(("start", "end", "item"), s)) for s in _merged(windows.spans(words_of(t.as_py())))]
                 for t in texts]
        kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("item", pa.string())])
        return pa.array(found, pa.list_(kind))

    return occurrences


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``hit_spans``: the word ranges in which windows of an item occur."""
    sc = docs.sparkSession.sparkContext
    out = docs.withColumn("hit_spans", F.array().cast(f"array<{SPAN}>"))
    for k, items in enumerate(blocks(benchmark, block_bytes)):
        if k:
            out = cut(out)
        occur = _occurrences(sc.broadcast(Windows(items, window)))
        out = out.withColumn("hit_spans", F.concat("hit_spans", occur("text")) if k else occur("text"))
    return out


SUMMARY = "struct<n_words:bigint,n_hit:bigint,n_items:bigint,items_sha256:string>"


def _summary(texts: pa.Array, spans: pa.Array) -> pa.Array:
    rows = []
    for text, found in zip(texts, spans):
        found = found.as_py() or []
        n, hit, reach = len(words_of(text.as_py())), 0, 0
        for start, end in sorted((s["start"], s["end"]) for s in found):
            hit += max(0, end - max(start, reach))
            reach = max(reach, end)
        items = sorted({s["item"] for s in found})
        rows.append({"n_words": n, "n_hit": hit, "n_items": len(items),
                     "items_sha256": hashlib.sha256(",".join(items).encode()).hexdigest()})
    return pa.array(rows, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
                                     ("items_sha256", pa.string())]))


def judge(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with ``hit_spans``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``."""
    found = find_spans(docs, benchmark, **options)
    out = found.withColumn("_found", F.arrow_udf(_summary, SUMMARY)("text", "hit_spans"))
    out = out.withColumns({c: F.col(f"_found.{c}") for c in ("n_words", "n_hit", "n_items", "items_sha256")})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).drop("_found")


def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, found in zip(texts, spans):
        text, found = text.as_py(), found.as_py()
        if text is not None and found:
            places = [m.span() for m in _WORD.finditer(text)]
            kept, at = [], 0
            for start, end in sorted((s["start"], s["end"]) for s in found):
                kept.append(text[at:places[start][0]])
                at = max(at, places[end - 1][1])
            text = "".join(kept) + text[at:]
        out.append(text)
    return pa.array(out, pa.string())


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with the hit words cut out of the texts."""
    columns = docs.columns
    keyed = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    text = f"c{[c.lower() for c in columns].index('text')}"
    judged = judge(keyed.withColumn("text", F.col(text)), benchmark, **options)
    if remove == "documents":
        judged = judged.where(~F.col("contaminated"))
    elif remove == "spans":
        judged = judged.withColumn(text, F.arrow_udf(_without, "string")("text", "hit_spans"))
    else:
        raise ValueError(f"remove must be documents or spans, not {remove!r}")
    return judged.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, read(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not contaminated, with their columns as they were."""
    return clean(docs, read(spark, sf_dir, "benchmark"))


_SQL_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
              r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

ORACLE = f"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT item, least(13, len(w)) AS n, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, list_slice(w, i, i + n - 1) AS g FROM bw),
lengths AS (SELECT DISTINCT n FROM windows),
d AS (SELECT row_number() OVER () AS row_id, doc_id, {_SQL_WORDS} AS w FROM documents),
dw AS (SELECT row_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n),
hits AS (SELECT row_id, i, dw.n, item FROM dw JOIN windows ON dw.n = windows.n AND list_slice(w, i, i + dw.n - 1) = g),
places AS (SELECT row_id, unnest(range(i, i + n)) AS p FROM hits),
covered AS (SELECT row_id, count(DISTINCT p) AS n_hit FROM places GROUP BY row_id),
items AS (SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT row_id, item FROM hits) GROUP BY row_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (row_id) LEFT JOIN items USING (row_id)
"""
