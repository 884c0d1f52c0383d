r"""Secret scans: base patterns, and a token-efficiency test for random strings.

Base kinds are ``assign`` (a password-like word, a separator and a value of
12 or more characters), ``access`` (an access key id) and ``hex`` (16 or more
hexadecimal digits).  The method adds ``random``: ``LEAST`` or more characters
of the base64 and URL alphabets that a tiktoken vocabulary needs unusually many
tokens for (fewer than ``MAX_RATIO`` characters a token).  Ordinary words and
identifiers are covered by long tokens; random strings are not.  A run is split
at ``/ _ = -``: neighbouring segments that are no words are tested together and
each for itself, so paths and key names do not dilute what stands behind them,
and the run is tested as a whole.  Known digests (given ones, and hexadecimal
strings of the usual digest lengths), UUIDs and what a base span covers are cut
out first; identifiers whose every part is covered by long tokens are excluded.

Plan: one map over whole texts; the vocabulary file (``vocabulary``, a path
readable on the driver, 0.8 MB) is broadcast as ranks and compiled once per
Python worker.  Nothing is shuffled.

Defined results: a null text is empty; an empty text has no spans; positions
are code points, ends exclusive; repeated rows are scanned each for itself.
Extra columns are kept, but ``secrets`` is replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable
from itertools import accumulate

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_RATIO = 2.0
# Of random base62 strings of 12 characters the ratio misses 0.3 %, of 8 characters 1.2 %; of the distinct
# segments of 12 and 13 characters in sf0.1 it takes 1.0 % for random, of 8 and 9 characters 3.0 %.
LEAST = 12
KINDS = ("assign", "access", "hex", "random")

# FIXED VALUES: the base patterns.
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
# The pattern by which the public byte-level vocabulary splits a text before merging.
_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}")
_SEPARATORS = re.compile(r"[/_=-]+")
_SEGMENT = re.compile(r"[A-Za-z0-9+]+")
_DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
_HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"(?<![A-Za-z0-9+])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![A-Za-z0-9+])")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def is_identifier(run: str, encoding: tiktoken.Encoding, max_ratio: float = MAX_RATIO) -> bool:
    """Words, each covered by long tokens, joined by case, underscores, dashes or slashes; numbers only as whole parts and not many."""
    parts = _PARTS.findall(run)
    words = [p for p in parts if not p.isdigit()]
    if words and len(parts) - len(words) > max(1, len(words) // 2):
        return False

    def covered(part: str) -> bool:
        tokens = len(encoding.encode_ordinary(part))
        return len(part) >= max_ratio * tokens or part.isdigit() and tokens == 1

    return all(map(covered, parts))  # signs alone have no part


def _free(run: str, known: frozenset[str], lengths: list[int], taken: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a run outside the spans ``taken``, UUIDs and known strings that stand between separators."""
    spans = [*taken, *(m.span() for m in _UUID.finditer(run))]
    if lengths:
        starts = [0, *(m.end() for m in _SEPARATORS.finditer(run))]
        ends = {len(run), *(m.start() for m in _SEPARATORS.finditer(run))} | {m.end() for m in _SEPARATORS.finditer(run)}
        spans += [(i, i + n) for i in starts for n in lengths if i + n in ends and run[i:i + n] in known]
    out, at = [], 0
    for start, end in sorted(spans):
        if start > at:
            out.append((at, start))
        at = max(at, end)
    if at < len(run):
        out.append((at, len(run)))
    return out


def random_spans(text: str, encoding: tiktoken.Encoding, known: Iterable[str] = (), max_ratio: float = MAX_RATIO,
                 taken: Iterable[tuple[int, int, str]] = ()) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    taken = sorted((s, e) for s, e, _ in taken)
    known = frozenset(known)
    lengths = sorted(set(map(len, known)))

    def word(part: str) -> bool:
        return len(part) in _DIGEST_LENGTHS and bool(_HEXADECIMAL.fullmatch(part)) or is_identifier(part, encoding, max_ratio)

    def judged(part: str) -> bool:
        return (len(part) >= LEAST and len(part) < max_ratio * len(encoding.encode_ordinary(part)) and not word(part))

    passed = 0  # spans are in order of their starts, runs follow each other
    reach = list(accumulate((e for _, e in taken), max))
    for m in _RUN.finditer(text):
        while passed < len(taken) and reach[passed] <= m.start():
            passed += 1
        over, at = [], passed
        while at < len(taken) and taken[at][0] < m.end():
            if m.start() < taken[at][1]:
                over.append((max(taken[at][0] - m.start(), 0), taken[at][1] - m.start()))
            at += 1
        for first, last in _free(m[0], known, lengths, over):
            piece, begin = m[0][first:last], m.start() + first
            if len(piece) < LEAST:
                continue
            segments = [x.span() for x in _SEGMENT.finditer(piece)]
            if not segments:
                continue
            # Neighbouring segments that are no words are one string whose separators are its own.
            chains: list[list[tuple[int, int]]] = [[]]
            for s, e in segments:
                if word(piece[s:e]):
                    chains.append([])
                else:
                    chains[-1].append((s, e))
            plain = len(chains) > 1
            if not plain and judged(piece):
                out.append((begin, begin + len(piece), "random"))
                continue
            found = []
            for chain in filter(None, chains):
                s, e = chain[0][0], chain[-1][1]
                found += [(s, e)] if judged(piece[s:e]) else [c for c in chain if judged(piece[slice(*c)])]
            if not found and judged(piece) and not any(word(piece[s:e]) and e - s >= LEAST for s, e in segments):
                found = [(0, len(piece))]
            out += [(begin + s, begin + e, "random") for s, e in found]
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines) if word}


_COMPILED: list = [None, None]  # ranks and their encoding, once per Python worker


def _encoding(ranks: dict[bytes, int]) -> tiktoken.Encoding:
    if _COMPILED[0] is not ranks:
        _COMPILED[:] = ranks, tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _COMPILED[1]


SPAN = "array<struct<start:long,end:long,kind:string>>"


def scan(docs: DataFrame, vocabulary: str = VOCABULARY, known_digests: Iterable[str] = (),
         max_ratio: float = MAX_RATIO) -> DataFrame:
    """``docs`` with ``secrets``: the spans by start, then kind in the order of ``KINDS``.

    ``known_digests`` is a list of strings that are no secrets; it is sent
    with the code and so should be small.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    known = frozenset(known_digests)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    @F.arrow_udf(SPAN)
    def spans(texts: pa.Array) -> pa.Array:
        encoding = _encoding(shared.value)
        out = []
        for t in texts:
            text = t.as_py() or ""
            found = base_spans(text)
            found += random_spans(text, encoding, known, max_ratio, found)
            found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
            out.append([{"start": s, "end": e, "kind": k} for s, e, k in found])
        return pa.array(out, kind)

    return docs.withColumn("secrets", spans("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                    s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return x.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"),
                    joined(F.col("secrets")).alias("spans"), count("random"))
