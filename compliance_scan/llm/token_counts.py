"""Token counts: a broadcast table of frequent pre-token lengths, and worker caches for the rest.

No token of the vocabulary crosses white space (its pattern splits there and
its normaliser changes nothing across it), so a text has as many tokens as its
stretches between ASCII white space have together.  These stretches are the
pre-tokens here.  Frequent ones are encoded once, on the driver, into a compact
hash table (sorted 64-bit hashes, lengths, and the strings themselves, against
which a worker checks its words); a worker loads it once.  Words that it lacks
are encoded in batches by the library and kept in a bounded cache of that
worker.  Special strings inside texts contain no white space and are encoded by
the library like any other miss.

Plan: one map over whole texts, no shuffle of texts or pre-tokens.  The
frequent words come from a bounded look at the corpus: up to ``SAMPLED_PARTS``
partitions spread over the table, together ``SAMPLE_BYTES`` of text, each
counted in its task and cut to the words it met twice or more.  That look only decides
what is encoded beforehand: the counts are the same with any table, also an
empty one.  The vocabulary file is read on the driver and broadcast as text
(1.7 MB), so executors need no such file.

Memory: a task holds the words of one piece of text (``PIECE_BYTES``, cut at
white space; only a longer stretch without any is longer), the frequent table
and at most ``CACHE_WORDS`` cached lengths.

Defined results: a null text is empty and has 0 tokens and 0 bytes; white space
alone has 0 tokens; repeated rows are counted each for itself; an empty table
gives an empty result.  ``count_tokens`` keeps all columns; one named like an
output column is replaced.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import read

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LIMIT = 2048           # tokens beyond which a document is over the limit
FREQUENT = 1 << 16     # words in the broadcast table at most
SAMPLED_PARTS = 64     # partitions that are looked at for frequent words
SAMPLE_BYTES = 16 << 20
CACHE_WORDS = 1 << 19  # cached lengths in a worker; the older half goes when it is full
PIECE_BYTES = 1 << 20
CACHED_BYTES = 64      # longer stretches are encoded each time and never cached

_WHITE = re.compile(rb"[\x09-\x0D\x20]")


def lengths(tokenizer: Tokenizer, words: list[bytes]) -> list[int]:
    """Tokens of each word, without added special tokens."""
    found = tokenizer.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False)
    return [len(e.ids) for e in found]


class Frequent:
    """Word -> length as one hash table of flat arrays: hashes in order, places of the words, lengths."""

    def __init__(self, words: list[bytes], sizes: list[int]):
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
        order = np.argsort(hashes, kind="stable")
        words = [words[i] for i in order]
        self.hashes = hashes[order]
        self.ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        self.bytes = b"".join(words)
        self.sizes = np.array(sizes, dtype=np.int32)[order]

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The length of each word, -1 where the table lacks it: by its hash, then by its bytes."""
        out = np.full(len(words), -1, dtype=np.int64)
        if not len(self) or not words:
            return out
        wanted = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self) - 1)
        for i in np.nonzero(self.hashes[at] == wanted)[0].tolist():
            j = int(at[i])
            while j < len(self) and self.hashes[j] == wanted[i]:
                if self.bytes[self.ends[j - 1] if j else 0:self.ends[j]] == words[i]:
                    out[i] = self.sizes[j]
                    break
                j += 1
        return out


class TokenCounter:
    """Token counts of texts in one worker: the frequent table first, then the cache, then the library."""

    def __init__(self, vocabulary: str, frequent: Frequent, cache_words: int = CACHE_WORDS,
                 piece_bytes: int = PIECE_BYTES):
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.frequent, self.cache_words, self.piece_bytes = frequent, cache_words, piece_bytes
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def _sizes(self, words: set[bytes]) -> dict[bytes, int]:
        """Lengths of all ``words``: cached ones, those of the table, and the rest encoded in one batch."""
        missing = words - self.young.keys()
        out = {w: self.young[w] for w in words - missing}
        known = missing & self.old.keys()
        new = {w: self.old[w] for w in known}
        rest = list(missing - known)
        found = self.frequent.find(rest)
        new.update((rest[i], int(found[i])) for i in np.nonzero(found >= 0)[0].tolist())
        unknown = [rest[i] for i in np.nonzero(found < 0)[0].tolist()]
        new.update(zip(unknown, lengths(self.tokenizer, unknown)))
        out.update(new)
        for w, size in new.items():
            if len(w) <= CACHED_BYTES:
                if len(self.young) >= self.cache_words // 2:
                    self.old, self.young = self.young, {}
                self.young[w] = size
        return out

    def count(self, texts: Iterable[str | None]) -> list[int]:
        """Tokens of each text; null texts have none."""
        out: list[int] = []
        held: list[tuple[int, list[bytes]]] = []
        size = 0

        def settle() -> None:
            sizes = self._sizes(set().union(*(words for _, words in held)))
            for i, words in held:
                out[i] += sum(map(sizes.__getitem__, words))
            held.clear()

        for text in texts:
            out.append(0)
            for piece in pieces((text or "").encode(), self.piece_bytes):
                held.append((len(out) - 1, piece.split()))
                size += len(piece)
                if size >= self.piece_bytes:
                    settle()
                    size = 0
        settle()
        return out


def pieces(text: bytes, most: int) -> Iterator[bytes]:
    """``text`` cut at white space into pieces of ``most`` bytes, a little more where no white space follows."""
    at = 0
    while len(text) - at > most:
        white = _WHITE.search(text, at + most)
        end = white.end() if white else len(text)
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


def _look(parts: int, chosen: int, each: int, words: int):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        seen, size = Counter(), 0
        if place * chosen // parts != (place - 1) * chosen // parts:
            for batch in batches:
                for text in batch.column(0):
                    piece = next(pieces((text.as_py() or "").encode(), each - size), b"")[:2 * each]
                    seen.update(w for w in piece.split() if len(w) <= CACHED_BYTES)
                    size += len(piece)
                    if size >= each:
                        break
                if size >= each:
                    break
        top = [(w, n) for w, n in seen.most_common(words) if n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()),
                                          pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    return look


def frequent_words(docs: DataFrame, text: str = "text", most: int = FREQUENT,
                   sample_bytes: int = SAMPLE_BYTES) -> list[bytes]:
    """Up to ``most`` words that a task of a bounded look at ``docs`` meets twice or more, most frequent first."""
    texts = docs.select(F.col(text).cast("string").alias("text"))
    parts = texts.rdd.getNumPartitions()
    chosen = min(parts, SAMPLED_PARTS)
    if not chosen:
        return []
    each = max(1, sample_bytes // chosen)
    # a task returns some of the words of its share of the sample, so all tasks together less than sample_bytes
    found = texts.mapInArrow(_look(parts, chosen, each, most), "word binary, n long").toArrow()
    total = found.group_by("word").aggregate([("n", "sum")]).sort_by([("n_sum", "descending"), ("word", "ascending")])
    return total.column("word").slice(0, most).to_pylist()


_WORKERS: dict[int, TokenCounter] = {}


def _counter(shared: Broadcast) -> TokenCounter:
    """The counter of this worker process for one broadcast table."""
    if shared.value["id"] not in _WORKERS:
        _WORKERS.clear()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _WORKERS[shared.value["id"]] = TokenCounter(shared.value["vocabulary"], shared.value["frequent"])
    return _WORKERS[shared.value["id"]]


def _tokens(shared: Broadcast):
    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        return pa.array(_counter(shared).count(t.as_py() for t in texts), pa.int64())

    return tokens


def count_tokens(docs: DataFrame, text: str = "text", limit: int = LIMIT, vocabulary: str = VOCABULARY,
                 frequent: int = FREQUENT) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    with open(vocabulary, encoding="utf-8") as file:
        rules = file.read()
    words = frequent_words(docs, text, frequent)
    table = Frequent(words, lengths(Tokenizer.from_str(rules), words))
    key = xxhash.xxh3_64_intdigest(rules.encode() + table.bytes + table.sizes.tobytes())
    shared = docs.sparkSession.sparkContext.broadcast({"id": key, "vocabulary": rules, "frequent": table})
    source = F.col(text).cast("string")
    new = {"n_bytes": F.coalesce(F.octet_length(source), F.lit(0)).cast("long"), "n_tokens": _tokens(shared)(source)}
    out = docs.withColumns(new)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
