"""Ranked lexical search: Block-Max MaxScore over compressed posting lists, shard heaps merged.

Terms are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII
characters.  With N documents that hold a term, L terms in all, n terms in a
document, df documents holding a term and tf its occurrences in a document, all
in 64-bit integers but the logarithm::

    w     = floor(1000 * ln((2 N + 2) / (2 df + 1)))
    m     = 25 + (75 n N) div L
    score = sum over the query's terms, repeats included, of w * ((10^9 tf) div (1000 tf + 8 m))

``build`` makes the index in one map over whole texts: each task cuts its
documents into *segments* of bounded text and writes, for every term of a
segment, one row with its posting list: blocks of ``BLOCK`` postings, document
gaps and frequencies packed to the narrowest width, and for each block its last
document, its largest frequency and its shortest document.  Another row holds
the ids and lengths of the segment's documents.  Since a score grows with tf and
falls with n, largest frequency and shortest document bound a block's scores
whatever N and L turn out to be.  The index is a Parquet table in the shared
folder; nothing is shuffled to build it.

``search`` takes the queries in blocks of bounded text.  A block's terms select
the posting lists (the only thing that is shuffled, by segment), and every task
searches its segments one after the other with one heap a query, so the
threshold of earlier segments serves the later ones.  In a segment the query's
lists are ordered by their bounds: as long as the sum of the smallest stays
below the threshold they are *non-essential*.  Essential lists are decompressed
and give the candidates; for each non-essential list, from the largest bound
down, the maxima of the candidates' blocks reject candidates first, and only the
blocks of those left are decompressed.  A candidate is dropped only where its
bound is below the threshold, so ties stay whole.  Each task returns at most
``k`` rows a query; these are merged in two rounds, so that no task gets the
heaps of all others.

Memory: a task holds one segment's selected lists and the heaps of one query
block.  A document larger than ``SEGMENT_BYTES`` is a segment of its own.

Defined results: null and empty texts have no terms; an item without terms, or
whose terms no document holds, has no rows; every row of the queries and of the
documents counts for itself, so repeated items are ranked each, and repeated
documents take a rank each; equal scores stand by ascending id, a null id last;
an empty table on either side gives an empty result.  Only the id and the text
of either table are read, so further columns may have any name.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, read, shared_folder
from .words import words_of

K = 10
BLOCK = 128
SEGMENT_BYTES = 16 << 20
SEGMENT_DOCS = 1 << 20
QUERY_BYTES = 1 << 20  # text of the queries that are broadcast at once
MERGES = 64            # groups of heaps in the first round of merging

INDEX = "segment long, term binary, docs long, total long, list binary"
_WIDTHS = (np.dtype("<u1"), np.dtype("<u2"), np.dtype("<u4"))


def _narrow(values: np.ndarray) -> tuple[int, bytes]:
    """Number of the narrowest width that holds ``values``, and their bytes in it."""
    most = int(values.max())
    code = 0 if most < 1 << 8 else 1 if most < 1 << 16 else 2
    return code, values.astype(_WIDTHS[code]).tobytes()


def pack(docs: np.ndarray, tfs: np.ndarray, sizes: np.ndarray, block: int = BLOCK) -> bytes:
    """One posting list: number of blocks, (last document, largest frequency, least size, end) of each, packed blocks.

    ``docs`` ascend; a block of one posting needs no more than its header.
    """
    starts = np.arange(0, len(docs), block)
    gaps = np.diff(docs, prepend=-1)
    heads = np.empty((len(starts), 4), dtype="<i4")
    heads[:, 0] = docs[np.minimum(starts + block, len(docs)) - 1]
    heads[:, 1] = np.maximum.reduceat(tfs, starts)
    heads[:, 2] = np.minimum.reduceat(sizes, starts)
    parts, end = [], 0
    for i, at in enumerate(starts.tolist()):
        if len(docs) - at > 1:
            (gap, gap_bytes), (tf, tf_bytes) = _narrow(gaps[at:at + block]), _narrow(tfs[at:at + block])
            parts += [bytes((gap, tf)), gap_bytes, tf_bytes]
            end += 2 + len(gap_bytes) + len(tf_bytes)
        heads[i, 3] = end
    return b"".join([np.int32(len(starts)).tobytes(), heads.tobytes(), *parts])


class Postings:
    """A packed list; its blocks are decompressed one by one, on demand."""

    def __init__(self, data: bytes):
        n = int(np.frombuffer(data, "<i4", 1)[0])
        heads = np.frombuffer(data, "<i4", 4 * n, 4).reshape(n, 4).astype(np.int64)
        self.last, self.most, self.least, self.ends = heads.T
        self.data, self.at = data, 4 + 16 * n
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def weigh(self, segment: Segment) -> Postings:
        """With the bounds of its blocks and their largest, without weights."""
        self.bounds = factor(self.most, segment.damping(self.least))
        self.bound = int(self.bounds.max())
        return self

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and frequencies of block ``b``."""
        start, end = int(self.ends[b - 1]) if b else 0, int(self.ends[b])
        if start == end:
            return self.last[b:b + 1], self.most[b:b + 1]
        at = self.at + start
        gap, tf = _WIDTHS[self.data[at]], _WIDTHS[self.data[at + 1]]
        n = (end - start - 2) // (gap.itemsize + tf.itemsize)
        gaps = np.frombuffer(self.data, gap, n, at + 2).astype(np.int64)
        tfs = np.frombuffer(self.data, tf, n, at + 2 + n * gap.itemsize).astype(np.int64)
        return np.cumsum(gaps) + (int(self.last[b - 1]) if b else -1), tfs

    def scored(self, b: int, segment: Segment) -> tuple[np.ndarray, np.ndarray]:
        """Documents of block ``b`` and the factor of each; kept for the other queries of the segment."""
        if b not in self.known:
            docs, tfs = self.block(b)
            self.known[b] = docs, factor(tfs, segment.m[docs])
        return self.known[b]


def factor(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Segment:
    """Documents of one segment (ids, null marks, numbers of terms) and the lists that a block of queries needs."""

    def __init__(self, data: bytes, docs: int, n: int, total: int):
        self.n, self.total = n, total
        self.ids = np.frombuffer(data, "<i8", docs)
        self.sizes = np.frombuffer(data, "<i8", docs, 8 * docs)
        self.nulls = np.frombuffer(data, "u1", docs, 16 * docs)
        self.m = self.damping(self.sizes)
        self.lists: dict[bytes, Postings] = {}

    def damping(self, sizes: np.ndarray) -> np.ndarray:
        return 25 + 75 * sizes * self.n // self.total

    def add(self, term: bytes, data: bytes) -> None:
        self.lists[term] = Postings(data).weigh(self)


class Heap:
    """The ``k`` best (score, id) of one query so far."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.nulls = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8)

    @property
    def least(self) -> int:
        """What a document must reach at least: a score above 0, and that of the last of a full heap."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def push(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        scores, ids, nulls = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.nulls, nulls)))
        best = np.lexsort((ids, nulls, -scores))[:self.k]
        self.scores, self.ids, self.nulls = scores[best], ids[best], nulls[best]


def search_segment(segment: Segment, query: list[tuple[bytes, int]], heap: Heap) -> None:
    """Block-Max MaxScore of one query, ``(term, weight)`` with repeats multiplied in, over one segment."""
    lists = sorted(((w * segment.lists[t].bound, w, segment.lists[t]) for t, w in query if t in segment.lists and w),
                   key=lambda x: x[0])
    least = heap.least
    below = [0]  # sums of the smallest bounds
    for bound, _, _ in lists:
        below.append(below[-1] + bound)
    if below[-1] < least:
        return
    essential = next(i for i in range(len(lists)) if below[i + 1] >= least)
    sums = np.zeros(len(segment.ids), dtype=np.int64)
    for _, w, postings in lists[essential:]:
        for b in range(len(postings.last)):
            docs, factors = postings.scored(b, segment)
            sums[docs] += w * factors
    found = np.nonzero(sums)[0]
    found = found[sums[found] + below[essential] >= least]
    for i in range(essential - 1, -1, -1):
        if not len(found):
            return
        _, w, postings = lists[i]
        at = np.searchsorted(postings.last, found)
        inside = at < len(postings.last)
        bounds = np.where(inside, w * postings.bounds[np.minimum(at, len(postings.last) - 1)], 0)
        keep = sums[found] + bounds + below[i] >= least
        found, at, inside = found[keep], at[keep], inside[keep]
        for b in np.unique(at[inside]).tolist():  # only blocks that a candidate is left in
            docs, factors = postings.scored(b, segment)
            mine = found[at == b]
            place = np.minimum(np.searchsorted(docs, mine), len(docs) - 1)
            sums[mine] += np.where(docs[place] == mine, w * factors[place], 0)
        found = found[sums[found] + below[i] >= least]
    if len(found):
        heap.push(sums[found], segment.ids[found], segment.nulls[found])


# --- building ------------------------------------------------------------------------------


def _segment_rows(segment: int, docs: list[tuple[int | None, np.ndarray]], terms: list[bytes]) -> Iterator[pa.RecordBatch]:
    sizes = np.array([len(ids) for _, ids in docs], dtype="<i8")
    nulls = np.array([i is None for i, _ in docs], dtype="u1")
    head = b"".join([np.array([i or 0 for i, _ in docs], dtype="<i8").tobytes(), sizes.tobytes(), nulls.tobytes()])

    def rows(names, counts, lists, total=0):
        n = len(names)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, segment)), pa.array(names, pa.binary()), pa.array(counts, pa.int64()),
             pa.array(np.full(n, total)), pa.array(lists, pa.binary())], ["segment", "term", "docs", "total", "list"])

    yield rows([None], [len(docs)], [head], int(sizes.sum()))
    keys, tfs = np.unique(np.concatenate([ids for _, ids in docs]) * len(docs) + np.repeat(np.arange(len(docs)), sizes),
                          return_counts=True)
    term, doc = np.divmod(keys, len(docs))
    starts = np.nonzero(np.diff(term, prepend=-1))[0]
    counts = np.diff(np.append(starts, len(term)))
    alone = starts[counts == 1]
    heads = np.stack([np.ones(len(alone)), doc[alone], tfs[alone], sizes[doc[alone]], np.zeros(len(alone))], 1).astype("<i4")
    data = heads.tobytes()
    for i in range(0, len(alone), 1 << 14):
        part = alone[i:i + (1 << 14)]
        yield rows([terms[t] for t in term[part].tolist()], np.ones(len(part), np.int64),
                   [data[20 * j:20 * j + 20] for j in range(i, i + len(part))])
    several = np.nonzero(counts > 1)[0]
    for i in range(0, len(several), 1 << 13):
        part = several[i:i + (1 << 13)]
        yield rows([terms[t] for t in term[starts[part]].tolist()], counts[part],
                   [pack(doc[a:a + n], tfs[a:a + n], sizes[doc[a:a + n]])
                    for a, n in zip(starts[part].tolist(), counts[part].tolist())])


def _segments(segment_bytes: int, segment_docs: int):
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, known = TaskContext.get().partitionId() << 32, [], 0, {}
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                words = words_of(text)
                if not words:
                    continue
                if held and (size + len(text) > segment_bytes or len(held) >= segment_docs):
                    yield from _segment_rows(number, held, list(known))
                    number, held, size, known = number + 1, [], 0, {}
                held.append((ident, np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))))
                size += len(text)
        if held:
            yield from _segment_rows(number, held, list(known))

    return segments


def build(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text",
          segment_bytes: int = SEGMENT_BYTES, segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """The index of every row of ``docs``, written to ``folder`` as Parquet and read from there."""
    spark = docs.sparkSession
    taken = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    taken.mapInArrow(_segments(segment_bytes, segment_docs), INDEX).write.parquet(folder)
    return spark.read.schema(INDEX).parquet(folder)


# --- searching -----------------------------------------------------------------------------


def _searches(shared, k: int):
    def searches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, n, total = shared.value
        heaps: dict[int, Heap] = {}
        segment, number = None, None

        def finish():
            if segment is not None:
                for item, query in queries:
                    search_segment(segment, query, heaps.setdefault(item, Heap(k)))

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for here, term, docs, data in zip(*columns):
                if here != number:  # its row of documents comes first
                    finish()
                    number, segment = here, Segment(data, docs, n, total)
                else:
                    segment.add(term, data)
        finish()
        items = [i for i, h in heaps.items() for _ in range(len(h.scores))]
        ids = [None if z else d for h in heaps.values() for d, z in zip(h.ids.tolist(), h.nulls.tolist())]
        scores = [s for h in heaps.values() for s in h.scores.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())],
                                         ["item", "doc_id", "score"])

    return searches


def _ranked(found: DataFrame, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order))


def _search_block(index: DataFrame, n: int, total: int, items: list[tuple[int, str]], k: int) -> DataFrame:
    spark = index.sparkSession
    wanted = [(i, Counter(words_of(t))) for i, t in items]
    terms = sorted({w for _, words in wanted for w in words})
    # bounded: the terms of QUERY_BYTES of text
    chosen = index.join(F.broadcast(spark.createDataFrame([(bytearray(t),) for t in terms], "term binary")), "term", "left_semi")
    df = {bytes(r.term): r.df for r in chosen.groupBy("term").agg(F.sum("docs").alias("df")).collect()}
    weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    queries = [(i, [(t, c * weights[t]) for t, c in words.items() if t in weights]) for i, words in wanted]
    shared = spark.sparkContext.broadcast((queries, n, total))
    columns = ["segment", "term", "docs", "list"]
    lists = index.where("term is null").select(*columns).unionByName(chosen.select(*columns))
    found = (lists.repartition("segment").sortWithinPartitions("segment", F.asc_nulls_first("term"))
             .mapInArrow(_searches(shared, k), "item long, doc_id long, score long"))
    found = _ranked(found.withColumn("part", F.spark_partition_id() % MERGES), ["item", "part"]).where(F.col("rank") <= k)
    return _ranked(found.drop("rank", "part"), ["item"]).where(F.col("rank") <= k)


def search(index: DataFrame, queries: DataFrame, item_id: str = "item_id", text: str = "text", k: int = K,
           query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every row of ``queries``."""
    spark = index.sparkSession
    stats = index.where("term is null").agg(F.sum("docs").alias("n"), F.sum("total").alias("total")).first()
    items = cut(queries.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text"))
                .where("text is not null").withColumn("item", F.monotonically_increasing_id()))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    out = spark.createDataFrame([], "item long, doc_id long, score long, rank int")
    if stats.n:
        n_blocks = -(-size // query_bytes)
        for b in range(n_blocks):
            mine = items.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b)
            held = [(r.item, r.text) for r in mine.collect()]  # about query_bytes
            if held:
                found = _search_block(index, stats.n, stats.total, held, k)
                out = out.unionByName(cut(found) if n_blocks > 1 else found)
    return out.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build(read(spark, sf_dir, "documents"), f"{shared_folder(spark)}/ranked-search-{uuid.uuid4().hex}")
    return search(index, read(spark, sf_dir, "benchmark"))


_SQL_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
              r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

ORACLE = f"""
WITH items AS (SELECT row_number() OVER () AS item, item_id, unnest({_SQL_WORDS}) AS term FROM benchmark),
wanted AS (SELECT item, item_id, term, count(*) AS c FROM items GROUP BY item, item_id, term),
d AS (SELECT row_number() OVER () AS row_id, doc_id, {_SQL_WORDS} AS ws FROM documents),
sized AS (SELECT row_id, doc_id, ws, len(ws) AS n FROM d WHERE len(ws) > 0),
stats AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS total FROM sized),
words AS (SELECT row_id, doc_id, n, unnest(ws) AS term FROM sized),
posts AS (SELECT row_id, doc_id, n, term, count(*) AS tf FROM words SEMI JOIN wanted USING (term) GROUP BY row_id, doc_id, n, term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM posts, stats GROUP BY term, n_docs),
scored AS (
  SELECT item, item_id, row_id, doc_id,
         sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // total))))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN posts USING (term), stats GROUP BY item, item_id, row_id, doc_id),
ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank,
                  doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""
