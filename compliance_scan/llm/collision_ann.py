"""Approximate nearest neighbours by collision-counting hashing.

Vectors are scaled to unit length and projected on ``N_LINES`` random lines.
For each line a block of vectors is kept as a sorted array of projections; a
query opens a window around its own projection on every line and widens all
windows together (virtual rehashing: the arrays stay as they are, only the
radius grows).  A vector that lies in the windows of at least ``SHARE`` of the
lines is verified by its exact cosine.  A query is done with a block once its
radius has reached the distance of its fifth-best verified vector: a nearer
vector would collide on two lines of three on average, which the threshold
undercuts by several standard deviations.  At the widest radius everything
left is verified, so every query gets its five.

Plan: queries (``vec_id`` divisible by ``every``) are dealt by hash into
chunks of at most about ``chunk_bytes``; a chunk is collected and broadcast,
and one map over all vectors searches each Arrow batch as a block.  A task
keeps the five best of each query of the chunk and carries them from block to
block, so it returns a bounded table; a window over (query, five rows a task)
ranks them.  The vectors are never shuffled.

Defined results: vectors that are null, empty, zero, or hold null or
non-finite components take no part, nor do rows without an id; vectors of
different length are not compared; candidates with the query's own id are left
out; of several query rows with one id the smallest vector is searched; ties
go to the smaller id; fewer candidates than five give fewer rows.  Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read

N_LINES = 40
SHARE = 0.5
FIRST_RADIUS, GROWTH, LAST_RADIUS = 0.15, 1.4, 2.0
EVERY = 50
K = 5
QUERIES_AT_ONCE = 256
CHUNK_BYTES = 16 << 20
SEED = 10

FOUND = "query_id long, vec_id long, score double"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def lines(dim: int, n: int = N_LINES, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by their largest component, and the lengths of the scaled rows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x, np.sqrt((x * x).sum(axis=1))


class Block:
    """Sorted projections of one block of vectors of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        self.scaled, self.length = _unit(vectors)
        on = (self.scaled / self.length[:, None]) @ lines(vectors.shape[1])
        self.order = np.argsort(on, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(on, self.order.T, axis=0).T.copy()

    def windows(self, on: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last places of each query's window on each line; ``on`` is (queries, lines)."""
        lo = np.empty(on.shape, dtype=np.int64)
        hi = np.empty(on.shape, dtype=np.int64)
        for j, values in enumerate(self.sorted):
            lo[:, j] = np.searchsorted(values, on[:, j] - radius, side="left")
            hi[:, j] = np.searchsorted(values, on[:, j] + radius, side="right")
        return lo, hi

    def scores(self, at: np.ndarray, query: np.ndarray, length: float) -> np.ndarray:
        """Exact cosines; every row is summed in the same order, so equal vectors tie."""
        return (self.scaled[at] * query).sum(axis=1) / (self.length[at] * length)


class Search:
    """The queries of one chunk and one length, with the best found so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.scaled, self.length = _unit(vectors)
        self.on = (self.scaled / self.length[:, None]) @ lines(vectors.shape[1])
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]

    def _reach(self) -> np.ndarray:
        """Distance of each query's k-th best so far."""
        kth = np.array([s[-1] if len(s) == self.k else -1.0 for s, _ in self.best])
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * kth))

    def _keep(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        own = ids != self.ids[q]
        s, i = np.concatenate([self.best[q][0], scores[own]]), np.concatenate([self.best[q][1], ids[own]])
        first = np.lexsort((i, -s))[:self.k]
        self.best[q] = s[first], i[first]

    def visit(self, block: Block) -> None:
        """Search one block for all queries, some at a time so that their counts stay small."""
        reach = self._reach()
        for first in range(0, len(self.ids), QUERIES_AT_ONCE):
            self._widen(block, np.arange(first, min(first + QUERIES_AT_ONCE, len(self.ids))), reach)

    def _widen(self, block: Block, open_: np.ndarray, reach: np.ndarray) -> None:
        """Widen the windows of the open queries until none can be bettered by this block."""
        n = len(block.ids)
        need = int(np.ceil(SHARE * self.on.shape[1]))
        known = reach < LAST_RADIUS
        # A query with five in hand opens its windows to their reach at once.
        radius = np.where(known, np.maximum(reach, 1e-9), FIRST_RADIUS)
        counts: dict[int, np.ndarray] = {}
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        while len(open_):
            lo, hi = block.windows(self.on[open_], radius[open_])
            still = []
            for row, q in enumerate(open_):
                last = radius[q] >= LAST_RADIUS
                a, b = seen.get(q, (None, None))
                pieces = []
                for j, order in enumerate(block.order):
                    if a is None:
                        pieces.append(order[lo[row, j]:hi[row, j]])
                    else:
                        pieces += (order[lo[row, j]:a[j]], order[b[j]:hi[row, j]])
                hits = np.bincount(np.concatenate(pieces), minlength=n)
                before = counts.get(q)
                total = hits if before is None else before + hits
                fresh = (total >= need) | last
                if before is not None:
                    fresh &= before < need
                at = np.nonzero(fresh)[0]
                if len(at):
                    self._keep(q, block.scores(at, self.scaled[q], self.length[q]), block.ids[at])
                counts[q], seen[q] = total, (lo[row], hi[row])
                s = self.best[q][0]
                if not last and (len(s) < self.k or np.sqrt(max(0.0, 2.0 - 2.0 * s[-1])) > radius[q]):
                    still.append(q)
                else:
                    counts.pop(q), seen.pop(q)
            open_ = np.array(still, dtype=np.int64)
            radius[open_] = np.minimum(radius[open_] * GROWTH, LAST_RADIUS)


def _usable(ids: pa.Array, lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids and vectors of the rows that take part."""
    keep = ids.is_valid().to_numpy(zero_copy_only=False) & lists.is_valid().to_numpy(zero_copy_only=False)
    mask = pa.array(keep)
    ids, lists = ids.filter(mask), lists.filter(mask)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
    ids = ids.to_numpy(zero_copy_only=False)
    out = {}
    for dim in np.unique(sizes).tolist():
        if dim:
            rows = np.nonzero(sizes == dim)[0]
            x = flat[starts[rows][:, None] + np.arange(dim)]
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            if good.any():
                out[dim] = ids[rows[good]].astype(np.int64), x[good]
    return out


def _valid(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, every: int = EVERY, k: int = K, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found of each query, by cosine."""
    sc = vectors.sparkSession.sparkContext
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    queries = (x.where((F.col("vec_id") % every == 0) & _valid(F.col("v")))
               .groupBy("vec_id").agg(F.min("v").alias("v")))
    size = queries.agg(F.sum(F.size("v") * 8 + 8)).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    found = None
    for c in range(chunks):
        part = queries if chunks == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c)
        rows = part.orderBy("vec_id").toArrow().combine_chunks()
        here = _usable(rows.column("vec_id").combine_chunks(), rows.column("v").combine_chunks()) if rows.num_rows else {}
        shared = sc.broadcast(here)

        def search(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searches = {dim: Search(ids, v, k) for dim, (ids, v) in shared.value.items()}
            for batch in batches:
                for dim, (ids, v) in _usable(batch.column(0), batch.column(1)).items():
                    if dim in searches:
                        searches[dim].visit(Block(ids, v))
            for s in searches.values():
                lengths = [len(b[1]) for b in s.best]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(s.ids, lengths), pa.int64()),
                    pa.array(np.concatenate([b[1] for b in s.best]), pa.int64()),
                    pa.array(np.concatenate([b[0] for b in s.best]), pa.float64())], schema=_FOUND)

        got = x.mapInArrow(search, FOUND)
        if chunks > 1:
            got = cut(got)
        found = got if found is None else found.union(got)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))
