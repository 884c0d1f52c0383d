"""Quality classifier: a generalised additive model with pairwise interactions.

Twelve surface features of a text are cut into quantile bins.  Cyclic
boosting visits the features in turn and adds a shrunken shallow tree (at most
four leaves over the ordered bins) to that feature's lookup table; afterwards
it does the same for the strongest feature pairs on a coarser grid.  A fitted
model is therefore a handful of tables, and scoring adds the looked-up values
of whole Arrow batches.

Plan: a bounded, hash-ordered sample of labelled rows (``max_rows``) is
joined to the documents and only its feature rows reach the driver, where the
tables are learnt.  Scoring is one map over the documents: no shuffle, a model
of a few kilobytes in the closure.

Defined results: a null text counts as empty; an empty text has a score like
any other; equal texts have equal scores; without usable labels every score is
0.5.  Extra columns are kept, but ``score`` and ``predicted`` are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, first_by_hash, labelled, read

FOLDS, HELD_OUT = 3, 1
MAX_ROWS = 20_000
FEATURES = ("log_words", "word_length", "upper_share", "digit_share", "mark_share", "distinct_words",
            "same_as_previous", "top_word", "distinct_pairs", "repeated_lines", "log_line_length", "longest_word")

_UPPER, _LOWER, _DIGIT, _SPACE, _MARK = range(5)


def _char_class(c: str) -> int:
    if c.isspace():
        return _SPACE
    if c.isdigit():
        return _DIGIT
    if c.isupper():
        return _UPPER
    return _LOWER if c.isalpha() else _MARK


@cache
def _classes() -> np.ndarray:
    """The class of every code point, 1.1 MB, made once per Python worker."""
    return np.fromiter(map(_char_class, map(chr, range(0x110000))), dtype=np.uint8, count=0x110000)


def features(text: str | None) -> list[float]:
    """The feature row of one whole text."""
    text = text or ""
    words = text.split()
    n = len(words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = np.bincount(_classes()[points], minlength=5)
    solid = max(1, len(points) - int(kinds[_SPACE]))
    letters = max(1, int(kinds[_UPPER] + kinds[_LOWER]))
    lines = [x for x in text.split("\n") if x]
    counts = Counter(words)
    return [
        float(np.log1p(n)),
        solid / n if n else 0.0,
        kinds[_UPPER] / letters,
        kinds[_DIGIT] / solid,
        kinds[_MARK] / solid,
        len(counts) / n if n else 0.0,
        sum(map(eq, words, words[1:])) / n if n else 0.0,
        max(counts.values()) / n if n else 0.0,
        len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 0.0,
        1.0 - len(set(lines)) / len(lines) if lines else 0.0,
        float(np.log1p(len(text) / max(1, len(lines)))),
        float(np.log1p(max(map(len, words)))) if n else 0.0,
    ]


@dataclass
class Gam:
    """Bin edges and lookup tables; ``intercept`` alone when there was nothing to learn."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (edge, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edge, x[:, j], side="right")]
        for a, b, table in self.pairs:
            out += table[np.searchsorted(self.coarse[a], x[:, a], side="right"),
                         np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of ordered bins (place 0: none)."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(np.argmax(gain))
    return (float(gain[k]), k + 1) if gain[k] > 1e-9 else (0.0, 0)


def _tree_1d(g: np.ndarray, h: np.ndarray, ridge: float, depth: int = 2) -> np.ndarray:
    """Leaf values per bin of a shallow tree over ordered bins."""
    _, k = _best_cut(g, h, ridge) if depth else (0.0, 0)
    if not k:
        return np.full(len(g), g.sum() / (h.sum() + ridge))
    return np.concatenate([_tree_1d(g[:k], h[:k], ridge, depth - 1), _tree_1d(g[k:], h[k:], ridge, depth - 1)])


def _tree_2d(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best tree that cuts one axis and then, on each side, the other."""
    best, values = -1.0, np.zeros_like(g)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for k in range(1, gg.shape[0]):
            total, parts = 0.0, []
            for part in (slice(0, k), slice(k, None)):
                gs, hs = gg[part].sum(0), hh[part].sum(0)
                gain, c = _best_cut(gs, hs, ridge)
                total += gain + gs.sum() ** 2 / (hs.sum() + ridge)
                parts.append((part, c, gs, hs))
            if total > best:
                best, out = total, np.zeros_like(gg)
                for part, c, gs, hs in parts:
                    for cols in ((slice(0, c), slice(c, None)) if c else (slice(None),)):
                        out[part, cols] = gs[cols].sum() / (hs[cols].sum() + ridge)
                values = out.T if turned else out
    return best, values


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse_bins: int = 8, rounds: int = 120, n_pairs: int = 6,
        pair_rounds: int = 40, rate: float = 0.2, ridge: float = 4.0) -> Gam:
    """Learn the tables from feature rows ``x`` and 0/1 labels ``y``."""
    n = len(y)
    if n == 0:
        return Gam()
    mean = (y.sum() + 0.5) / (n + 1)
    model = Gam(intercept=float(np.log(mean / (1 - mean))))
    if y.min() == y.max():
        return model
    columns = range(x.shape[1])
    model.edges = [_edges(x[:, j], bins) for j in columns]
    model.coarse = [_edges(x[:, j], coarse_bins) for j in columns]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(model.edges[j], x[:, j], side="right") for j in columns]
    margin = np.full(n, model.intercept)

    def slopes(cell: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return np.bincount(cell, y - p, size), np.bincount(cell, p * (1 - p), size)

    for _ in range(rounds):
        for j in columns:
            g, h = slopes(at[j], len(model.tables[j]))
            step = rate * _tree_1d(g, h, ridge)
            model.tables[j] += step
            margin += step[at[j]]

    low = [np.searchsorted(model.coarse[j], x[:, j], side="right") for j in columns]
    wide = [len(model.coarse[j]) + 1 for j in columns]
    ranked = []
    for a in columns:
        for b in range(a + 1, x.shape[1]):
            if wide[a] > 1 and wide[b] > 1:
                cell = low[a] * wide[b] + low[b]
                g, h = (v.reshape(wide[a], wide[b]) for v in slopes(cell, wide[a] * wide[b]))
                ranked.append((_tree_2d(g, h, ridge)[0], -a, -b, cell))
    chosen = sorted(ranked, key=lambda r: r[:3], reverse=True)[:n_pairs]
    tables = [np.zeros((wide[-a], wide[-b])) for _, a, b, _ in chosen]
    for _ in range(pair_rounds):
        for table, (_, _, _, cell) in zip(tables, chosen):
            g, h = (v.reshape(table.shape) for v in slopes(cell, table.size))
            step = rate * _tree_2d(g, h, ridge)[1]
            table += step
            margin += step.ravel()[cell]
    model.pairs = [(-a, -b, t) for t, (_, a, b, _) in zip(tables, chosen)]
    return model


def _batch_features(texts: pa.Array) -> np.ndarray:
    rows = [features(t.as_py()) for t in texts]
    return np.array(rows, dtype=float).reshape(len(rows), len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT,
          max_rows: int = MAX_ROWS, seed: int = 9) -> Gam:
    """Fit on at most ``max_rows`` labelled documents outside the held-out fold.

    The sample of ids is bounded, so it may be broadcast; only its feature
    rows (a hundred bytes each) come to the driver.
    """
    @F.arrow_udf("array<double>")
    def feature_row(texts: pa.Array) -> pa.Array:
        return pa.array(list(_batch_features(texts)), pa.list_(pa.float64()))

    chosen = first_by_hash(labelled(labels, label, folds, held_out), max_rows, seed)
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .select("doc_id", "y", feature_row("text").alias("x"))
            .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "x").limit(max_rows).collect())
    return fit(np.array([r.x for r in rows], dtype=float).reshape(len(rows), len(FEATURES)),
               np.array([r.y for r in rows], dtype=float))


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``."""
    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(_batch_features(texts)), pa.float64())

    out = docs.withColumn("score", scored("text"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    held = F.coalesce(crc_fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of good quality, with their columns as they were."""
    columns = docs.columns
    keyed = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    names = {c.lower(): f"c{i}" for i, c in enumerate(columns)}
    model = train(docs, read(spark, sf_dir, "labels"))
    kept = score(keyed.withColumn("text", F.col(names["text"])), model).where("predicted = 1")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
