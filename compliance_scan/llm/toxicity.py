"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, white space is folded into single blanks, and its
distinct character 3-, 4- and 5-grams are hashed into ``N_FEATURES`` places.
On labelled texts each place gets the log ratio of its smoothed document
frequencies in the two classes; a logistic regression is then trained on the
presence of places scaled by these ratios.  Ratio times weight makes a single
table, and a score is the logistic of the sum over a text's distinct places.

Plan: a bounded, hash-ordered sample of labelled rows (``per_class`` a class)
is joined to the documents, and only the sample's places reach the driver.
Scoring is one map over whole texts, in pieces of bounded size, with a table of
fixed size (2 MB) as broadcast; nothing is shuffled.

Defined results: a null text counts as empty; an empty text scores the
intercept; equal texts have equal scores; without usable labels every score is
0.5 and, with one class only, near that class.  Extra columns are kept, but
``score`` and ``predicted`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, first_by_hash, labelled, read

FOLDS, HELD_OUT = 5, 0
PER_CLASS = 2_000
N_FEATURES = 1 << 18
GRAMS = (3, 4, 5)
RARE = 3  # places in fewer texts of the sample tell nothing
_PIECE = 1 << 20
_BLOCK = 1 << 20  # places of the sample that a pass holds at a time


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces that overlap by the longest n-gram less one."""
    for i in range(0, max(1, len(text)), _PIECE):
        yield text[i:i + _PIECE + GRAMS[-1] - 1]


def places(text: str | None, scratch: np.ndarray) -> np.ndarray:
    """Distinct hashed places of a text's n-grams, sorted; ``scratch`` holds one flag for each place, all down."""
    text = f" {' '.join((text or '').lower().split())} "
    found = []
    for piece in _pieces(text):
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        rolled = points
        for n in range(2, GRAMS[-1] + 1):
            if len(points) < n:
                break
            rolled = rolled[:-1] * np.uint64(0x100000001B3) + points[n - 1:]
            if n in GRAMS:
                mixed = (rolled + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                at = (mixed >> np.uint64(46)).astype(np.int64)
                at = at[~scratch[at]]
                scratch[at] = True
                found.append(at)
    if not found:
        return np.zeros(0, dtype=np.int64)
    every = np.concatenate(found)
    scratch[every] = False
    return np.unique(every)


class NbLinear:
    """``table``: ratio times weight of each place."""

    def __init__(self, table: np.ndarray | None = None, intercept: float = 0.0):
        self.table = np.zeros(N_FEATURES) if table is None else table
        self.intercept = intercept

    def scores(self, texts) -> np.ndarray:
        scratch = np.zeros(N_FEATURES, dtype=bool)
        margins = np.array([self.intercept + self.table[places(t, scratch)].sum() for t in texts], dtype=float)
        return 1.0 / (1.0 + np.exp(-np.clip(margins, -40, 40)))


class Sample:
    """The places of some texts, one after the other; passes over them go by blocks of bounded size."""

    def __init__(self, at: np.ndarray, lengths: np.ndarray):
        self.at, self.lengths = at, lengths
        self.ends = np.concatenate([[0], np.cumsum(lengths)])

    def _blocks(self) -> Iterator[tuple[slice, np.ndarray]]:
        first, n = 0, len(self.lengths)
        while first < n:
            last = max(first + 1, int(np.searchsorted(self.ends, self.ends[first] + _BLOCK, side="right")) - 1)
            yield slice(first, last), self.at[self.ends[first]:self.ends[last]]
            first = last

    def totals(self, table: np.ndarray) -> np.ndarray:
        """The table's sum over each text's places."""
        out = np.zeros(len(self.lengths))
        for rows, at in self._blocks():
            some = self.lengths[rows] > 0
            if len(at):
                starts = (self.ends[rows] - self.ends[rows.start])[some]
                out[rows][some] = np.add.reduceat(table[at], starts)
        return out

    def without_rare(self, least: int) -> Sample:
        """The sample without places that fewer than ``least`` of its texts have."""
        often = self.spread(np.ones(len(self.lengths))) >= least
        kept = often[self.at]
        before = np.concatenate([[0], np.cumsum(kept)])
        return Sample(self.at[kept], np.diff(before[self.ends]))

    def spread(self, weight: np.ndarray) -> np.ndarray:
        """For each place, the sum of the weights of the texts that have it."""
        out = np.zeros(N_FEATURES)
        for rows, at in self._blocks():
            out += np.bincount(at, np.repeat(weight[rows], self.lengths[rows]), N_FEATURES)
        return out


def _learn(sample: Sample, y: np.ndarray, use: np.ndarray, smoothing: float, ridge: float, steps: int,
           rate: float) -> NbLinear:
    """Log-count ratios from the texts in ``use``, then logistic regression by Adam on the scaled places.

    Both classes weigh the same.
    """
    one, none = use * y, use * (1 - y)
    toxic, clean = sample.spread(one) + smoothing, sample.spread(none) + smoothing
    ratio = np.log(toxic / (one.sum() + 2 * smoothing)) - np.log(clean / (none.sum() + 2 * smoothing))
    ratio[(toxic + clean < 2 * smoothing + RARE) | (np.abs(ratio) <= 0.1)] = 0.0  # too rare or too even to tell
    weight = 0.5 * one / max(1.0, one.sum()) + 0.5 * none / max(1.0, none.sum())
    w, b = np.zeros(N_FEATURES), 0.0
    m, v = np.zeros(N_FEATURES + 1), np.zeros(N_FEATURES + 1)
    for t in range(1, steps + 1):
        margin = b + sample.totals(w * ratio)
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y)
        g = np.append(sample.spread(error) * ratio + ridge * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w, b = w - step[:-1] * 0.1, b - step[-1]
    return NbLinear(w * ratio, float(b))


def _line(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve over margins (Newton's steps, slightly held back)."""
    x, beta = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (p - y) + 0.1 * (beta - [1.0, 0.0])
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(h, g), -1, 1)
    return float(max(beta[0], 1e-3)), float(beta[1])


def fit(sample: Sample, y: np.ndarray, smoothing: float = 1.0, ridge: float = 0.03, steps: int = 40,
        rate: float = 0.1, folds: int = 2) -> NbLinear:
    """The classifier on all texts, its margins calibrated on those that models of the other folds give."""
    if not len(y):
        return NbLinear()
    mean = (y.sum() + 0.5) / (len(y) + 1)
    if y.min() == y.max():
        return NbLinear(intercept=float(np.log(mean / (1 - mean))))
    sample = sample.without_rare(RARE)
    how = (smoothing, ridge, steps, rate)
    model = _learn(sample, y, np.ones(len(y)), *how)
    if min(y.sum(), (1 - y).sum()) < 2 * folds:
        return model
    rank = np.empty(len(y), dtype=int)  # each class is dealt evenly
    for k in (0, 1):
        rank[y == k] = np.arange((y == k).sum())
    unseen = np.empty(len(y))
    for k in range(folds):
        out = rank % folds == k
        part = _learn(sample, y, (~out).astype(float), *how)
        unseen[out] = part.intercept + sample.totals(part.table)[out]
    slope, shift = _line(unseen, y)
    return NbLinear(model.table * slope, model.intercept * slope + shift)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT,
          per_class: int = PER_CLASS, seed: int = 4) -> NbLinear:
    """Fit on at most ``per_class`` labelled documents of either class outside the held-out fold."""
    @F.arrow_udf("array<int>")
    def place_row(texts: pa.Array) -> pa.Array:
        scratch = np.zeros(N_FEATURES, dtype=bool)
        return pa.array([places(t.as_py(), scratch).astype(np.int32) for t in texts], pa.list_(pa.int32()))

    usable = labelled(labels, label, folds, held_out)
    chosen = first_by_hash(usable.where("y = 1"), per_class, seed).union(first_by_hash(usable.where("y = 0"), per_class, seed))
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .select("doc_id", "y", place_row("text").alias("x"))
            .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "x").limit(2 * per_class).toArrow())
    x = rows.column("x").combine_chunks()
    lengths = x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return fit(Sample(x.flatten().to_numpy(), lengths), rows.column("y").to_numpy().astype(float))


def score(docs: DataFrame, model: NbLinear) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: toxic likelier) and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(t.as_py() for t in texts), pa.float64())

    out = docs.withColumn("score", scored("text"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    held = F.coalesce(crc_fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
