"""LM scoring: disk that the tables take, and scores of texts that were not counted."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from compliance_scan.llm import lm_score


def test_tables_of_lm_score_take_few_bytes_a_token(spark, tmp_path):
    """Bigrams that hardly repeat, as in a real corpus: the tables kept hold no row for each of them."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(rng.paretovariate(0.5))}" for _ in range(500))) for i in range(200)], "doc_id long, text string")
    good = docs.where("doc_id < 50").select("doc_id")
    sc = spark.sparkContext
    before = lm_score.shared_folder(spark)
    sc.setCheckpointDir(f"file://{tmp_path}")
    try:
        rows = lm_score.score(docs, lm_score.train(docs, good)).collect()
    finally:
        sc.setCheckpointDir(before)
    assert sum(r.n_tokens for r in rows) == 100_000
    held = sum(p.stat().st_size for p in tmp_path.rglob("*") if p.is_file())
    assert 0 < held < 100_000 * 15


def test_packed_arrays_come_back(spark):
    import pyarrow as pa
    for x in ([], [0], [-1, 1 << 62, -(1 << 63), 7], range(1000)):
        x = np.array(x, dtype=np.int64)
        assert lm_score.unpacked(pa.scalar(lm_score.packed(x), pa.binary())).tolist() == x.tolist()


def test_texts_that_were_not_counted(spark, monkeypatch):
    """Bigrams and words without a count keep their place in the mean; they do not change the models."""
    monkeypatch.setattr(lm_score, "_TOKENS", 8)
    counted = spark.createDataFrame([(1, "a b a c a b"), (2, "b a c d"), (3, "c c a")], "doc_id long, text string")
    other = spark.createDataFrame([(7, "a d new a b"), (8, "new new"), (9, None)], "doc_id long, text string")
    model = lm_score.train(counted, counted.where("doc_id = 1").select("doc_id"))
    got = {r.doc_id: r for r in lm_score.score(other, model).collect()}
    for name, texts in (("target_loss", ["a b a c a b"]), ("background_loss", ["a b a c a b", "b a c d", "c c a"])):
        n = Counter(p for t in texts for p in zip(["", *t.split()], t.split()))
        once, seen = Counter(), Counter()
        for (a, b), k in n.items():
            once[b] += k
            seen[a] += k
        kinds = Counter(a for a, _ in n)
        for i, text in ((7, "a d new a b"), (8, "new new")):
            words, losses = text.split(), []
            for a, b in zip(["", *words], words):
                k = kinds[a] or 1
                losses.append(-np.log((n[a, b] + k * (once[b] + 1) / (sum(once.values()) + 4)) / (seen[a] + k)))
            assert got[i][name] == pytest.approx(np.mean(losses), rel=1e-9) and got[i].n_tokens == len(words)
    assert got[9].n_tokens == 0 and got[9].difference == 0
