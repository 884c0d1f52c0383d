"""Ranked search against scoring every document, and the parts of the index by themselves."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from compliance_scan.llm import ranked_search as rs
from compliance_scan.llm.words import words_of


def plain(docs, items, k=10):
    held = [(i, Counter(words_of(t))) for i, t in docs if words_of(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        wanted = Counter(words_of(text))
        scored = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                        for t, r in wanted.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, tmp_path, docs, items, k=10, parts=4, query_bytes=rs.QUERY_BYTES, **build):
    table = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in docs], "doc_id long, text string, segment string, term string, docs string")
    queries = spark.createDataFrame([(i, t, 1, "s") for i, t in items], "item_id long, text string, item int, score string")
    index = rs.build(table.repartition(parts), str(tmp_path / f"index{random.random()}"), **build)
    made = rs.search(index, queries, k=k, query_bytes=query_bytes)
    assert made.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in made.collect()], key=str)


def _corpus(rng, n):
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 30, 200])))) for i in range(n)]


@pytest.mark.parametrize("build", [{}, {"segment_docs": 700}, {"segment_bytes": 2000}])
def test_search_scores_like_every_document(spark, tmp_path, build):
    rng = random.Random(1)
    docs = _corpus(rng, 3000)
    items = [(i, " ".join(rng.choices([f"w{i}" for i in range(420)], k=rng.choice([1, 3, 12, 40])))) for i in range(40)]
    want = plain(docs, items)
    assert found(spark, tmp_path, docs, items, **build) == want
    if "segment_docs" in build:
        assert found(spark, tmp_path, docs, items, query_bytes=300, **build) == want
        assert found(spark, tmp_path, docs, items, k=3, parts=1, **build) == plain(docs, items, 3)


def test_ties_nulls_repeats_and_awkward_texts(spark, tmp_path):
    docs = [(i, "same words here") for i in range(30)] + [(None, "same words here"), (3, "same words here"), (40, None),
            (41, ""), (42, "!!! ---"), (43, "ÑANDÚ ñandú Ñ 東京"), (44, "same " * 50_000), (-5, "same words here"), (45, "A1b2 a1B2 x_y")]
    items = [(1, "Same"), (1, "Same"), (2, None), (3, ""), (4, "--"), (5, "nowhere"), (None, "東京 ñandú"), (6, "words words same"),
             (7, "a1b2"), (8, "x y")]
    assert found(spark, tmp_path, docs, items) == plain(docs, items)
    assert found(spark, tmp_path, docs, items, k=100) == plain(docs, items, 100)


def test_one_term_in_every_document_and_empty_tables(spark, tmp_path):
    docs = [(i, "all " * (1 + i % 3)) for i in range(300)]
    assert found(spark, tmp_path, docs, [(1, "all all")]) == plain(docs, [(1, "all all")])
    assert found(spark, tmp_path, [], [(1, "all")]) == []
    assert found(spark, tmp_path, docs, []) == []


def test_packed_lists_unpack():
    rng = np.random.default_rng(2)
    for n in (1, 2, 127, 128, 129, 1000):
        docs = np.sort(rng.choice(10 ** 6 * n, n, replace=False))
        tfs, sizes = rng.integers(1, rng.choice([3, 300, 70000]), n), rng.integers(1, 1000, n)
        postings = rs.Postings(rs.pack(docs, tfs, sizes))
        blocks = [postings.block(b) for b in range(len(postings.last))]
        assert np.concatenate([d for d, _ in blocks]).tolist() == docs.tolist()
        assert np.concatenate([f for _, f in blocks]).tolist() == tfs.tolist()
        assert postings.least.min() == sizes.min() and postings.most.max() == tfs.max()


def test_maxima_reject_blocks_before_they_are_unpacked():
    """A frequent word whose blocks cannot lift any candidate over the threshold stays packed."""
    n = 20_000
    sizes = np.full(n, 10)
    head = sizes.astype("<i8")
    data = b"".join([np.arange(n, dtype="<i8").tobytes(), head.tobytes(), np.zeros(n, "u1").tobytes()])
    segment = rs.Segment(data, n, n, 10 * n)
    rare, common = np.arange(0, n, 1000), np.arange(n)
    tfs = np.where(rare < 5000, 9, 1)
    segment.add(b"rare", rs.pack(rare, tfs, sizes[rare]))
    segment.add(b"common", rs.pack(common, np.where(common < 6000, 3, 1), sizes))
    heap = rs.Heap(3)
    rs.search_segment(segment, [(b"rare", 5000), (b"common", 2)], heap)
    first = heap.scores.tolist(), heap.ids.tolist()
    again = rs.Segment(data, n, n, 10 * n)
    again.add(b"rare", rs.pack(rare, tfs, sizes[rare]))
    again.add(b"common", rs.pack(common, np.where(common < 6000, 3, 1), sizes))
    rs.search_segment(again, [(b"rare", 5000), (b"common", 2)], heap)  # the threshold is known now
    assert (heap.scores[0], heap.ids[:2].tolist()) == (first[0][0], [0, 0])
    assert 0 < len(again.lists[b"common"].known) <= 5 < len(again.lists[b"common"].last)
