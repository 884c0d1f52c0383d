"""The manifest against a plain tree, leaf by leaf."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from compliance_scan.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, place string, Leaf string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(r, text):
    said = [r[0], r[3], r[2], r[4], text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in said])


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def _path(levels, i):
    path = []
    for level in levels[:-1]:
        run = i - i % 3
        path.append((level[run:i], level[i + 1:run + 3]))
        i //= 3
    return path


def plain(rows):
    trees = {}
    for r in rows:
        cut = r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        seen = r[1].replace("\n", "") if cut else r[1]
        trees.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, _leaf(r, r[1]), _leaf(r, seen)))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        trees[s].sort()
        built[s] = _levels([x[2] for x in trees[s]])
    top = _levels([built[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for i, (there, doc_id, digest, seen) in enumerate(trees[s]):
            path = _path(built[s], i) + _path(top, at)
            node = seen
            for before, after in path:
                node = H(*before, node, *after)
            out.append((doc_id if there else None, digest, built[s][-1][0], top[-1][0],
                        H(*[x for before, after in path for x in (*before, *after)]), node, node == top[-1][0]))
    return sorted(out, key=str)


def found(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, DOCS).repartition(parts)
    made = merkle.manifest(docs, tamper=merkle.tampering)
    made = made.withColumn("proof", merkle.proof_digest(made.path))
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded_root, r.verified) for r in made.collect()], key=str)


def _row(i, text, source, lang="en"):
    return (i, text, lang, source, None if text is None else len(text), "a", "b", "c")


AWKWARD = ([_row(i, t, s) for i, (t, s) in enumerate([(None, None), ("", None), ("a\nb", "é"), ("a\nb", "é"), ("\n", "z"),
                                                     ("x" * 200_000 + "\n", "z"), ("東京\n", "Z"), ("t", ""), ("t", "")])]
           + [_row(2, "a\nb", "é"), _row(2, "other", "é"), _row(None, "n\n", "z"), _row(None, None, None, None)])


@pytest.mark.parametrize("rows", [
    AWKWARD,
    [_row(7, "one\n", "s")],
    [_row(7, "one\n", None), _row(7, "one\n", None)],
    [_row(i, f"line {i}\nx", "hot") for i in range(83)] + [_row(1000 + i, "y\n", f"s{i}") for i in range(30)],
    [_row(i, "same", "one") for i in range(27)] + [_row(i, "same", "two") for i in range(28)] + [_row(5, "q", "3")] * 4,
    [_row(i, f"{i}\n", "deep") for i in range(800)],
], ids=["awkward", "single", "pair", "hot", "edges", "deep"])
def test_manifest_is_the_plain_tree(spark, rows):
    assert found(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_depth_and_stored_tiers(spark):
    counts = [1, 2, 3, 4, 9, 10, 27, 28, 3 ** 20, 3 ** 20 + 1]

    made = spark.createDataFrame([(c,) for c in counts], "n long").select("n", merkle.depth(F.col("n")).alias("d"))
    assert {r.n: r.d for r in made.collect()} == dict(zip(counts, [0, 1, 1, 2, 2, 3, 3, 4, 20, 21]))
    nodes = spark.createDataFrame([("t", 5, i, H(str(i))) for i in range(100)], "tree string, depth int, place long, digest string")
    tiers, roots = merkle.build(nodes, 5)
    assert [t.count() for t in tiers] == [4, 1]  # 100 leaves in subtrees of 27, then their four tops
    assert roots.first().root == _levels([H(str(i)) for i in range(100)])[-1][0]
