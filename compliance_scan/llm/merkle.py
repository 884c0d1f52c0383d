"""Merkle dataset manifest: stored levels are sparse, proofs regenerate the nodes between them.

A row is a leaf: the digest of its encoded fields.  The leaves of a source, in
order of the id, are hashed in runs of ``ARITY`` until one node remains, its
subroot; the subroots of all sources, in order of the source, are hashed alike
to the root.  A digest is sha256 as lowercase hex text, and nodes hash the
texts of their children.

Only every ``STEP`` levels is kept: a *tier* is a table of aligned subtrees of
``ARITY ** STEP`` (27) nodes of one stored level, with the digests of these
nodes and nothing above them.  Building folds each subtree to its top, which is
a node of the next tier.  Proof extraction walks the tiers from the root down:
it computes the missing levels of a subtree from its stored nodes, appends to
the path of the subtree the siblings of each stored node, hands these paths to
the tier below, and drops what it computed.

Plan: leaves are hashed in the scan, so texts never move.  The narrow leaves
(ids and digests) are checkpointed, range-partitioned and sorted by (source,
id, digest); a leaf's place in its source is its place in its partition plus
the counts of earlier partitions, a table of one row per partition and source.
A subtree is a group of at most 27 rows, so a hot source is spread over as
many groups as it needs.  Each tier is written once to the shared folder and
read by the build and by the extraction; a tier has a 27th of the rows below
it, so the whole forest is little more than its leaves.  The driver gets one
number a forest, the size of its largest tree.

Defined results: a null field is ``-``; a null id stands before all others and
is never tampered with; rows of equal source and id stand by the digest of the
leaf; repeated rows are leaves of their own, each with its own proof; a source
of one row has its leaf as subroot, and one source alone has its subroot as
root; a null source is a source of its own, before all others; an empty table
gives an empty result.  ``manifest`` keeps no column of its input but the id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, read

ARITY = 3
STEP = 3  # levels of a stored subtree
WIDTH = ARITY ** STEP

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# The siblings at one level: the texts of those before the node and of those after it.
SIBLINGS = "struct<before:string,after:string>"


def digest(*texts: Column) -> Column:
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return digest(*[encoded(c) for c in fields])


def depth(count: Column) -> Column:
    """Levels above ``count`` nodes until one remains."""
    powers = F.array(*[F.lit(ARITY ** i).cast("long") for i in range(40)])
    return F.size(F.filter(powers, lambda p: p < count))


def _ordinals(nodes: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``nodes`` with ``place`` (from 0) and ``count`` in their tree, by ``order``, and the largest count."""
    ranged = cut(nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order))
    part = F.spark_partition_id()
    local = F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)
    tagged = ranged.withColumns({"part": part, "local": local})
    blocks = cut(tagged.groupBy("part", "tree").agg(F.count(F.lit(1)).alias("n"), F.min("local").alias("first")))
    of_tree = Window.partitionBy("tree")
    starts = blocks.select("part", "tree", "first", F.sum("n").over(of_tree).alias("count"), F.coalesce(F.sum("n").over(
        of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    most = blocks.groupBy("tree").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    placed = (tagged.join(starts, ["part", "tree"])
              .withColumn("place", F.col("start") + F.col("local") - F.col("first")).drop("part", "local", "start", "first"))
    return placed, most


def _above(nodes: Column) -> Column:
    """The digests of the runs of ``nodes``."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int")),
                       lambda j: F.slice(nodes, j * ARITY + 1, ARITY))
    return F.transform(runs, lambda run: F.sha2(F.array_join(run, "").cast("binary"), 256))


def _regenerated(tier: DataFrame, base: int) -> DataFrame:
    """``tier`` with the levels above its stored nodes: ``l0`` is stored, ``l1`` to ``l3`` are computed.

    A level stays empty where the tree has ended below it.
    """
    out = tier.withColumn("l0", F.col("members.digest"))
    for k in range(1, STEP + 1):
        inside = F.col("depth") >= base + k
        out = out.withColumn(f"l{k}", F.when(inside, _above(F.col(f"l{k - 1}"))).otherwise(F.array().cast("array<string>")))
    return out


def _tier(nodes: DataFrame) -> DataFrame:
    """Aligned subtrees of ``nodes`` (tree, depth, place, and what a member carries): at most 27 members each."""
    carried = [c for c in nodes.columns if c not in ("tree", "depth")]
    return cut(nodes.groupBy("tree", "depth", F.floor(F.col("place") / WIDTH).alias("subtree"))
               .agg(F.sort_array(F.collect_list(F.struct(*carried))).alias("members")))


def build(nodes: DataFrame, deepest: int) -> tuple[list[DataFrame], DataFrame]:
    """The stored tiers, leaves first, and ``(tree, depth, root)``.

    ``nodes`` holds tree, depth, place, digest and further columns of the
    leaves; ``place`` comes first among what is carried, so members are in order.
    """
    tiers, roots = [], None
    for base in range(0, max(deepest, 1), STEP):
        tiers.append(_tier(nodes))
        made = _regenerated(tiers[-1], base)
        top = F.coalesce(*[F.when(F.size(f"l{k}") > 0, F.get(f"l{k}", F.lit(0))) for k in range(STEP, -1, -1)])
        tops = made.select("tree", "depth", F.col("subtree").alias("place"), top.alias("digest"))
        done = tops.where(F.col("depth") <= base + STEP).select("tree", "depth", F.col("digest").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        nodes = tops.where(F.col("depth") > base + STEP)
    return tiers, roots


def _siblings(index: Column, k: int) -> Column:
    """The siblings, at level ``k`` of a subtree, of the node above (or at) member ``index``."""
    nodes = F.col(f"l{k}")
    at = F.floor(index / ARITY ** k).cast("int")
    start = at - at % ARITY
    run = F.slice(nodes, start + 1, ARITY)
    before = F.slice(run, F.lit(1), at - start)
    after = F.slice(run, at - start + 2, ARITY)
    return F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))


def proofs(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """The members of the first tier, each with ``path``: its siblings level by level, and what ``above`` says of its tree.

    ``above`` (tree, depth, path, and columns of one's own) has one row a tree:
    how the paths go on beyond the tree's root.  It joins the one subtree in
    which a tree ends, and what it says is handed down with the paths.
    """
    told = [c for c in above.columns if c not in ("tree", "depth", "path")]
    ends = F.greatest(F.ceil(F.col("depth") / STEP) - 1, F.lit(0))
    paths = None
    for number in range(len(tiers) - 1, -1, -1):
        base = number * STEP
        starts = above.where(ends == number).select("tree", F.lit(0).cast("long").alias("subtree"), "path", *told)
        paths = starts if paths is None else paths.unionByName(starts)
        made = _regenerated(tiers[number].join(paths, ["tree", "subtree"]), base)
        member = made.select("tree", "depth", *[f"l{k}" for k in range(STEP)], F.col("path").alias("upper"), *told,
                             F.posexplode("members").alias("index", "member"))
        # a level has siblings only where another level stands above it
        levels = F.filter(F.array(*[F.when(F.col("depth") > base + k, _siblings(F.col("index"), k)) for k in range(STEP)]),
                          lambda s: s.isNotNull())
        path = F.concat(levels, "upper").alias("path")
        if number:
            paths = member.select("tree", F.col("member.place").alias("subtree"), path, *told)
    return member.select("tree", "member.*", path, *told)


def folded(node: Column, path: Column) -> Column:
    """The root that ``node`` gives with the siblings of ``path``."""
    return F.aggregate(path, node, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def _forest(leaves: DataFrame, order: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Tiers and roots of the trees of ``leaves`` (tree, digest, and further columns), in ``order``."""
    carried = [c for c in leaves.columns if c != "tree"]
    placed, most = _ordinals(leaves, order)
    nodes = placed.select("tree", depth(F.col("count")).alias("depth"), "place", *carried)
    deepest = next(d for d in range(64) if ARITY ** d >= most)
    return build(nodes, deepest)


def manifest(docs: DataFrame, fields=FIELDS, tamper: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, path, folded_root, verified`` of every row.

    ``fields`` are the id, the source and the further fields of a leaf in the
    order in which they are hashed, the text last.  ``tamper`` (of id and text)
    gives the text that verification sees; without it that is the text itself.
    """
    names = [c.lower() for c in docs.columns]
    keyed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    fields = [F.col(f"c{names.index(f.lower())}") for f in fields]
    ident, text = fields[0], fields[-1]
    seen = [*fields[:-1], text if tamper is None else tamper(ident, text)]
    source = F.coalesce(F.concat(F.lit("s"), fields[1].cast("string")), F.lit(""))  # null before all others
    leaves = cut(keyed.select(source.alias("tree"), ident.alias("doc_id"), leaf(fields).alias("digest"), leaf(seen).alias("seen")))
    tiers, subroots = _forest(leaves, ["doc_id", "digest"])
    subroots = cut(subroots)
    upper, roots = _forest(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"),
                                           F.col("depth").alias("below"), F.col("root").alias("digest")), ["source"])
    top = proofs(upper, roots.withColumn("path", F.array().cast(f"array<{SIBLINGS}>")))
    above = cut(top.select(F.col("source").alias("tree"), F.col("below").alias("depth"), "path",
                           F.col("digest").alias("subroot"), "root"))
    out = proofs(tiers, above).select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path",
                                      folded(F.col("seen"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampering(doc_id: Column, text: Column) -> Column:
    """The text without line feeds where 2 divides the checksum of the id."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = manifest(read(spark, sf_dir, "documents"), tamper=tampering)
    return made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                       "folded_root", "verified")


def _sql_leaf(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values) + ")"


def _sql_levels(name: str, leaves: str) -> str:
    """All nodes of the trees of ``leaves`` by recursion over levels, and each node's siblings."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, place, digest, n FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (max(n) + 2) // 3
  FROM {name} WHERE n > 1 GROUP BY tree, level, place // 3),
{name}_sides AS (
  SELECT a.tree, a.level, a.place,
         coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place < a.place), '') AS before,
         coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place > a.place), '') AS after
  FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.level = b.level AND a.place // 3 = b.place // 3
  WHERE a.n > 1 GROUP BY a.tree, a.level, a.place),
{name}_tops AS (SELECT tree, digest AS top FROM {name} WHERE n = 1)"""


# crc32 bit by bit: each byte is one step with the byte and seven without
_SQL_CRC = """xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''),
  lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
  lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"""

ORACLE = f"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('s' || source, '') AS tree, {_sql_leaf("text")} AS digest,
         CASE WHEN {_SQL_CRC} % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf("text")} END AS seen
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS place,
         count(*) OVER (PARTITION BY tree) AS n FROM rows),
{_sql_levels("low", "leaves")},
subroots AS (
  SELECT '' AS tree, tree AS source, top AS digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n
  FROM low_tops),
{_sql_levels("high", "subroots")},
steps AS (
  SELECT l.id, s.level, s.before, s.after FROM leaves l
  JOIN low_sides s ON s.tree = l.tree AND s.place = l.place // (3 ** s.level)::BIGINT
  UNION ALL
  SELECT l.id, 1000 + s.level, s.before, s.after FROM leaves l JOIN subroots r ON r.source = l.tree
  JOIN high_sides s ON s.place = r.place // (3 ** s.level)::BIGINT),
paths AS (
  SELECT id, string_agg(before || after, '' ORDER BY level) AS proof, list(before || '|' || after ORDER BY level) AS sides
  FROM steps GROUP BY id),
found AS (
  SELECT l.doc_id, l.digest AS leaf, r.digest AS subroot, t.top AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
         CASE WHEN p.sides IS NULL THEN l.seen ELSE
           list_reduce([l.seen] || p.sides, lambda d, s: sha256(split_part(s, '|', 1) || d || split_part(s, '|', 2))) END AS folded_root
  FROM leaves l JOIN subroots r ON r.source = l.tree CROSS JOIN high_tops t LEFT JOIN paths p ON p.id = l.id)
SELECT *, folded_root = root AS verified FROM found
"""
