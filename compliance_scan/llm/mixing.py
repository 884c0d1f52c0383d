"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets are a water-filling: every source gets its weight's share of the
total, but no more than ``cap`` times its words; the excess is shared again by
weight.  A hash of id and text puts each source's documents in a random order,
cut into blocks of about ``block_docs`` documents.  A source is read through
that order once per epoch until its target is met; the last epoch ends inside
one document, of which only the leading words are taken.

The blocks drawn (a block drawn in two epochs counts twice) are dealt to
output shards by a binary tree: at each node the shards' block quotas are
split by one multivariate-hypergeometric draw, so every shard has its even
number of blocks and a random share of every source, and the shards' draws are
disjoint runs of each source's permuted blocks.  A second hash orders the rows
inside a shard (``write_shards``).

Plan: one pass reduces the documents to (source, hash, words), which is
checkpointed; block sizes and their running sums (in two levels, so that a
hot source is no single large window) come from that.  One row per source
goes to the driver and returns as a local table, which Spark broadcasts or
shuffles by its known size.  The documents themselves are only mapped: the hash
of a document and its source's row decide everything, and no text is shuffled.

Defined results: a null text has no words; documents without words take
nothing; a null source is a source, ordered last; rows equal in source, id and
text share the cut evenly; an empty table gives an empty mixture; reruns agree.
Input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import apart, back, cut, read

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)  # repeating, over the sources in code-point order
TOTAL, CAP = 1.5, 2
N_SHARDS = 16
BLOCK_DOCS = 64
SEED = 7
MOST_BLOCKS = 10**8  # numpy's hypergeometric draws end at 10**9
_SUPER = 4096
BROADCAST_SOURCES = 1 << 16  # plans of so many sources (some 300 bytes each) are broadcast, and no text is shuffled for them


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _place(seed: int) -> Column:
    """Where a document stands in its source's random order."""
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def _block(place: Column, blocks: Column) -> Column:
    """The block of a place: blocks are equal ranges of the hash."""
    part = place.cast("double") / F.lit(2.0**64) + 0.5
    return F.least(F.floor(part * blocks), blocks - 1).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """``sizes`` (source, source_size, ...; one row per source) with each source's ``target``.

    With the sources in order of cap over weight, let share k be what the
    total leaves per unit of weight once the first k sources are at their
    cap.  The shares rise until the next source stays below its cap and fall
    from there, so the largest one is the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = F.array(*[F.lit(float(w)) for w in weights])
    w = sizes.withColumn("_w", F.element_at(every, (F.row_number().over(order) - 1) % len(weights) + 1))
    w = w.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    ranked = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    onward = ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = ((F.sum("source_size").over(everything) * F.lit(float(total)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
             / F.sum("_w").over(onward))
    level = F.max("_share").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (w.withColumn("_share", share).withColumn("_level", level)
            .withColumn("target", F.least("_cap", F.col("_level") * F.col("_w")))
            .drop("_w", "_cap", "_share", "_level"))


def split_tree(quotas: Sequence[int], n_shards: int, seed: int) -> np.ndarray:
    """``[source, shard]`` block numbers: rows sum to the quotas, columns to an even share of all blocks."""
    quotas = np.asarray(quotas, dtype=np.int64)
    out = np.zeros((len(quotas), n_shards), dtype=np.int64)
    even = np.diff([int(quotas.sum()) * k // n_shards for k in range(n_shards + 1)])

    def descend(counts: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[:, first] = counts
            return
        middle = (first + last) // 2
        draw = np.random.default_rng([seed, first, last])
        left = draw.multivariate_hypergeometric(counts, int(even[first:middle].sum()), method="marginals")
        descend(left, first, middle)
        descend(counts - left, middle, last)

    if len(quotas):
        descend(quotas, 0, n_shards)
    return out


@dataclass
class _Source:
    source: str | None
    source_size: int
    target: float
    blocks: int
    whole: int  # complete epochs
    rest: int  # words of the last epoch


PLAN = ("source string, source_size long, target double, _blocks long, _whole long, _rest long, _cut long, "
        "_ties long, _left long, _ends array<long>")


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, cap: float = CAP,
         n_shards: int = N_SHARDS, block_docs: int = BLOCK_DOCS, seed: int = SEED) -> DataFrame:
    """One row per source: its target, where its last epoch ends, and the ends of the shards' runs of blocks."""
    spark = docs.sparkSession
    slim = cut(docs.select("source", _place(seed).alias("place"), word_count("text").alias("size")))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources, rows = [], targets(sizes, weights, total, cap).collect()
    per_block = max(block_docs, sum(r.n for r in rows) * cap // MOST_BLOCKS)
    for r in rows:
        words = min(round(r.target), int(cap * r.source_size))
        whole, rest = divmod(words, r.source_size) if r.source_size else (0, 0)
        sources.append(_Source(r.source, r.source_size, r.target, -(-r.n // per_block), whole, rest))
    known = spark.createDataFrame([(s.source, s.blocks, s.rest) for s in sources], "_s string, blocks long, rest long")

    at = slim.join(known, slim.source.eqNullSafe(known._s)).withColumn("block", _block(F.col("place"), F.col("blocks")))
    per = at.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    per = per.withColumn("over", F.floor(F.col("block") / _SUPER))
    ahead = Window.partitionBy("source").orderBy("over").rowsBetween(Window.unboundedPreceding, -1)
    over = (per.groupBy("source", "over").agg(F.sum("words").alias("words"))
            .select(F.col("source").alias("_s"), F.col("over").alias("_o"), F.sum("words").over(ahead).alias("ahead")))
    inside = Window.partitionBy("source", "over").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    runs = (per.join(over, per.source.eqNullSafe(over._s) & (per.over == over._o))
            .withColumn("ahead", F.coalesce("ahead", zero) + F.coalesce(F.sum("words").over(inside), zero)))
    ends = runs.where((F.col("ahead") <= F.col("rest")) & (F.col("rest") < F.col("ahead") + F.col("words"))).select(
        "source", "block", "ahead").collect()

    last = {e.source: e for e in ends}
    cuts = {}
    if ends:
        edge = spark.createDataFrame([(s.source, s.blocks, last[s.source].block, s.rest - last[s.source].ahead)
                                      for s in sources if s.source in last],
                                     "_s string, blocks long, block long, left long")
        near = (slim.join(edge, slim.source.eqNullSafe(edge._s))
                .where(_block(F.col("place"), F.col("blocks")) == F.col("block"))
                .groupBy("source", "place").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"),
                                                F.first("left").alias("left")))
        earlier = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        near = near.withColumn("left", F.col("left") - F.coalesce(F.sum("words").over(earlier), zero))
        cuts = {r.source: r for r in near.where("0 <= left AND left < words").collect()}

    quotas = [s.whole * s.blocks + (last[s.source].block + 1 if s.source in last else 0) for s in sources]
    shares = np.cumsum(split_tree(quotas, n_shards, seed), axis=1)
    out = []
    for s, share in zip(sources, shares):
        c = cuts.get(s.source)
        out.append((s.source, s.source_size, float(s.target), s.blocks, s.whole, s.rest, c.place if c else None,
                    c.n if c else 1, c.left if c else 0, share.tolist()))
    made = spark.createDataFrame(out, PLAN)
    return F.broadcast(made) if len(out) <= BROADCAST_SOURCES else made


DEALT = ("size", "source_size", "target", "draws", "taken")
DRAW = "struct<epoch:int,words:bigint,shard:int>"


def deal(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``draws`` (epoch, words, shard) and ``taken``."""
    of = plan(docs, seed=seed, **options).withColumnRenamed("source", "_s")
    docs, names = apart(docs, DEALT, size=word_count("text"), _place=_place(seed), _source=F.col("source"))
    x = docs.join(of, docs._source.eqNullSafe(of._s), "left")
    x = x.withColumn("_block", _block(F.col("_place"), F.col("_blocks")))
    # A source whose last epoch has a cut takes what stands before it; without words to share there is none.
    rest = (F.when(F.col("_place") < F.col("_cut"), F.col("size"))
            .when(F.col("_place") == F.col("_cut"), F.least(F.col("size"), F.floor(F.col("_left") / F.col("_ties"))))
            .otherwise(F.lit(0)).cast("long"))
    drawn = (F.col("_place") < F.col("_cut")) | (rest > 0)

    def draw(epoch: Column, words: Column) -> Column:
        shard = F.size(F.filter("_ends", lambda end: end <= epoch * F.col("_blocks") + F.col("_block")))
        return F.struct(epoch.cast("int").alias("epoch"), words.alias("words"), shard.alias("shard"))

    # whole >= 1 makes sequence(0, whole - 1) valid; the condition keeps it from running otherwise
    none = F.array().cast(f"array<{DRAW}>")
    wholes = F.when(F.col("_whole") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("_whole"), F.lit(1)) - 1),
                                                     lambda e: draw(e, F.col("size")))).otherwise(none)
    part = F.when(drawn, F.array(draw(F.col("_whole"), rest))).otherwise(none)
    x = x.withColumn("draws", F.concat(wholes, part))
    x = x.withColumn("taken", F.col("_whole") * F.col("size") + rest)
    return x.select(*back(names), *DEALT)


def mix(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The mixture itself: one row per draw, with ``mix_shard`` and ``mix_order``.

    A draw of fewer words than the text has keeps the leading ones, joined by
    single blanks.
    """
    used = {c: F.col(c) for c in ("doc_id", "text", "source")}
    docs, names = apart(docs, ("mix_shard", "mix_order"), **used)
    x = deal(docs, seed=seed, **options).withColumn("_draw", F.explode("draws"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    short = F.col("_draw.words") < F.col("size")
    text = F.when(short, F.array_join(F.slice(words, 1, F.col("_draw.words").cast("int")), " ")).otherwise(F.col("text"))
    order = F.xxhash64(F.lit(seed + 1), "doc_id", "text", "_draw.epoch")

    def given(name: str, own: str) -> Column:
        if own.lower() == "text":
            return text
        return F.when(short, F.length(text).cast("long")).otherwise(F.col(name)) if own.lower() == "n_chars" else F.col(name)

    return x.select(*[given(n, c).alias(c) for n, c in names.items()], F.col("_draw.shard").alias("mix_shard"), order.alias("mix_order"))


def write_shards(mixed: DataFrame, path: str) -> None:
    """One folder per shard, its rows in their shuffled order; large shards are cut into several ordered files."""
    (mixed.repartitionByRange("mix_shard", "mix_order").sortWithinPartitions("mix_shard", "mix_order")
     .write.partitionBy("mix_shard").parquet(path))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return deal(docs).select("doc_id", "size", "source", "source_size", "target", "taken",
                             F.to_json("draws").alias("draws"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's rows, a document once per draw, with the columns of ``docs``: shard by shard, each in its shuffled order."""
    dealt = mix(docs).repartitionByRange("mix_shard", "mix_order").sortWithinPartitions("mix_shard", "mix_order")
    return dealt.select(*docs.columns)
