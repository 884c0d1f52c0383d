"""Sharding: minimax contiguous partition of ordered atomic groups, in DataFrame operations only.

Rows of equal texts (null texts too) are an atomic group and never part; a
group is named by a 63-bit hash of its text.  The order of the groups is fixed:
first those larger than a cell's even share, then all others by hash.  The
smallest capacity for which a greedy pass over *all groups* needs no more than
``n_shards`` shards is found in SQL higher-order functions over a single row
that holds an array of cells.

A cell is a run of groups: at first a large group, or one of ``n_groups`` equal
ranges of the hash.  Bounds of the capacity over these cells bound where each
cut of the best greedy pass can stand; only the cells there are divided further,
until each is a single group or few enough groups are left to stand alone.  The
search over what is then known gives the groups' own smallest capacity, and the
array stays small whatever the number of groups.

Slots are gapless because the rows of a shard are counted by range of the hash
and, where a range or a group has many rows, by a hash of the id too; rows are
numbered inside such a part only, so no window holds a shard or a hot group
(rows equal in id and text stay in one part).

Plan: one aggregation to a row per text (three longs, checkpointed), some
aggregations of that table to cells, one of the rows to parts, broadcasts of
tables whose sizes are fixed by ``n_groups``, and one exchange of the rows.

Defined results: a null text has no bytes, hence size 1, and a null checksum;
empty texts have size 1; repeated rows are rows like any other; a group larger
than an even share makes its shard that much larger; an empty table gives an
empty result.  Input columns named like an output column are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import apart, back, cut, read

N_SHARDS = 16
N_GROUPS = 1 << 14  # cells of the first search; a power of two
PART_ROWS = 1024  # a part of this many rows is not divided for its slots
LAW = "bytes"


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def atomic_group(text: Column) -> Column:
    """The atomic group of a row: 63 bits that depend on its text alone."""
    return F.shiftrightunsigned(F.xxhash64(text), 1)


def _greedy(sizes: Column, capacity: Column) -> Column:
    """Fill shards in order; returns the first groups of all shards but the first.

    The capacity rides in the accumulator, so it is computed once and not
    again for every group.
    """
    def state(capacity, fill, starts):
        return F.struct(capacity.alias("capacity"), fill.cast("long").alias("fill"), starts.alias("starts"))

    def put(a: Column, x: Column) -> Column:
        filled = a["fill"] + x["size"]
        return (F.when(filled <= a["capacity"], state(a["capacity"], filled, a["starts"]))
                .otherwise(state(a["capacity"], x["size"], F.array_append(a["starts"], x["g"]))))

    return F.aggregate(sizes, state(capacity, F.lit(0), F.array().cast("array<long>")), put)["starts"]


def minimax_cuts(groups: DataFrame, n_shards: int) -> DataFrame:
    """One row: ``capacity`` and ``starts``, the first group of every shard but the first.

    ``groups`` has one row per atomic group: ``g`` (its order) and ``size``.
    The search runs between the larger of the largest group and an even
    share, below which nothing is feasible, and that share plus the largest
    group, at which a greedy pass always is.
    """
    one = groups.agg(F.sort_array(F.collect_list(F.struct("g", "size"))).alias("sizes"),
                     F.sum("size").alias("total"), F.max("size").alias("most"))
    share = F.ceil(F.col("total") / n_shards)
    one = one.select("sizes", F.struct(F.greatest(F.col("most"), share).cast("long").alias("lo"),
                                       (share + F.col("most")).cast("long").alias("hi")).alias("range"))

    def halve(r: Column, _: Column) -> Column:
        middle = F.floor((r["lo"] + r["hi"]) / 2).cast("long")
        fits = F.size(_greedy(F.col("sizes"), middle)) < n_shards
        low = F.struct(r["lo"].alias("lo"), middle.alias("hi"))
        high = F.struct((middle + 1).alias("lo"), r["hi"].alias("hi"))
        return F.when(r["lo"] >= r["hi"], r).when(fits, low).otherwise(high)

    found = one.select("sizes", F.aggregate(F.sequence(F.lit(1), F.lit(62)), F.col("range"), halve)["lo"].alias("capacity"))
    return found.select("capacity", _greedy(F.col("sizes"), F.col("capacity")).alias("starts"))


def _ends(cells: list, capacity: int, n_shards: int, low: bool) -> list[int]:
    """Bounds of the first cuts of a greedy pass over the groups, counted in sizes.

    What the pass reaches lies between these bounds: the lower ones stop before a cell that does
    not fit, the upper ones cut cells of several groups anywhere.
    """
    ends = np.cumsum([c.size for c in cells])
    out, at = [], 0
    for _ in range(n_shards):
        reach = at + capacity
        i = int(np.searchsorted(ends, reach, side="right"))  # the cell that does not fit
        at = int(ends[-1]) if i == len(cells) else int(ends[i]) - cells[i].size if low or cells[i].groups == 1 else reach
        out.append(at)
    return out


def _least(cells: list, n_shards: int, low: bool, bottom: int, top: int) -> int:
    total = sum(c.size for c in cells)
    while bottom < top:
        middle = (bottom + top) // 2
        if _ends(cells, middle, n_shards, low)[-1] >= total:
            top = middle
        else:
            bottom = middle + 1
    return bottom


def atomic_cuts(groups: DataFrame, n_shards: int, n_groups: int = N_GROUPS) -> tuple[int, list[int]]:
    """The smallest capacity over all ``groups`` (``g``, their order, and ``size``), and the first ``g`` of every shard but the first.

    Groups with a negative ``g`` are large: at most ``n_groups`` of them, each a cell.
    """
    shift = 64 - n_groups.bit_length()
    key = F.when(F.col("g") < 0, F.col("g")).otherwise(F.shiftleft(F.shiftright("g", shift), shift))
    while True:
        made = groups.groupBy(key.alias("g")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("groups"),
                                                  F.max("size").alias("most"))
        cells = sorted(made.collect(), key=lambda c: c.g)
        if not cells:
            return 0, []
        total, most = sum(c.size for c in cells), max(c.most for c in cells)
        bottom = _least(cells, n_shards, False, max(most, -(-total // n_shards)), total)
        top = _least(cells, n_shards, True, bottom, total)
        ends, spans = np.cumsum([c.size for c in cells]), []
        for low, high in zip(_ends(cells, bottom, n_shards, True)[:-1], _ends(cells, top, n_shards, False)[:-1]):
            first, last = np.searchsorted(ends, [low, min(high, total - 1)], side="right")
            spans.append((int(first), int(last)))
        open_ = sorted({i for a, b in spans for i in range(a, b + 1) if i < len(cells) and cells[i].groups > 1})
        if not open_ or shift == 0:
            break
        few = sum(cells[i].groups for i in open_) <= n_groups
        shift = 0 if few else max(0, shift - max(1, (n_groups // len(open_)).bit_length() - 1))
        runs: list[list[int]] = []  # neighbouring open cells, by their own first and the next cell's first g
        for i in open_:
            end = cells[i + 1].g if i + 1 < len(cells) else None
            if runs and runs[-1][1] == cells[i].g:
                runs[-1][1] = end
            else:
                runs.append([cells[i].g, end])
        inside = F.lit(False)
        for a, b in runs:
            inside = inside | ((F.col("g") >= a) & (F.lit(True) if b is None else F.col("g") < b))
        key = F.when((F.col("g") >= 0) & inside, F.shiftleft(F.shiftright("g", shift), shift)).otherwise(key)
    found = minimax_cuts(made.select("g", "size"), n_shards).first()
    return found.capacity, list(found.starts)


def shard(docs: DataFrame, n_shards: int = N_SHARDS, n_groups: int = N_GROUPS, size: Column | None = None) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``shard`` and ``slot``.

    Size and checksum are taken before the exchange, so it carries the text
    only if the caller selects it.
    """
    text = F.col("text")
    sized, names = apart(docs, ("size", "text_crc32", "shard", "slot"), size=text_size(text) if size is None else size,
                         text_crc32=F.crc32(text), _group=atomic_group(text), _id=F.col("doc_id"))
    groups = cut(sized.groupBy("_group").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    every = groups.agg(F.sum("size").alias("size"), F.sum("n").alias("n")).first()
    large = F.col("size") * n_groups > (every.size or 0)  # fewer than n_groups
    groups = groups.withColumn("g", F.when(large, F.col("_group") + F.lit(-(1 << 63))).otherwise(F.col("_group")))
    _, starts = atomic_cuts(groups.select("g", "size"), n_shards, n_groups)

    def placed(g: Column) -> Column:
        shard = F.lit(0)
        for k, start in enumerate(starts):
            shard = F.when(g >= start, k + 1).otherwise(shard)
        return shard

    # A part is a large group or a range of the hash, divided by a hash of the id where it has many rows.
    run = F.when(F.col("g") < 0, F.col("g")).otherwise(F.shiftright("g", 64 - n_groups.bit_length()))
    rows = F.lit(max(PART_ROWS, 4 * (every.n or 0) // n_groups))
    runs = groups.groupBy(run.alias("_run")).agg(F.ceil(F.sum("n") / rows).cast("long").alias("_parts"))
    own = groups.where("g < 0").select("_group", F.col("g").alias("_g"))
    at = sized.join(F.broadcast(own), "_group", "left").withColumn("g", F.coalesce("_g", "_group")).drop("_g")
    at = at.withColumns({"_run": run, "shard": placed(F.col("g"))}).join(F.broadcast(runs), "_run")
    at = at.withColumn("_part", F.pmod(F.xxhash64("_id"), F.col("_parts")))
    part = ["shard", "_run", "_part"]
    before = Window.partitionBy("shard").orderBy("_run", "_part").rowsBetween(Window.unboundedPreceding, -1)
    first = (at.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
             .select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")))
    within = Window.partitionBy(*part).orderBy("_group", F.col("_id").asc_nulls_last(), "size", "text_crc32")
    return (at.withColumn("_row", F.row_number().over(within)).join(F.broadcast(first), part)
            .withColumn("slot", F.col("_first") + F.col("_row") - 1)
            .select(*back(names), "size", "text_crc32", "shard", "slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(shard(read(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")


def digest(sharded: DataFrame, *columns: str) -> DataFrame:
    return sharded.select(*columns, "size", "text_crc32", F.lit(LAW).alias("law"),
                          "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their columns, and the columns of the sharding query."""
    made = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    return digest(shard(docs), *[c for c in docs.columns if c.lower() not in made])
