"""LM scoring by cross-entropy difference.

Two word bigram models with the same vocabulary, order and smoothing score
every document: a target model, counted over the documents that are labelled
as good, and a background model, counted over all documents.  The score is
the mean over the tokens of the target model's loss less the background
model's; the lower, the more a document resembles the target.

The vocabulary is every word of the corpus, each named by its 64-bit hash, and
every observed bigram keeps its own counts; both models are Witten-Bell
interpolated with add-one unigrams.  With ``n_words`` only that many of the most
frequent words are kept apart and all others share ``n_classes`` classes.

Plan: the documents meet the labels in one join, and map tasks write them as
*blocks* of about a million tokens: the block's words by hash, the tokens as
places among them.  What a block counts itself, for its distinct bigrams and
then for its distinct words, meets the other blocks' counts once: every block
sends its sorted 64-bit keys and counts, as packed arrays, to the buckets that
the keys' highest bits name; a bucket sums the counts of equal keys and sends
the sums back in the same order, so that no key travels twice.  The first block
with a bigram counts it among the kinds of its context.  A block then has the
logarithms of all its tokens and sums them per text.  Buckets are as many as
the tokens need, and a key has one place per block, so neither a bucket nor the
share of a common word grows with the corpus.  The tables of blocks and sums are
Parquet files in the shared checkpoint folder and stay there; the driver gets
three sums (with ``n_words``, also that list).

A bigram is one 64-bit hash of its two words' hashes; that any two of n
different bigrams share one has a chance of about n * n / 2**65 (0.03 for 10**9).

Defined results: null and empty texts have no tokens and score 0 in every
column; equal texts have equal scores; without target documents the target
model is uniform; words and bigrams that only scored documents hold have count
0; an empty table gives an empty result.  Input columns named
like an output column are replaced.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, back, read, released, shared_folder
from .words import WordHashes, mixed, words_of

N_CLASSES = 512
START = xxhash.xxh3_64_intdigest(b" ") - (1 << 63)  # before the first word; no word holds a blank
MODELS = ("target", "background")
BLOCK = "block long, words binary, tokens binary, lengths binary, texts binary, good binary, target long, background long, n long"
LOSSES = "_text long, n_tokens long, target_loss double, background_loss double"
WORD_COUNTS = tuple(f"{c}_{m}" for c in ("seen", "kinds", "once") for m in MODELS)
UNCOUNTED = 1 << 62  # first number of blocks that are scored, but not counted
_TOKENS = 1 << 20  # of a block; half of those of a bucket
_FLUSH = 300_000  # distinct words that a task holds


def class_of(word: bytes, n_words: int, n_classes: int) -> int:
    return n_words + xxhash.xxh3_64_intdigest(word) % n_classes


class Vocabulary(dict):
    """word -> number; words beyond the list get their class's number, remembered while there is room."""

    def __init__(self, words: Iterable[bytes], n_classes: int = N_CLASSES, room: int = 1 << 19):
        super().__init__((w, i) for i, w in enumerate(words))
        self.listed, self.n_classes, self.room = len(self), n_classes, room
        self.size = self.listed + n_classes

    def __missing__(self, word: bytes) -> int:
        number = class_of(word, self.listed, self.n_classes)
        if len(self) < self.room:
            self[word] = number
        return number

    def __reduce__(self):
        return Vocabulary, ([w for w, i in self.items() if i < self.listed], self.n_classes, self.room)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def vocabulary(docs: DataFrame, n_words: int, n_classes: int = N_CLASSES) -> Vocabulary:
    """The most frequent words of all documents, ties by the word."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())],
                                             schema=schema)
            held.clear()
            return out

        for batch in batches:
            for t in batch.column(0):
                held.update(words_of(t.as_py()))
                if len(held) >= _FLUSH:
                    yield flushed()
        yield flushed()

    rows = (docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "word").limit(n_words).collect())
    return Vocabulary((bytes(r.word) for r in rows), n_classes)


def numbered(words: Vocabulary | None) -> Callable[[list[bytes]], np.ndarray]:
    """The numbers of words: their hashes, or those of a vocabulary."""
    if words is not None:
        return words.of
    hashes = WordHashes()
    return lambda found: hashes.of(found).view(np.int64)


def kept(table: DataFrame, folder: str, schema: str) -> DataFrame:
    """``table``, computed once and written as a Parquet table; the job's shuffle files are let go of."""
    # Few, but long rows: without these, a writer holds a hundred of them before it looks at their size.
    (table.write.option("parquet.page.size.row.check.min", 1).option("parquet.block.size.row.check.min", 1).parquet(folder))
    done = table.sparkSession.read.schema(schema).parquet(folder)
    done.isEmpty()  # the driver holds on to a job until the next one
    released(table.sparkSession)
    return done


def packed(x: np.ndarray) -> bytes:
    """The length of a 64-bit array and its bytes, compressed: the lowest of all numbers first, then the next ones."""
    return len(x).to_bytes(8, "little") + pa.compress(x.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def unpacked(held: pa.Scalar) -> np.ndarray:
    held = held.as_buffer()
    n = int.from_bytes(held[:8], "little")
    planes = np.frombuffer(pa.decompress(held[8:], 8 * n, "zstd"), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.int64).ravel()


def blocks_of(docs: DataFrame, words: Vocabulary | None, first: int = 0) -> DataFrame:
    """``BLOCK`` rows of ``text, good``; good: 1 for target documents, 0 for others, -1 for those not counted."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    most = _TOKENS
    schema = pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in ("words", "tokens", "lengths", "texts", "good")],
                        *[(c, pa.int64()) for c in (*MODELS, "n")]])

    def block(number: int, held: list[tuple[np.ndarray, int, int]]) -> pa.RecordBatch:
        found, texts, good = zip(*held)
        kinds, place, n = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # small places for common words, which pack well
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        lengths, marks = np.array([len(x) for x in found]), np.array(good)
        row = (number, *map(packed, (np.concatenate([[START], kinds[order]]), rank[place], lengths, np.array(texts), marks)),
               int(lengths[marks == 1].sum()), int(lengths[marks >= 0].sum()), int(lengths.sum()))
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbered(shared.value)
        made = first + (TaskContext.get().partitionId() << 32)
        held: list[tuple[np.ndarray, int, int]] = []
        tokens = 0
        for batch in batches:
            for text, key, good in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                now = number(words_of(text.as_py()))
                if len(now):
                    held.append((now, key, good))
                    tokens += len(now)
                if tokens >= most:
                    yield block(made, held)
                    held, tokens, made = [], 0, made + 1
        if held:
            yield block(made, held)

    return docs.select("text", F.xxhash64("text"), "good").mapInArrow(encode, BLOCK)


class Block:
    """A ``BLOCK`` row and its distinct bigrams, in the order of their keys."""

    def __init__(self, rows: pa.Table | pa.RecordBatch, i: int = 0):
        def values(name: str) -> np.ndarray:
            return unpacked(rows.column(name)[i])

        self.number, self.texts, self.lengths = rows.column("block")[i].as_py(), values("texts"), values("lengths")
        self.words, self.current = values("words").view(np.uint64), values("tokens")
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.previous = np.concatenate([[0], self.current[:-1]])
        self.previous[self.starts] = 0
        good = np.repeat(values("good"), self.lengths)
        self.marks = [(good == 1).astype(np.int64), (good >= 0).astype(np.int64)]
        keys = mixed(mixed(self.words)[self.previous] + self.words[self.current])
        order, self.at = _sorted_runs(keys)
        self.one = order[self.at]  # a token of every bigram
        self.keys = keys[self.one]
        self.counts = [np.add.reduceat(x[order], self.at) for x in self.marks]
        self.place = np.empty(len(keys), dtype=np.int64)  # of every token's bigram
        self.place[order] = np.repeat(np.arange(len(self.at)), np.diff(np.append(self.at, len(keys))))


def _sorted_runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts ``keys``, and where runs of equal ones begin in it."""
    order = np.argsort(keys)
    held = keys[order]
    return order, np.nonzero(np.concatenate([np.ones(min(1, len(held)), dtype=bool), held[1:] != held[:-1]]))[0]


def _sent(number: int, keys: np.ndarray, counts: dict[str, np.ndarray], buckets: int) -> pa.RecordBatch:
    """Rows ``bucket, block, keys, counts...``: a block's sorted keys, cut where the next bucket begins.

    Keys are packed as their differences.
    """
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    offsets = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    used = np.nonzero(np.diff(offsets))[0]

    def cut(x: np.ndarray) -> pa.Array:
        return pa.array([packed(x[offsets[i]:offsets[i + 1]]) for i in used], pa.binary())

    steps = keys.copy()
    steps[1:] -= keys[:-1]
    steps[offsets[used]] = keys[offsets[used]]
    return pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int64()), pa.array(np.full(len(used), number), pa.int64()), cut(steps), *map(cut, counts.values())],
        names=["bucket", "block", "keys", *counts])


def _sent_schema(names: Iterable[str]) -> str:
    return ", ".join(["bucket long, block long, keys binary", *[f"{n} binary" for n in names]])


def _sums_schema(names: Iterable[str]) -> str:
    return ", ".join(["block long, bucket long, known long", *[f"{n} binary" for n in (*names, *_firsts(names))]])


def _firsts(names: Iterable[str]) -> list[str]:
    return [f"first_{n}" for n in names]


def summed(sent: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The rows that blocks sent, with the sums over all blocks in place of their counts.

    ``first_...`` is 1 at one of the places of every key whose sum is not 0, ``known`` the number of such places for the last sum.
    """
    def total(rows: pa.Table) -> pa.Table:
        each = [np.cumsum(unpacked(x).view(np.uint64)) for x in rows.column("keys")]
        ends = np.cumsum([len(x) for x in each])
        order, at = _sorted_runs(np.concatenate(each))
        run = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
        sums, firsts = {}, {}
        for n in names:
            counts = np.concatenate([unpacked(x) for x in rows.column(n)])
            of_key = np.add.reduceat(counts[order], at)
            sums[n], firsts[f"first_{n}"] = np.empty_like(counts), np.zeros_like(counts)
            sums[n][order] = of_key[run]
            firsts[f"first_{n}"][order[at]] = of_key > 0
        known = [int(x.sum()) for x in np.split(firsts[f"first_{names[-1]}"], ends[:-1])]
        made = {n: pa.array(map(packed, np.split(x, ends[:-1])), pa.binary()) for n, x in {**sums, **firsts}.items()}
        return pa.Table.from_arrays([rows.column("block"), rows.column("bucket"), pa.array(known, pa.int64()), *made.values()],
                                    names=["block", "bucket", "known", *made])

    return sent.groupBy("bucket").applyInArrow(total, _sums_schema(names))


def _of_block(rows: pa.Table, names: Iterable[str]) -> dict[str, np.ndarray]:
    """A block's rows of ``summed``, joined in the order in which it sent its keys."""
    rows = rows.sort_by("bucket")
    return {n: np.concatenate([unpacked(x) for x in rows.column(n)]) for n in names}


def bigram_sums(blocks: DataFrame, buckets: int) -> DataFrame:
    """``summed`` bigram counts, over the target documents and over all."""
    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block(batch, i)
                yield _sent(b.number, b.keys, dict(zip(MODELS, b.counts)), buckets)

    return summed(blocks.mapInArrow(send, _sent_schema(MODELS)), MODELS)


def word_sums(blocks: DataFrame, bigrams: DataFrame, buckets: int) -> DataFrame:
    """``summed`` counts of words: how often and before how many kinds of words as context, how often as a word."""
    def send(block: pa.Table, sums: pa.Table) -> pa.Table:
        b, first = Block(block), _of_block(sums, _firsts(MODELS))
        keys = mixed(b.words)
        order = np.argsort(keys)

        def number(places: np.ndarray, weights: np.ndarray) -> np.ndarray:
            return np.bincount(places, weights, len(keys))[order].astype(np.int64)

        context = b.previous[b.one]
        counts = [*[number(b.previous, m) for m in b.marks], *[number(context, first[f"first_{m}"]) for m in MODELS],
                  *[number(b.current, m) for m in b.marks]]
        return pa.Table.from_batches([_sent(b.number, keys[order], dict(zip(WORD_COUNTS, counts)), buckets)])

    sent = blocks.groupBy("block").cogroup(bigrams.select("block", "bucket", *_firsts(MODELS)).groupBy("block")).applyInArrow(send, _sent_schema(WORD_COUNTS))
    return summed(sent, WORD_COUNTS)


def log_model(counts: np.ndarray) -> np.ndarray:
    """Natural logs of P(current | previous) from counts[previous, current]; every row sums to one."""
    size = counts.shape[1]
    once = counts.sum(axis=0, dtype=np.float64)
    unigram = (once + 1) / (once.sum() + size)
    seen = counts.sum(axis=1, dtype=np.float64)
    kinds = (counts > 0).sum(axis=1).astype(np.float64)
    kinds[seen == 0] = 1.0  # nothing seen: the unigrams alone
    total = (seen + kinds)[:, None]
    return np.log(counts / total + (kinds[:, None] / total) * unigram).astype(np.float32)


@dataclass
class Model:
    docs: DataFrame  # that were counted
    blocks: DataFrame
    words: Vocabulary | None
    folder: str  # of the tables


def train(docs: DataFrame, target_ids: DataFrame, n_words: int | None = None, n_classes: int = N_CLASSES) -> Model:
    words = None if n_words is None else vocabulary(docs, n_words, n_classes)
    folder = f"{shared_folder(docs.sparkSession)}/lm-score-{uuid.uuid4().hex}"
    # The labels grow with the corpus, so this is a shuffle join at every size.
    good = target_ids.select("doc_id").distinct().withColumn("_good", F.lit(1))
    marked = docs.select("doc_id", "text").join(good.hint("merge"), "doc_id", "left").select("text", F.coalesce("_good", F.lit(0)).alias("good"))
    return Model(docs, kept(blocks_of(marked, words), f"{folder}/blocks", BLOCK), words, folder)


def text_losses(blocks: DataFrame, bigrams: DataFrame, words: DataFrame, totals: tuple[int, int], size: int) -> DataFrame:
    """``_text, n_tokens, target_loss, background_loss`` of the blocks' texts, by ``log_model`` of the sums."""
    none = F.lit(None).cast("binary")
    both = (bigrams.select("block", "bucket", F.lit(True).alias("pairs"), *MODELS, *[none.alias(n) for n in WORD_COUNTS])
            .unionByName(words.select("block", "bucket", F.lit(False).alias("pairs"), *WORD_COUNTS, *[none.alias(n) for n in MODELS])))
    schema = pa.schema([("_text", pa.int64()), ("n_tokens", pa.int64()), *[(f"{m}_loss", pa.float64()) for m in MODELS]])

    def losses(block: pa.Table, sums: pa.Table) -> pa.Table:
        b = Block(block)
        of = sums.column("pairs").to_numpy()
        pairs = _of_block(sums.filter(pa.array(of)), MODELS)
        order = np.argsort(mixed(b.words))
        word = {}
        for n, x in _of_block(sums.filter(pa.array(~of)), WORD_COUNTS).items():
            word[n] = np.empty(len(order))
            word[n][order] = x
        before, now = b.previous[b.one], b.current[b.one]
        means = []
        for m, total in zip(MODELS, totals):
            kinds = np.maximum(word[f"kinds_{m}"], 1)  # nothing seen: the unigrams alone
            unigram = (word[f"once_{m}"] + 1) / (total + size)
            logs = np.log((pairs[m] + kinds[before] * unigram[now]) / (word[f"seen_{m}"] + kinds)[before])
            means.append(-np.add.reduceat(logs[b.place], b.starts) / b.lengths)
        return pa.Table.from_arrays([pa.array(b.texts), pa.array(b.lengths, pa.int64()), *map(pa.array, means)], schema=schema)

    return (blocks.groupBy("block").cogroup(both.groupBy("block"))
            .applyInArrow(losses, LOSSES))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``n_tokens``, ``target_loss``, ``background_loss`` (nats a token) and ``difference``."""
    folder = f"{model.folder}/{uuid.uuid4().hex}"
    blocks = own = model.blocks
    if not docs.select("text").sameSemantics(model.docs.select("text")):
        own = kept(blocks_of(docs.select("text", F.lit(-1).alias("good")), model.words, UNCOUNTED), f"{folder}/blocks", BLOCK)
        blocks = blocks.unionByName(own)
    n = blocks.agg(*[F.sum(c).alias(c) for c in (*MODELS, "n")]).first()
    buckets = -(-(n.n or 0) // (2 * _TOKENS)) or 1
    bigrams = kept(bigram_sums(blocks, buckets), f"{folder}/bigrams", _sums_schema(MODELS))
    words = kept(word_sums(blocks, bigrams, buckets), f"{folder}/words", _sums_schema(WORD_COUNTS))
    size = model.words.size if model.words is not None else words.agg(F.sum("known")).first()[0] or 0
    if own is not blocks:
        bigrams, words = (x.where(F.col("block") >= UNCOUNTED) for x in (bigrams, words))
    made = ("n_tokens", "target_loss", "background_loss", "difference")
    keyed, names = apart(docs, made, _text=F.xxhash64("text"))
    # Copies of a text have the same figures.  Kept, so that nothing stands between the join and its exchange and common texts are split.
    losses = text_losses(own, bigrams, words, tuple(n[m] or 0 for m in MODELS), size).groupBy("_text").agg(*[F.max(c).alias(c) for c in made[:3]])
    losses = kept(losses, f"{folder}/losses", LOSSES)
    out = keyed.join(losses.hint("merge"), "_text", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long" if c == "n_tokens" else "double")) for c in made[:3]})
    return out.withColumn("difference", F.col("target_loss") - F.col("background_loss")).select(*back(names), *made)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    good = read(spark, sf_dir, "labels").where("quality = 1 AND doc_id IS NOT NULL").select("doc_id")
    return score(docs, train(docs, good)).select("doc_id", "n_tokens", "target_loss", "background_loss", "difference")
