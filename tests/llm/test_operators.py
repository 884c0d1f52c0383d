"""The dealt operators on small fixtures: brute force, round trips, held-out accuracy, awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from compliance_scan.llm import (chat_template, collision_ann, decontaminate, lm_score, mixing, order_minhash,
                                 quality_gam, secret_scan, sharding, toxicity)
from compliance_scan.llm.template import TemplateError, compile_template, fold, parse
from compliance_scan.llm.words import WordHashes, words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, shard string"
LABELS = "doc_id long, quality int, toxic int"


def _words(rng, n):
    return [rng.choice("ba ke lo mi nu ra se ti vo zu".split()) + rng.choice("da fe gi ho".split())
            + rng.choice("x y z".split()) for _ in range(n)]


def _docs(spark, texts, source="s"):
    rows = [(i, t, None, source, len(t) if t is not None else None, "a", "b", "c") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty, long and repeated texts, repeated rows and ids, columns with clashing names."""
    rng = random.Random(3)
    long = " ".join(_words(rng, 30_000))
    texts = [None, "", " \t\n", "one", "one", "tie", "tie", "!!! ???", "word " * 400, long, "Ünïcode ñandú 東京"]
    rows = [(i, t, None, None if i % 3 else "src", None, "x", "y", "z") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, None, None, None, None, None, None, None), (None, "one", None, "é", 1, "", "", "")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# --- 1: near duplicates ------------------------------------------------------------


def _classes(found):
    of = {}
    for r in found.collect():
        of.setdefault(r.class_id, set()).add(r.doc_id)
    return sorted(map(sorted, of.values()))


def test_near_copies_fall_into_one_class_and_clean_documents_stay(spark):
    rng = random.Random(1)
    texts, groups = [], []
    for g in range(6):
        base = _words(rng, 300)
        members = [base] + [base[:k] + ["new"] + base[k + 1:] for k in rng.sample(range(300), 5)]
        groups.append(list(range(len(texts), len(texts) + len(members))))
        texts += [" ".join(m) for m in members]
    for _ in range(20):
        groups.append([len(texts)])
        texts.append(" ".join(_words(rng, 120)))
    found = order_minhash.near_duplicates(_docs(spark, texts))
    assert _classes(found) == groups
    assert sorted(r.doc_id for r in found.where("kept").collect()) == [g[0] for g in groups]


def test_crowded_bucket_of_unlike_texts_stays_apart(spark, monkeypatch):
    """Texts that share half of their words meet in buckets, go through finer sketches, and are not joined."""
    monkeypatch.setattr(order_minhash, "CROWD", 2)
    rng = random.Random(2)
    passage = _words(rng, 150)
    texts = [" ".join(passage + _words(rng, 60)) for _ in range(12)]
    texts.append(texts[4] + " end")
    found = order_minhash.near_duplicates(_docs(spark, texts))
    assert [c for c in _classes(found) if len(c) > 1] == [[4, 12]]


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_banded_alignment_equals_plain_lcs_where_it_matters():
    rng = random.Random(5)
    for _ in range(300):
        a = [rng.randrange(12) for _ in range(rng.randrange(1, 60))]
        b = list(a)
        for _ in range(rng.randrange(0, 8)):
            k = rng.randrange(len(b) + 1)
            b[k:k + rng.randrange(2)] = [rng.randrange(12)] * rng.randrange(2)
        if not b:
            continue
        m = _lcs(a, b)
        exact = m / (len(a) + len(b) - m)
        got = order_minhash.similarity(np.array(a), np.array(b))
        assert (got == pytest.approx(exact)) if exact >= 0.8 else got < 0.8


def test_order_is_part_of_the_sketch():
    h = WordHashes()
    words = words_of(" ".join(f"w{i}" for i in range(400)))
    swapped = words[200:] + words[:200]
    a, b = (order_minhash.kmers(w, h) for w in (words, swapped))
    same = sum(x == y for x, y in zip(order_minhash.sketch(a), order_minhash.sketch(b)))
    assert same < order_minhash.BANDS // 2
    assert order_minhash.similarity(a, b) < 0.8


def test_near_duplicates_awkward_rows(spark, awkward, nothing):
    rows = order_minhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    ones = [r for r in rows if r.doc_id in (3, 4)]
    assert {r.class_id for r in ones} == {3}
    assert order_minhash.near_duplicates(nothing).count() == 0
    kept = order_minhash.stage(spark, awkward, "")
    assert kept.columns == awkward.columns
    texts = [r.text for r in kept.collect()]
    assert texts.count("one") == 1 and texts.count("tie") == 1


# --- 2: LM scoring -------------------------------------------------------------------


def test_lm_scores_equal_a_plain_computation(spark):
    rng = random.Random(7)
    texts = [" ".join(_words(rng, rng.randrange(0, 40))) for _ in range(30)] + [None, ""]
    docs = _docs(spark, texts).select("doc_id", "text")
    target = spark.createDataFrame([(i,) for i in range(0, 30, 3)], "doc_id long")
    got = {r.doc_id: r for r in lm_score.score(docs, lm_score.train(docs, target, 20, 8)).collect()}

    words = [[w.decode() for w in words_of(t)] for t in texts]
    once = Counter(w for ws in words for w in ws)
    listed = {w: i for i, w in enumerate(sorted(once, key=lambda w: (-once[w], w.encode()))[:20])}

    def model(ids):
        counts = Counter()
        for i in ids:
            seq = [28] + [listed.get(w, lm_score.class_of(w.encode(), 20, 8)) for w in words[i]]
            counts.update(zip(seq, seq[1:]))
        uni, seen, kinds = Counter(), Counter(), Counter()
        for (a, b), n in counts.items():
            uni[b] += n
            seen[a] += n
            kinds[a] += 1
        total = sum(uni.values())

        def p(a, b):
            k = kinds[a] or 1
            return counts[a, b] / (seen[a] + k) + k / (seen[a] + k) * (uni[b] + 1) / (total + 28)

        return p

    t, b = model(range(0, 30, 3)), model(range(32))
    for i, ws in enumerate(words):
        seq = [28] + [listed.get(w, lm_score.class_of(w.encode(), 20, 8)) for w in ws]
        n = len(ws)
        for p, loss in ((t, got[i].target_loss), (b, got[i].background_loss)):
            expected = -sum(np.log(p(x, y)) for x, y in zip(seq, seq[1:])) / n if n else 0.0
            assert loss == pytest.approx(expected, abs=1e-5)
        assert got[i].n_tokens == n and got[i].difference == got[i].target_loss - got[i].background_loss


def test_lm_rows_sum_to_one_and_awkward_rows(spark, awkward, nothing):
    counts = np.random.default_rng(1).integers(0, 3, (6, 5))
    assert np.exp(lm_score.log_model(counts)).sum(axis=1) == pytest.approx(1, abs=1e-5)
    none = spark.createDataFrame([], "doc_id long")
    assert lm_score.score(awkward, lm_score.train(awkward, none)).count() == awkward.count()
    assert lm_score.score(nothing, lm_score.train(nothing, none)).count() == 0


def test_lm_keeps_every_word_and_bigram(spark, monkeypatch):
    """Whole vocabulary: rare words keep their identity, and the losses are those of a dense table."""
    monkeypatch.setattr(lm_score, "_TOKENS", 500)
    rng = random.Random(47)
    texts = [" ".join([*_words(rng, 30), *(f"rare{rng.randrange(4000)}" for _ in range(60))]) for _ in range(40)]
    texts += ["good " * 9 + "onlygood", "good " * 9 + "onlybad"] + [texts[0]] * 3 + [None, ""]
    docs = _docs(spark, texts).select("doc_id", "text").repartition(3)
    target = [*range(0, 40, 4), 40]
    ids = spark.createDataFrame([(i,) for i in target], "doc_id long")
    got = {r.doc_id: r for r in lm_score.score(docs, lm_score.train(docs, ids)).collect()}

    words = [words_of(t) for t in texts]
    number = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
    size = len(number)
    assert size > 1600
    cells = [list(zip([size, *(number[w] for w in ws)], (number[w] for w in ws))) for ws in words]
    assert len(got) == len(texts) and got[40].difference < got[41].difference
    for which, name in ((target, "target_loss"), (range(len(texts)), "background_loss")):
        counts = np.zeros((size + 1, size), dtype=np.int64)
        for i in which:
            for cell in cells[i]:
                counts[cell] += 1
        logs = lm_score.log_model(counts)
        for i, own in enumerate(cells):
            expected = -sum(float(logs[c]) for c in own) / len(own) if own else 0.0
            assert got[i][name] == pytest.approx(expected, abs=1e-4) and got[i].n_tokens == len(own)


# --- 3: sharding -----------------------------------------------------------------------


def _fits(sizes, capacity, shards):
    used, fill = 1, 0
    for s in sizes:
        if s > capacity:
            return False
        used, fill = (used, fill + s) if fill + s <= capacity else (used + 1, s)
    return used <= shards


def test_cuts_are_minimax(spark):
    rng = random.Random(11)
    for n, k in ((1, 4), (7, 3), (40, 16), (200, 5)):
        sizes = [rng.randrange(1, 500) for _ in range(n)]
        groups = spark.createDataFrame(list(enumerate(sizes)), "g long, size long")
        row = sharding.minimax_cuts(groups, k).first()
        least = next(c for c in range(max(sizes), sum(sizes) + 1) if _fits(sizes, c, k))
        assert row.capacity == least and len(row.starts) < k
        cuts = [0, *row.starts, n]
        assert max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:])) == least


def test_shards_hold_every_row_once_with_gapless_slots(spark, awkward, nothing):
    for docs, n in ((awkward, 4), (_docs(spark, [f"text {i} " * (i % 9) for i in range(900)]), 16)):
        rows = sharding.shard(docs, n).collect()
        assert len(rows) == docs.count()
        assert all(r.size == len((r.text or "").encode()) + 1 for r in rows)
        assert all(r.text_crc32 == (None if r.text is None else zlib.crc32(r.text.encode())) for r in rows)
        slots = {}
        for r in rows:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert max(slots) < n
    by = Counter()
    for r in rows:
        by[r.shard] += r.size
    assert len(by) == 16 and max(by.values()) - min(by.values()) < 0.1 * max(by.values())
    assert sharding.shard(nothing).count() == 0
    assert sharding.stage(spark, awkward, "").count() == awkward.count()


def test_sharding_runs_no_python(spark, awkward):
    plan = sharding.shard(awkward)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_equal_texts_share_a_shard_and_capacity_is_the_groups_own(spark):
    rng = random.Random(41)
    texts = [" ".join(_words(rng, rng.randrange(1, 60))) for _ in range(700)]
    texts += [t for t in texts[:90] for _ in range(rng.randrange(1, 6))] + [texts[0]] * 300 + [None] * 40
    docs = _docs(spark, texts).repartition(4)
    shards, by = {}, Counter()
    rows = sharding.shard(docs, 7).collect()
    for r in rows:
        shards.setdefault(r.text, set()).add(r.shard)
        by[r.shard] += r.size
    assert len(rows) == len(texts) and all(len(v) == 1 for v in shards.values())
    assert len(by) <= 7


@pytest.mark.parametrize("n_large", [0, 1, 5])
def test_cuts_over_cells_are_those_of_the_single_groups(spark, n_large):
    rng = random.Random(43 + n_large)
    keys = sorted({rng.getrandbits(63) for _ in range(600)})
    rows = [(k, rng.randrange(1, 400)) for k in keys]
    rows = [(k - (1 << 63), rng.randrange(4_000, 9_000)) for k in sorted(rng.getrandbits(63) for _ in range(n_large))] + rows
    groups = spark.createDataFrame(rows, "g long, size long").repartition(3)
    sizes = [s for _, s in rows]
    for k in (3, 16):
        capacity, starts = sharding.atomic_cuts(groups, k, 32)
        least = next(c for c in range(max(max(sizes), -(-sum(sizes) // k)), sum(sizes) + 1) if _fits(sizes, c, k))
        cuts = [0, *[[g for g, _ in rows].index(next(x for x, _ in rows if x >= s)) for s in starts], len(rows)]
        assert capacity == least == max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:]))


# --- 4 and 9: classifiers ------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(13)
    docs, labels = [], []
    for i in range(400):
        words = _words(rng, 60)
        toxic, good = int(i % 4 == 0), int(i % 3 != 0)
        if toxic:
            for w in ("idiot", "moron", "scum"):
                words.insert(rng.randrange(60), w)
        text = " ".join(words)
        docs.append((i, text if good else text.upper().replace(" ", "!! "), "en", "s", len(text)))
        labels.append((i, good, toxic))
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
            spark.createDataFrame(labels, LABELS), {i: (g, t) for i, g, t in labels})


@pytest.mark.parametrize("op, column, folds, out", [(quality_gam, 0, 3, 1), (toxicity, 1, 5, 0)])
def test_held_out_accuracy(labelled, op, column, folds, out):
    docs, labels, truth = labelled
    rows = op.score(docs, op.train(docs, labels)).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % folds == out]
    assert sum(r.predicted == truth[r.doc_id][column] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


@pytest.mark.parametrize("op", [quality_gam, toxicity])
def test_held_out_labels_are_never_read(labelled, op):
    docs, labels, _ = labelled
    name = "quality" if op is quality_gam else "toxic"
    hidden = F.crc32(F.col("doc_id").cast("string")) % op.FOLDS == op.HELD_OUT
    turned = labels.withColumn(name, F.when(hidden, 1 - F.col(name)).otherwise(F.col(name)))
    a, b = (op.score(docs, op.train(docs, x)).orderBy("doc_id").collect() for x in (labels, turned))
    assert [r.score for r in a] == [r.score for r in b]


@pytest.mark.parametrize("op", [quality_gam, toxicity])
def test_classifiers_awkward_rows(spark, labelled, awkward, nothing, op):
    docs, labels, _ = labelled
    odd = labels.union(spark.createDataFrame([(None, 1, 1), (5, None, None), (6, 7, 7), (9, 0, 1), (9, 1, 0)], LABELS))
    model = op.train(docs, odd)
    rows = op.score(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert op.score(nothing, model).count() == 0
    untaught = op.score(awkward, op.train(nothing, labels)).collect()
    assert all(r.score == 0.5 for r in untaught)


def test_quality_stage_keeps_columns(spark, labelled, tmp_path):
    docs, labels, truth = labelled
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = quality_gam.stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sum(truth[r.doc_id][0] for r in kept.collect()) >= 0.95 * kept.count()


# --- 5: chat formatting -------------------------------------------------------------------------


def test_conversations_round_trip(spark):
    rng = random.Random(17)
    nasty = ["", None, r"\### Assistant: </turn> ok", "### user: x</turn>\n", "\\", "\\h\\l#<", "a: b", "ü\n\n東" * 9]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a: #<\\", None]), rng.choice(nasty))
            for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "x"), (3, 0, "user", "tie"), (3, None, "assistant", "first"), (4, 0, "user", "tie"), (4, 0, "user", "tie")]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, part string")
    for size in (10, chat_template.PART_CHARS):
        parts = chat_template.format_conversations(table, part_chars=size)
        got = {r.conv_id: r for r in chat_template.read_back(parts).collect()}
        low = lambda v: (v is not None, v)
        for conv in {r[0] for r in rows}:
            turns = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: tuple(map(low, r)))
            said = "".join(f"{r or ''}\n{x or ''}\n" for _, r, x in turns)
            learnt = "".join(x or "" for _, r, x in turns if r == "assistant")
            r = got[conv]
            assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
            assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        total = parts.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()
        assert all(got[r.conv_id].formatted_chars == r.n for r in total)
    assert chat_template.format_conversations(table.limit(0)).count() == 0


def _render(source, **names):
    return "".join(t for t, _ in compile_template(source)(**names))


def test_template_language():
    m = [{"role": "user", "text": " hi "}, {"role": "bot", "text": "yo"}]
    assert _render("{% for x in m %}{{ loop.index0 }}{% if loop.last %}!{% elif loop.first %}?{% else %}.{% endif %}"
                   "{{ x.text|trim + '/' + x['role'] }};{% endfor %}", m=m) == "0?hi/user;1!yo/bot;"
    assert _render("a {{- 1 + 2 -}} b{# no #}{% set n = 'v' %}{{ n == 'v' and not false }}") == "a3bTrue"
    pieces = list(compile_template("x{% generation %}{{ a }}{% endgeneration %}y")(a="b"))
    assert pieces == [("x", False), ("b", True), ("y", False)]
    assert fold(parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}no{% else %}d{% endif %}"), {}) == [("text", "abcd")]
    for bad in ("{% for x in %}{% endfor %}", "{% if a %}", "{{ a( }}", "{{ a|nope }}", "{{ a.b }}"):
        with pytest.raises(TemplateError):
            _render(bad, a="text")


# --- 6: secrets ------------------------------------------------------------------------------------


def test_secrets_base_and_random_spans(spark, awkward, nothing):
    random_ = "qZ8xK3vTn5Lw9RbY2mPd7HsJ"
    texts = {
        0: "TOKEN = 'abcdefghijkl' x", 1: "token: secret: abcdefghijklmnop", 2: "AKIA" + "A1" * 7, 3: "AKIAABCDEFGH",
        4: "ü 0123456789abcdef g", 5: "0123456789abcde", 6: f"see {random_} there", 7: "some_long_identifier_name_here",
        8: "d41d8cd98f00b204e9800998ecf8427e".upper(), 9: "123e4567-e89b-12d3-a456-426614174000", 10: "paſſword=abcdefghijkl",
        11: "x" * 200_000 + " " + random_,
    }
    docs = _docs(spark, [texts[i] for i in range(len(texts))])
    got = {r.doc_id: [(s.start, s.end, s.kind) for s in r.secrets] for r in secret_scan.scan(docs).collect()}
    assert got[0] == [(0, 21, "assign")]
    assert got[1] == []  # the first match takes "secret" and fails; it is not tried again inside
    assert got[2] == [(0, 18, "access")] and got[3] == []
    assert got[4] == [(2, 18, "hex")] and got[5] == []
    assert got[6] == [(4, 4 + len(random_), "random")]
    assert got[7] == got[8] == got[9] == got[10] == []
    assert got[11] == [(200_001, 200_001 + len(random_), "random")]
    assert secret_scan.scan(docs, known_digests=[random_]).where("doc_id = 6").first().secrets == []
    assert secret_scan.scan(awkward).count() == awkward.count() and secret_scan.scan(nothing).count() == 0


def test_one_case_random_strings_are_judged_by_the_vocabulary():
    encoding = secret_scan._encoding(secret_scan.read_ranks(secret_scan.VOCABULARY))
    rng = random.Random(53)
    for letters, least in (("abcdefghijklmnopqrstuvwxyz", 0.9), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.95),
                           ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.97)):
        runs = ["".join(rng.choices(letters, k=24)) for _ in range(300)]
        assert sum(secret_scan.random_spans(r, encoding) == [(0, 24, "random")] for r in runs) >= least * 300
    for plain in ("internationalization_settings", "MAXIMUM_BUFFER_LENGTH_LIMIT", "/home/service/deploy/config",
                  "getCustomerSubscriptionCallback2", "=" * 40, "2024-05-06/2024-05-07-10-11"):
        assert secret_scan.random_spans(plain, encoding) == []


def test_random_strings_behind_paths_and_names_are_found():
    encoding = secret_scan._encoding(secret_scan.read_ranks(secret_scan.VOCABULARY))
    secret, short, digest = "qZ8xK3vTn5Lw9RbY2mPd7HsJ", "q8ZxK3vTn5Lw", "0a1b2c3d4e" * 4
    for before in ("/home/service/deploy/config/production/", "api/v1/customers/subscription/callback/key=", f"/{digest}/",
                   "123e4567-e89b-12d3-a456-426614174000/"):
        for own in (secret, short, "q8Zx-K3vTn5L_w9Rb"):
            text = f"see {before}{own}/readme now"
            spans = secret_scan.random_spans(text, encoding, (), taken=secret_scan.base_spans(text))
            assert [text[s:e] for s, e, _ in spans] == [own]
    assert secret_scan.random_spans(f"see /path/{secret}/readme", encoding, [secret]) == []


# --- 7: mixing ---------------------------------------------------------------------------------------


def _water(sizes, weights, total, cap):
    """Targets by repeated resharing."""
    target, open_, left = {}, set(sizes), total
    while open_:
        unit = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if unit * weights[s] >= cap * sizes[s]}
        if not full:
            return target | {s: unit * weights[s] for s in open_}
        target |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return target


def test_mixture_meets_targets(spark, awkward, nothing):
    rng = random.Random(19)
    rows = [(i, " ".join(_words(rng, rng.randrange(0, 80))), rng.choice(["a", "a", "a", "b", "é", "z", None]))
            for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.deal(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = sorted(s for s in sizes if s is not None) + [None]
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    targets = _water(sizes, weights, 1.5 * sum(sizes.values()), 2)
    taken, shards = Counter(), Counter()
    for r in got:
        assert r.taken <= 2 * r.size and r.taken == sum(d.words for d in r.draws)
        taken[r.source] += r.taken
        shards.update(d.shard for d in r.draws)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 1
        assert next(r for r in got if r.source == s).target == pytest.approx(targets[s])
    assert set(shards) == set(range(mixing.N_SHARDS))
    again = mixing.deal(docs.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = mixing.mix(docs).collect()
    assert sum(len(r.text.split()) for r in out) == sum(taken.values())
    assert mixing.deal(awkward).count() == awkward.count() and mixing.deal(nothing).count() == 0
    assert mixing.stage(spark, awkward, "").columns == awkward.columns and mixing.stage(spark, nothing, "").count() == 0


def test_splitting_tree_keeps_quotas_and_even_shards():
    quotas = [1000, 3, 0, 57, 400]
    out = mixing.split_tree(quotas, 16, 1)
    assert out.sum(axis=1).tolist() == quotas
    assert out.sum(axis=0).max() - out.sum(axis=0).min() <= 1 and (out >= 0).all()
    assert (out == mixing.split_tree(quotas, 16, 1)).all()


# --- 8: decontamination ----------------------------------------------------------------------------------


def _hits(text, items):
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    hit, found = set(), set()
    for item, t in items:
        w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j:j + n] == w[i:i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 200])
def test_contamination_equals_brute_force(spark, awkward, nothing, block):
    rng = random.Random(23)
    items = [(k, " ".join(_words(rng, n))) for k, n in enumerate((40, 20, 13, 5, 1, 14))] + [(10, None), (11, ""), (12, "!")]
    items += [(2, items[2][1]), (100, items[0][1])]
    texts = [None, "", " ".join(_words(rng, 50))]
    for k in range(30):
        part = items[k % 6][1].split()
        a = rng.randrange(0, len(part))
        words = _words(rng, 40) + part[a:] + _words(rng, rng.randrange(300)) + part[:rng.randrange(len(part) + 1)]
        texts.append(" ".join(w.upper() if rng.random() < 0.2 else w + rng.choice(["", ",", "\n"]) for w in words))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = _docs(spark, texts)
    got = {r.doc_id: r for r in decontaminate.judge(docs, benchmark, block_bytes=block).collect()}
    for i, t in enumerate(texts):
        n, hit, found = _hits(t, items)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
    kept = {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()}
    assert kept == {i for i in got if not got[i].contaminated}
    cut = {r.doc_id: r.text for r in decontaminate.clean(docs, benchmark, remove="spans").collect()}
    assert all(len(words_of(cut[i])) == got[i].n_words - got[i].n_hit for i in got)
    assert decontaminate.judge(awkward, benchmark).count() == awkward.count()
    assert decontaminate.judge(nothing, benchmark).count() == 0
    assert decontaminate.judge(awkward, benchmark.limit(0)).where("contaminated").count() == 0


# --- 10: nearest neighbours --------------------------------------------------------------------------------


def test_nearest_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(29)
    centres = rng.standard_normal((20, 32))
    x = centres[rng.integers(0, 20, 1500)] + 0.6 * rng.standard_normal((1500, 32))
    x[700:760] = x[700]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2050, [0.0] * 32), (2001, [float("nan")] * 32), (2002, [None] * 32), (2003, []), (None, x[0].tolist()),
           (2100, [1.0, 2.0]), (2101, [2.0, 1.0])]
    table = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, score int").repartition(3)
    got = {}
    for r in collision_ann.nearest(table).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q in range(0, 1500, 50):
        s = unit @ unit[q]
        best = [i for i in np.lexsort((np.arange(1500), -np.round(s, 12))) if i != q][:5]
        hit += len(set(best) & {i for i, _ in got[q]})
        assert len(got[q]) == 5 and all(abs(v - s[i]) < 1e-12 for i, v in got[q])
        assert got[q] == sorted(got[q], key=lambda g: (-g[1], g[0]))
    assert hit >= 0.9 * 5 * 30
    assert [i for i, _ in got[700]] == [701, 702, 703, 704, 705]
    assert [i for i, _ in got[2100]] == [2101] and set(got) == {*range(0, 1500, 50), 2100}
    split = collision_ann.nearest(table, chunk_bytes=2000).collect()
    assert len(split) == sum(map(len, got.values()))
    assert collision_ann.nearest(table.limit(0)).count() == 0
