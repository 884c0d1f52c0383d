"""Columns named like the operators' own helpers keep their values; the secret scan grows with the text alone."""

import random
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from compliance_scan.llm import (collision_ann, common, decontaminate, lm_score, merkle, mixing, order_minhash, quality_gam,
                                 ranked_search, secret_scan, sharding, token_counts, toxicity)

# every name that a module of the subpackage gives a column or an alias
NAMES = sorted({n for m in (common, decontaminate, lm_score, merkle, mixing, order_minhash, quality_gam, ranked_search, secret_scan,
                            sharding, token_counts, toxicity)
                for n in re.findall(r"""["']([A-Za-z_]\w{0,14})["']""", Path(m.__file__).read_text())}
               - {"doc_id", "text", "source", "lang", "n_chars"} | {"c0", "c1", "_c0"})


@pytest.fixture(scope="module")
def plain(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([3, 40]))), "en", rng.choice(["a", "b", None]), 5) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def clashing(df, made):
    taken = [n for n in NAMES if n.lower() not in made]
    taken = list({n.lower(): n for n in taken}.values())
    return df.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in taken]), taken


def checked(out, names, rows):
    got = out.select("doc_id", *names).collect()
    assert len(got) == rows and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)


def test_sharding_keeps_columns_named_like_its_helpers(spark, plain):
    docs, names = clashing(plain, {"size", "text_crc32", "shard", "slot"})
    out = sharding.shard(docs, 4)
    checked(out, names, 40)
    same = ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert sorted(map(tuple, out.select(same).collect())) == sorted(map(tuple, sharding.shard(plain, 4).select(same).collect()))


def test_mixing_keeps_columns_named_like_its_helpers(spark, plain):
    docs, names = clashing(plain, {"size", "source_size", "target", "draws", "taken", "mix_shard", "mix_order"})
    dealt = mixing.deal(docs)
    checked(dealt, names, 40)
    same = ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(tuple, dealt.select(same).collect()), key=str) == sorted(map(tuple, mixing.deal(plain).select(same).collect()), key=str)
    mixed = mixing.mix(docs)
    checked(mixed, names, mixed.count())
    assert sorted(map(tuple, mixed.select(plain.columns).collect()), key=str) == sorted(
        map(tuple, mixing.mix(plain).select(plain.columns).collect()), key=str)


def test_lm_score_keeps_columns_named_like_its_helpers(spark, plain):
    made = ["n_tokens", "target_loss", "background_loss", "difference"]
    docs, names = clashing(plain, set(made))
    model = lm_score.train(plain, plain.where("doc_id < 9").select("doc_id"))
    out = lm_score.score(docs, model)
    checked(out, names, 40)
    assert out.agg(F.min("n_tokens")).first()[0] >= 3


def test_secret_scan_grows_with_the_text_alone():
    import tiktoken
    encoding = tiktoken.Encoding("t", pat_str=secret_scan._SPLIT, mergeable_ranks=secret_scan.read_ranks(secret_scan.VOCABULARY),
                                 special_tokens={})
    rng = random.Random(1)

    def seconds(n):
        text = " ".join("".join(rng.choices("0123456789abcdef", k=40)) for _ in range(n))
        began = time.process_time()
        found = secret_scan.random_spans(text, encoding, taken=secret_scan.base_spans(text))
        assert found == []
        return time.process_time() - began

    seconds(500)
    small, large = min(seconds(4000) for _ in range(3)), seconds(32000)
    assert large < 20 * max(small, 0.01)  # eight times the text


def test_secret_scan_cuts_overlapping_spans_out_as_before():
    import tiktoken
    encoding = tiktoken.Encoding("t", pat_str=secret_scan._SPLIT, mergeable_ranks=secret_scan.read_ranks(secret_scan.VOCABULARY),
                                 special_tokens={})
    rng = random.Random(3)
    token = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=24))
    text = f"/{'0a' * 20}/{token} password={token} {token} /{'f' * 16}"
    taken = secret_scan.base_spans(text)
    spans = {text[s:e] for s, e, _ in secret_scan.random_spans(text, encoding, taken=taken)}
    assert spans == {token, "/" + token}  # the digest before the slash and the password are cut out
