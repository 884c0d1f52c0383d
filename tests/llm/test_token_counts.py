"""Token counts against the library on whole texts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from compliance_scan.llm import token_counts as tc

LIBRARY = Tokenizer.from_file(tc.VOCABULARY)
RULES = open(tc.VOCABULARY, encoding="utf-8").read()
AWKWARD = ["", " \t\n\r\x0b\x0c ", "don't I'LL we've", "<|endoftext|>", "a<|startoftext|>b c <|endoftext|><|endoftext|>",
           "<|endoftext |>", "x = ̸ y≠ é ́", "İSTANBUL ΣΊΣΥΦΟΣ ſ K", "a\x1cb\x1dc\x85d e f　g",
           "1234567 ١٢٣ Ⅷ²", "東京 日本語、テスト。", "👩‍👩‍👧 🇰🇷 ﻿​", "\x00\x01 \x7f", "a" * 5000, "ab " * 3000, "...!!!???"]


def plain(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def _counter(words=(), **options):
    words = [w.encode() for w in words]
    return tc.TokenCounter(RULES, tc.Frequent(words, tc.lengths(LIBRARY, words)), **options)


@pytest.mark.parametrize("options", [{}, {"cache_words": 2}, {"piece_bytes": 3}, {"cache_words": 4, "piece_bytes": 17}])
@pytest.mark.parametrize("words", [(), ("ab", "don't", "<|endoftext|>", "東京", "ab.")])
def test_awkward_texts_have_the_librarys_counts(words, options):
    assert _counter(words, **options).count([None, *AWKWARD, *AWKWARD]) == [0, *map(plain, AWKWARD), *map(plain, AWKWARD)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(
    ["<|endoftext|>", "<|", " ", "\n", "'s", "e", "́", "Σ", "1", " ", "=", "̸", "。", "."]), max_size=12).map("".join)), max_size=4))
def test_any_text_has_the_librarys_count(texts):
    assert _counter(["e", "=", "."], cache_words=4, piece_bytes=5).count(texts) == list(map(plain, texts))


def test_table_checks_words_behind_equal_hashes(monkeypatch):
    monkeypatch.setattr(tc.xxhash, "xxh3_64_intdigest", lambda w: len(w) % 2)
    table = tc.Frequent([b"a", b"bb", b"ccc", b"dd"], [1, 2, 3, 4])
    assert table.find([b"ccc", b"dd", b"a", b"bb", b"e", b"ff"]).tolist() == [3, 4, 1, 2, -1, -1]
    assert tc.Frequent([], []).find([b"a"]).tolist() == [-1]


def test_pieces_join_to_the_text():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("ab \n") for _ in range(rng.randrange(40))).encode()
        cut = list(tc.pieces(text, rng.randrange(1, 9)))
        assert b"".join(cut) == text and all(x[-1:].isspace() for x in cut[:-1])


def test_table_with_nulls_repeats_and_clashing_names(spark):
    texts = [None, *AWKWARD, "ab", "ab", "w " * 2047, "w " * 2048, "w " * 2049]
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(texts)] + [(None, "ab", "x", "y", "z"), (1, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, word string, n string").repartition(5)
    found = tc.count_tokens(docs)
    assert found.columns == ["doc_id", "text", "n_tokens", "word", "n", "n_bytes", "over_limit"]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit, str(r.n)) for r in found.collect())
    want = sorted((i is None, i or 0, len((t or "").encode()), plain(t), plain(t) > 2048, str(n)) for i, t, _, _, n in rows)
    assert got == want
    assert tc.count_tokens(docs.limit(0)).collect() == []
    assert found.where("over_limit").count() == 2


def test_the_table_of_frequent_words_changes_no_count(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: plain(r.text) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in tc.query(spark, "/root/testdata/sf0.001").collect()} == want
    assert {r.doc_id: r.n_tokens for r in tc.count_tokens(docs, frequent=0).collect()} == want
    words = tc.frequent_words(docs.repartition(7), most=50)
    assert len(words) == 50 and len(tc.frequent_words(docs, sample_bytes=2000)) < len(tc.frequent_words(docs))


def test_plan_has_no_shuffle(spark):
    plan = tc.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
