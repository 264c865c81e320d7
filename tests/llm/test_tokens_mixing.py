"""Encoding against the tokenizer library, and mixing within its limits."""

import os

import pytest

from lexispark.llm import mixing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(f"{tokens.TOKENIZERS}/byte_bpe_50k.json"), reason="no tokenizer files")
TEXTS = ["", None, " ", "a", "a", "it’s  fine\n\n x ", "東京に行く。2024年", "<|endoftext|> x", "é́ 😀👍🏽 ﷺ", "﻿​\x00\x1f z", "　全角　", "I'll we've DON'T", "ab " * 50_000, "x" * 20_000, "\n" * 3000]


def docs(spark, texts, **extra):
    rows = [(i, t, "src", "k", 1, "w", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, k string, fp int, word string, n int")


def reference(t):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    tk.encode_special_tokens = True
    return tk.encode(t, add_special_tokens=False).ids if t else []


def test_ids_equal_the_library(spark):
    df = docs(spark, TEXTS)
    enc = tokens.encode(df.union(df))  # every row came twice
    got = {r.doc_id: list(r.ids) for r in enc.collect()}
    assert enc.count() == len(TEXTS) and got == {i: reference(t) for i, t in enumerate(TEXTS)}
    back = {r.doc_id: r.text for r in tokens.decode(enc).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    n = {r.doc_id: r.tokens for r in tokens.token_counts(df).collect()}
    assert n == {i: len(v) for i, v in got.items()}


def test_null_keys_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "c"), (None, None)], "doc_id bigint, text string")
    assert sorted(len(r.ids) for r in tokens.encode(df).collect()) == [0, 1, 2]
    assert tokens.encode(df.limit(0)).count() == 0 and tokens.token_counts(df.limit(0)).count() == 0


def test_hot_words_take_the_broadcast_way(spark):
    df = docs(spark, ["the cat the dog the"] * 3000 + ["unique words here"])
    got = tokens.encode(df)
    assert got.count() == 3001 and list(got.filter("doc_id = 0").first().ids) == reference("the cat the dog the")


TARGETS = [("big", 0.6, 1), ("small", 0.3, 3), ("tiny", 0.1, 2), ("absent", 0.0, 1)]


def test_mix_keeps_limits_and_nears_targets(spark):
    rows = [(i, f"text number {i} of big", "BIG ", 0.0) for i in range(400)] + [(1000 + i, f"small piece {i}", "small", 0.0) for i in range(60)]
    rows += [(2000 + i, f"tiny bit {i}", "Tiny", 0.0) for i in range(40)] + [(3000, "text number 5 of big", "small", 0.0), (3001, None, "big", 0.0), (3002, "", "big", 0.0), (3003, "stray", None, 0.0), (3004, "other", "else", 0.0)]
    df = spark.createDataFrame(rows + rows[:20], "doc_id bigint, text string, source string, finish double")
    t = spark.createDataFrame(TARGETS, "mix_source string, target_share double, max_repeats int")
    m, report = mixing.mix(df, t)
    uses = m.groupBy("doc_id").count().join(df.select("doc_id", "text").distinct(), "doc_id").groupBy("text").agg({"count": "sum"}).collect()
    most = {"big": 1, "small": 3, "tiny": 2}
    src = {r.doc_id: r.mix_source for r in m.select("doc_id", "mix_source").distinct().collect()}
    assert all(r[1] <= 3 for r in uses) and set(src.values()) == set(most)
    assert m.groupBy("doc_id", "mix_source").count().filter("(mix_source = 'big' and count > 1) or (mix_source = 'tiny' and count > 2) or count > 3").count() == 0
    got = {r.mix_source: r.reached_share for r in report.collect()}
    assert abs(got["big"] - 0.6) < 0.02 and abs(got["small"] - 0.3) < 0.02 and abs(got["tiny"] - 0.1) < 0.02 and got["absent"] == 0
    f = [r.finish for r in m.collect()]
    assert f == sorted(f)


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    t = spark.createDataFrame(TARGETS, "mix_source string, target_share double, max_repeats int")
    m, report = mixing.mix(df, t)
    assert m.count() == 0 and {r.reached_share for r in report.collect()} == {0.0}


def test_decode_keeps_rows_apart(spark):
    """Different texts of one key, and of a null key, come back as they were; rows that came twice come once."""
    rows = [(1, "hello"), (1, "world"), (1, "world"), (None, "x"), (None, "y"), (2, ""), (3, None), (3, "naïve 倉庫")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.text) for r in tokens.decode(tokens.encode(d)).collect()), key=str)
    assert got == sorted({(i, t or "") for i, t in rows}, key=str)
