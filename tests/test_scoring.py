"""Composite scores, ledgers, fronts, plans and selection by hand."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispark.operators import rewriting as R
from lexispark.operators import scoring as K


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ledger_and_signatures(spark):
    t = spark.createDataFrame([(1, "3分待つ"), (2, "待つ"), (3, None)], "k int, t string")
    got = {r.frame: (r.support, r.linked) for r in K.frame_ledger(t, "k", "t").collect()}
    assert got["wait"] == (1, True) and got["move"] == (0, False) and got["none"] == (0, False)
    assert K.frame_ledger(t.limit(0), "k", "t").count() == 4
    assert t.select(K.signatures(F.lit("（笑）https://a"))).first()[0] == ["link", "aside", "laugh"]


def test_polarity_and_fluency(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(K.negations(F.lit("行かない。行くかもしれない"))) == 1
    assert get(K.completions(F.lit("終わらなかった。直した"))) == ["した"]
    assert get(K.fluency(F.lit(None).cast("string"))) is None and get(K.fluency(F.lit("ok"))) == 1.0
    assert get(K.semantic_score(F.lit("3本ある"), F.lit("3本ある"))) == pytest.approx(1.0)
    assert get(K.fold_kana(F.lit("アイあ"))) == "あいあ" and get(K.diversity_text(F.lit("私は、君と。"))) == "<SELF>は<YOU>と"


def test_fronts_peel(spark):
    df = spark.createDataFrame([(1, 3, 1), (2, 1, 3), (3, 2, 2), (4, 1, 1), (5, 2, 1), (6, None, 9)], "i int, x int, y int")
    got = {r.i: r.front for r in K.fronts(df, "x", "y", 3).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 2, 4: 3}


def test_bootstrap_repeats(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(500)] + [(999, None)], "k int, v double")
    a, b = K.bootstrap_mean(df, "v", "k").first(), K.bootstrap_mean(df.repartition(7), "v", "k").first()
    assert tuple(a) == pytest.approx(tuple(b)) and a.lo < 4.5 < a.hi


def test_plans_and_diverse(spark):
    s = spark.createDataFrame([(1,), (2,)], "k int")
    o = spark.createDataFrame([(1, "a", 0), (1, "b", 5)], "k int, id string, level int")
    got = rows(R.plans(s, o, "k"))
    assert {r[0] for r in got} == {1, 2} and ([], 0) in [(r[1], r[2]) for r in got if r[0] == 2]
    c = spark.createDataFrame([(1, 1, 1.0, ["x"]), (1, 2, 0.9, ["x"]), (1, 3, 0.1, ["y"])], "q int, id int, score double, grams array<string>")
    assert rows(R.diverse(c, "q", 2)) == [(1, 1, 1), (1, 3, 2)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="漢aあｶﾞ😀é́　\nＡ", max_size=40))
def test_grapheme_map_covers_its_source(s):
    text, spans = K.grapheme_map(s)
    assert len(text) == len(spans) and all(0 <= a < b <= len(s) for a, b in spans) and spans == sorted(spans)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc", max_size=20))
def test_dictionary_against_a_plain_scan(s):
    rules = [("1", "ab", "X", 0), ("2", "a", "Y", 0), ("3", "bc", "Z", 0)]
    want, i = "", 0
    table = {a: b for _, a, b, _ in rules}
    while i < len(s):
        hit = next((k for k in ("ab", "bc", "a") if s.startswith(k, i)), None)
        want, i = (want + table[hit], i + len(hit)) if hit else (want + s[i], i + 1)
    assert R.scan_dictionary(s, rules)[0] == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9))
def test_edit_script_turns_one_list_into_the_other(a, b):
    script = R.edit_script(a, b, limit=1000)
    assert sum(len(x) for _, x, _ in script) - sum(len(y) for _, _, y in script) == len(a) - len(b)
    assert bool(script) == (a != b)


def test_inside_enclosures_keeps_every_document(spark):
    """Documents of odd length too, against a count of the brackets in plain Python."""
    from lexispark.plans import score_queries

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").filter("text is not null").collect()}
    half = {i: t[: len(t) // 2] for i, t in texts.items()}
    want = {i: sum(c in "「『（(【《〈[{«“" for c in h) > sum(c in "」』）)】》〉]}»”" for c in h) for i, h in half.items()}
    got = {r.doc_id: r.inside for r in score_queries.inside_enclosures(spark, d).collect()}
    assert any(len(t) % 2 for t in texts.values()) and got == want
