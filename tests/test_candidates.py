"""Selection, grammars, analysers, relations, proofs and sources on small inputs, against brute force where there is one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.operators import candidates as K
from lexispark.operators import captures as C
from lexispark.operators import evaluate as E
from lexispark.operators import grammar as G
from lexispark.operators import graph
from lexispark.operators import learning as M
from lexispark.operators import linking as L
from lexispark.operators import rewriting as R
from lexispark.operators import sequences as W
from lexispark.sources import logs, snapshots

POOL = "request string, cand string, verdict string, C int, R int, x double, y double, family string, changed string, whole string"


def dice(a, b):
    g = lambda s: {s[i : i + 3] for i in range(len(s) - 2)} if len(s) >= 3 else ({s} if s else set())
    return 2 * len(g(a) & g(b)) / max(1, len(g(a)) + len(g(b)))


def by_hand(rows, hashes):
    """The greedy choice over one pool."""
    ok = [r for r in rows if r["verdict"] == "passed" and r["C"] == 1 and r["R"] == 1]
    beats = lambda o, r: o["x"] >= r["x"] and o["y"] >= r["y"] and (o["x"] > r["x"] or o["y"] > r["y"])
    front = {r["cand"]: sum(beats(o, r) for o in rows) for r in rows}
    out = []
    while len(out) < 3:
        left = [r for r in ok if r not in out and not any(p["whole"] == r["whole"] or (p["family"], p["changed"]) == (r["family"], r["changed"]) for p in out)]
        if not left:
            break
        out.append(min(left, key=lambda r: (front[r["cand"]], any(p["family"] == r["family"] for p in out), max((round(dice(r["changed"], p["changed"]), 6) for p in out), default=0.0), hashes[r["cand"]], r["cand"])))
    return [r["cand"] for r in out]


def test_diverse_selection_against_the_greedy_loop(spark):
    rng = random.Random(4)
    rows = []
    for q in range(12):
        for i in range(rng.randint(0, 9)):
            t = "".join(rng.choice("abc") for _ in range(6))
            rows.append((f"q{q}", f"q{q}c{i}", rng.choice(["passed", "passed", "rejected"]), 1, rng.choice([1, 1, 0]), float(rng.randint(0, 2)), float(rng.randint(0, 2)), rng.choice(["head", "tail"]), t, rng.choice([t, "same"])))
    df = spark.createDataFrame(rows, POOL)
    hashes = {r.cand: r.h for r in df.select("cand", F.sha2(F.concat(F.lit("s:"), "cand"), 256).alias("h")).collect()}
    got = {}
    for r in K.select_diverse(K.fronts(df, "x", "y"), "s").orderBy("request", "pick").collect():
        got.setdefault(r.request, []).append(r.cand)
    names = POOL.replace(" string", "").replace(" int", "").replace(" double", "").split(", ")
    for q in {r[0] for r in rows}:
        assert got.get(q, []) == by_hand([dict(zip(names, r)) for r in rows if r[0] == q], hashes)
    assert K.select_diverse(K.fronts(df.limit(0), "x", "y")).count() == 0
    why = {r.request: (r.selected, r.reason) for r in K.outcome(df, K.select_diverse(K.fronts(df, "x", "y"), "s")).collect()}
    assert all((n == 3) == (reason is None) for n, reason in why.values())


def test_checks_and_finalised(spark):
    rows = [("q", "a", "鍵は3本だ。", "まず鍵は3本だ。"), ("q", "b", "鍵は3本だ。", "鍵は4本だ。"), ("q", "c", "鍵は3本だ。", None), ("q", "d", "鍵は3本だ。", "鍵は3本だ"), ("q", "e", "鍵は3本だ。", "まず鍵は3本だ。")]
    df = spark.createDataFrame(rows, "request string, cand string, source string, text string")
    checks = K.check_rows(df)
    bad = {(r.cand, r.code) for r in checks.filter("status = 'fail'").collect()}
    assert ("b", "V-quantity") in bad and ("b", "V-coverage") in bad and not any(c == "a" for c, _ in bad)
    v = E.status_fold(checks, "cand")
    assert {r.cand: r.verdict for r in v.collect()} == {"a": "passed", "b": "rejected", "c": "needs_review", "d": "rejected", "e": "passed"}
    final = K.finalised(df.join(v, "cand"), ["cand"]).collect()
    assert [(r.cand, r.place) for r in final] == [("a", 1)]  # e says the same, d only drops a mark


def test_replays(spark):
    rows = [("a", None, None, "h0"), *[(f"r{i}", "a" if i == 0 else f"r{i - 1}", "h0" if i == 0 else f"h{i}", f"h{i + 1}") for i in range(25)], ("x", "gone", "h", "h"), ("y", "a", "wrong", "h"), ("z", "z", "h", "h")]
    got = {r.id: (r.steps, r.intact) for r in K.replay_chain(spark.createDataFrame(rows, "id string, parent string, parent_hash string, hash string"), 20).collect()}
    assert got["a"] == (0, True) and got["r3"] == (4, True) and got["r24"] == (20, False) and not got["x"][1] and not got["y"][1] and not got["z"][1]


def test_proof_by_edits(spark):
    rules = [("a", "鍵", "キー", 0), ("b", "箱", "", 0)]
    t = spark.createDataFrame([(1, "鍵と箱"), (2, "何もない"), (3, "鍵鍵"), (4, "")], "k int, text string")
    done = R.apply_dictionary(t, "k", "text", rules)
    assert all(r.ok for r in R.verify_edits(t, "k", "text", done, rules).collect())
    forged = done.withColumn("text", F.when(F.col("k") == 3, "キー鍵").otherwise(F.col("text")))
    assert {r.k: r.ok for r in R.verify_edits(t, "k", "text", forged, rules).collect()} == {1: True, 2: True, 3: False, 4: True}
    hidden = done.withColumn("edits", F.when(F.col("k") == 1, F.slice("edits", 1, 1)).otherwise(F.col("edits")))
    assert {r.k: r.ok for r in R.verify_edits(t, "k", "text", hidden, rules).collect()}[1] is False


def test_inversions_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.randint(0, 30)) for g in range(6) for i in range(rng.choice([1, 2, 17, 64, 100]))]
    got = {r.g: r.inversions for r in W.inversions(spark.createDataFrame(rows, "g int, p int, v int"), "g", "p", "v").collect()}
    for g in range(6):
        v = [x for h, _, x in sorted(rows) if h == g]
        assert got[g] == sum(v[i] > v[j] for i in range(len(v)) for j in range(i + 1, len(v)))


def test_hubs_give_the_same_components(spark, monkeypatch):
    """A node with most edges meets its minimum by broadcast; the components stay the same."""
    rng = random.Random(3)
    edges = [("hub", f"n{i}") for i in range(400)] + [(f"m{rng.randint(0, 200)}", f"m{rng.randint(0, 200)}") for _ in range(150)] + [("n5", "m7")]
    df = spark.createDataFrame(edges, "a string, b string")
    plain = {r.node: r.component for r in graph.connected_components(df).collect()}
    monkeypatch.setattr(graph, "HUB", 50)
    real = graph.lookup_join
    met = []

    def hot(left, lookup, key, weight):
        import lexispark.operators.skew as skew

        met.append(skew.hot_rows(lookup, weight, 5, 50) is not None)
        return real(left, lookup, key, weight, 5) if not met[-1] else _with_least(skew, left, lookup, key, weight)

    def _with_least(skew, left, lookup, key, weight):
        monkeypatch.setattr(skew, "hot_rows", lambda l, w, share, least=2000, f=skew.hot_rows: l.filter(F.col(w) >= 50))
        try:
            return real(left, lookup, key, weight, 5)
        finally:
            monkeypatch.undo()
            monkeypatch.setattr(graph, "HUB", 50)
            monkeypatch.setattr(graph, "lookup_join", hot)

    monkeypatch.setattr(graph, "lookup_join", hot)
    assert {r.node: r.component for r in graph.connected_components(df).collect()} == plain and any(met)


def test_relations_of_a_tiny_tree(spark):
    """帰る ← 降る (から): a cause; 言う ← 来る (と): a report."""
    rows = [(1, 0, "雨", "雨", "NOUN", "nsubj", 1, 0, 1), (1, 1, "降る", "降る", "VERB", "advcl", 3, 1, 3), (1, 2, "から", "から", "SCONJ", "mark", 1, 3, 5), (1, 3, "帰る", "帰る", "VERB", "ROOT", 3, 5, 7),
            (2, 0, "来る", "来る", "VERB", "ccomp", 2, 0, 2), (2, 1, "ば", "ば", "SCONJ", "mark", 0, 2, 3), (2, 2, "いい", "いい", "ADJ", "ROOT", 2, 3, 5)]
    t = spark.createDataFrame(rows, "case_id bigint, id int, text string, lemma string, pos string, dep string, head int, start int, end int")
    p = C.propositions(t)
    got = {tuple(r) for r in C.relations(p, t).collect()}
    assert got == {(1, "explicit_cause", 1, 3), (2, "conditional_on", 2, 0)}
    a = {(r.case_id, r.id): r.assertive for r in C.assertive(p, t).collect()}
    assert a[1, 3] and not a[2, 0] and not a[2, 2]


def test_analyser_plug_in(spark):
    d = spark.createDataFrame([(1, "ab 12!"), (2, None), (3, "")], "k int, text string")
    got = [tuple(r) for r in C.analyse(d, "k", "text").orderBy("k", "id").collect()]
    assert got == [(1, 0, "ab", "WORD", 0, 0, 2), (1, 1, "12", "WORD", 1, 3, 5), (1, 2, "!", "MARK", 2, 5, 6)]
    shout = lambda: lambda t: [{"id": 0, "text": t.upper(), "pos": "X", "head": 0, "start": 0, "end": len(t)}]
    assert C.analyse(d, "k", "text", shout).filter("k = 1").first().text == "AB 12!"


def test_grammar_tables(spark):
    t = spark.createDataFrame([("a", "だけだ", "x"), ("b", "無い句", "x"), ("c", "だけだ", "y")], "template string, evidence string, board string")
    x = spark.createDataFrame([("これだけだ", "x"), ("それだけだ", "x"), (None, "y")], "text string, board string")
    assert {r.template: r.support for r in G.evidenced(t, x, "text").collect()} == {"a": 2, "b": 0, "c": 2}
    assert {r.template: r.support for r in G.evidenced(t, x, "text", "board").collect()} == {"a": 2, "b": 0, "c": 0}
    o = spark.createDataFrame([(g, i) for g in "pq" for i in range(9)], "g string, i int")
    one = {tuple(r) for r in G.drawn(o, ["g"], ["i"], 4, "s").collect()}
    assert one == {tuple(r) for r in G.drawn(o.repartition(5), ["g"], ["i"], 4, "s").collect()} and len(one) == 8
    assert one != {tuple(r) for r in G.drawn(o, ["g"], ["i"], 4, "t").collect()}
    c = G.chunked(spark.createDataFrame([("f", i, n) for i, n in enumerate([5, 4, 3, 9, 1])], "f string, i int, n int"), ["f"], ["i"], "n", 9)
    assert [r.chunk for r in c.orderBy("i").collect()] == [0, 0, 1, 2, 3]


def test_quotes_of_any_length(spark):
    forms = spark.createDataFrame([(1, "p1", "鍵"), (2, None, "鍵"), (3, None, "古い倉庫の鍵を"), (4, None, "無い言葉です"), (5, "p2", "倉庫")], "line bigint, post_id string, text string")
    hay = spark.createDataFrame([("p1", "古い倉庫の鍵を探した"), ("p2", "倉庫と鍵"), ("p3", "")], "id string, text string")
    got = {r.line: (r.candidates, r.selected, r.status, r.id) for r in L.quote_status(forms, hay).collect()}
    assert got == {1: (2, 1, "matched", "p1"), 2: (2, 2, "ambiguous", None), 3: (1, 1, "matched", "p1"), 4: (0, 0, "unmatched", None), 5: (2, 1, "matched", "p2")}


def test_charsets_and_pointers(spark, tmp_path):
    d = spark.createDataFrame([("倉庫",), ("abc",), (None,)], "t string")
    x = d.select("t", logs.encode_text(F.col("t"), "cp932").alias("b"))
    assert [r[0] for r in x.select(logs.decode_bytes(F.col("b"), "cp932")).collect()] == ["倉庫", "abc", None]
    assert [r[0] for r in x.select(logs.decode_bytes(F.col("b"), "utf-8", True)).collect()] == [None, "abc", None]
    d.filter("t is not null").coalesce(1).write.text(f"{tmp_path}/log")
    with pytest.raises(ValueError):
        logs.read_lines(spark, f"{tmp_path}/log", max_bytes=3)
    root = f"file://{tmp_path}/pub"
    with pytest.raises(FileNotFoundError):
        snapshots.load(spark, root)
    ids = [snapshots.publish({"t": spark.range(n)}, root) for n in (3, 4)]
    for i in (ids[0], ids[1], ids[0]):
        snapshots.activate(spark, root, i)
    assert snapshots.load(spark, root)["t"].count() == 3 and snapshots.published(spark, root) == sorted(ids)


def test_singular_vectors_against_numpy(spark):
    rng = np.random.default_rng(1)
    a = np.abs(rng.normal(size=(12, 5)))
    w = spark.createDataFrame([(i, f"t{j}", float(a[i, j])) for i in range(12) for j in range(5)], "k int, term string, w double")
    got = {r.k: np.array(r.vector) for r in M.truncated_svd(w, "k", "term", "w", 2, 1 << 10).collect()}
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    want = u[:, :2] * s[:2]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    sim = np.array([[got[i] @ got[j] for j in range(12)] for i in range(12)])
    assert np.allclose(sim, want @ want.T, atol=1e-6)
    assert M.truncated_svd(w.limit(0), "k", "term", "w", 2).count() == 0


def test_dense_top_k_against_all_pairs(spark):
    """Ties, copies, null and zero vectors, several blocks of queries, several batches."""
    from lexispark.operators import vectors as V

    rng = np.random.default_rng(2)
    v = [[float(x) for x in rng.integers(-2, 3, 4)] for _ in range(60)] + [[1.0, 1.0, 0.0, 0.0]] * 15
    rows = [(i, x, f"l{i % 3}") for i, x in enumerate(v)] + [(100, None, "n"), (101, [0.0] * 4, "z")]
    df = spark.createDataFrame(rows, "k bigint, v array<double>, l string")
    got = {}
    for r in V.dense_top_k(df.repartition(5), df.filter("k % 5 = 0"), "k", "v", 4, ["l"], block=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.k, r.sim, r.l))
    u = {i: np.array(x) / np.linalg.norm(x) for i, x, _ in rows if x and any(x)}
    for q in [i for i in u if i % 5 == 0]:
        want = sorted(((-round(float(u[q] @ u[i]), 6) + 0.0, i) for i in u if i != q))[:4]
        assert [(i, round(-s, 6) + 0.0) for s, i in want] == [(i, s) for i, s, _ in got[q]]
    assert 100 not in got and 101 not in got and V.dense_top_k(df, df.limit(0), "k", "v", 4).count() == 0
