"""Candidate texts of a request: named checks, quality, fronts, diverse selection, final verdicts and replays.

Candidates are rows (request, cand, source, text, ...). A pool is bounded (POOL per request), as each step here compares the
candidates of a request with the few that were picked before, never with each other pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions import patterns as P
from lexispark.functions import text as T
from lexispark.session import materialize

POOL, PICKS = 36, 3
# Patterns of what a rewrite must keep.
FUTURE, HEARSAY, NEGATIVE = "だろう|予定|明日|will |wird ", "らしい|という|said|says|laut", "ない|なかった|never|nicht|not"
NUMBER = r"[0-9]+(?:\.[0-9]+)?"


def numbers(c: Column) -> Column:
    return F.array_sort(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0)))


def check_rows(cands: DataFrame) -> DataFrame:
    """(request, cand, code, status, required): one row per candidate and named check; a null text leaves all unknown."""
    a, b = F.col("source"), F.col("text")
    same = lambda p: F.regexp_count(a, F.lit(p)) % 2 == F.regexp_count(b, F.lit(p)) % 2
    held = lambda p: a.rlike(p) == b.rlike(p)
    tests = [
        ("V-coverage", F.contains(b, a), "fail"), ("V-quantity", numbers(a) == numbers(b), "fail"), ("V-polarity", same(NEGATIVE), "fail"), ("V-temporal", held(FUTURE), "fail"),
        ("V-attribution", held(HEARSAY), "unknown"), ("V-length", F.length(b) <= F.greatest(F.lit(100), F.length(a) * 2), "fail"), ("V-rhetoric", ~b.rlike("[！!]{3,}|。。"), "fail"),
    ]
    rows = [F.struct(F.lit(k).alias("code"), F.when(ok, "pass").when(~ok, bad).otherwise("unknown").alias("status"), F.lit(k != "V-rhetoric").alias("required")) for k, ok, bad in tests]
    return cands.select("request", "cand", F.explode(F.array(*rows)).alias("c")).select("request", "cand", "c.*")


def quality(c: Column, source: Column, verdict: Column) -> tuple[Column, Column]:
    """(C, R): 1 for a passed, 0 for a rejected candidate, null between; 1 for readable text of bounded length, else 0."""
    clauses = F.filter(F.split(c, "[、。]"), lambda x: x != "")
    readable = (F.size(clauses) >= 1) & F.forall(clauses, lambda x: F.length(x) <= 100) & (F.length(c) <= F.greatest(F.lit(100), F.length(source) * 2))
    return F.when(verdict == "passed", 1).when(verdict == "rejected", 0), F.coalesce(readable.cast("int"), F.lit(0))


def profile(source: Column, text: Column) -> tuple[Column, Column]:
    """(family, changed): where a text adds to its source (both ends, head, tail, none, inside), and what it adds there."""
    at = F.when((source != "") & F.contains(text, source), F.instr(text, source))
    head, tail = F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(source), F.length(text))
    family = F.when(at.isNull(), "inside").when((head != "") & (tail != ""), "both").when(head != "", "head").when(tail != "", "tail").otherwise("none")
    return family, P.variant_text(F.when(at.isNull(), text).otherwise(F.concat(head, F.lit("|"), tail)))


def fronts(pool: DataFrame, x: str, y: str) -> DataFrame:
    """pool with front: how many others of the request beat the candidate in both scores (0 for the best); by the bounded pool."""
    mine = pool.groupBy("request").agg(F.collect_list(F.struct("cand", F.col(x).alias("x"), F.col(y).alias("y"))).alias("all"))
    beaten = F.size(F.filter("all", lambda o: (o["x"] >= F.col(x)) & (o["y"] >= F.col(y)) & ((o["x"] > F.col(x)) | (o["y"] > F.col(y)))))
    return pool.join(mine, "request").withColumn("front", F.when(F.col(x).isNull() | F.col(y).isNull(), 0).otherwise(beaten)).drop("all")


def bounded(cands: DataFrame, order: list, most: int = POOL) -> DataFrame:
    """At most ``most`` candidates per request, the first in order: the size of a pool is a rule of the selection."""
    return cands.withColumn("__r", F.row_number().over(Window.partitionBy("request").orderBy(*order))).filter(F.col("__r") <= most).drop("__r")


def select_diverse(pool: DataFrame, seed: str = "", picks: int = PICKS) -> DataFrame:
    """(request, cand, pick): up to ``picks`` candidates of each pool, taken one after another.

    Eligible are those with verdict passed, C >= 1 and R within 0.15 of the best R of the pool, at least 0.5. A pick goes by front, R, whether its
    family is new, how far its change is from the changes picked before (1 - Dice of trigrams, 6 digits), a seeded hash, then
    cand. A candidate that says the same as a pick (equal variant text, or equal family and change) is never picked.
    Pool: request, cand, verdict, C, R, front, family, changed, whole.
    """
    best = F.max("R").over(Window.partitionBy("request"))
    ok = pool.filter((F.col("verdict") == "passed") & (F.col("C") >= 1) & (F.col("R") >= 0.5)).withColumn("__b", best).filter(F.col("R") >= F.col("__b") - 0.15).drop("__b")
    ok = ok.withColumn("grams", T.gram_set(F.col("changed")))
    picked = F.array().cast("array<struct<cand:string,family:string,changed:string,whole:string,grams:array<string>>>")
    rest = ok.withColumn("picked", picked)
    out = None
    for i in range(picks):
        choices = rest.filter(~F.exists("picked", lambda p: (p["whole"] == F.col("whole")) | ((p["family"] == F.col("family")) & (p["changed"] == F.col("changed")))))
        near = F.coalesce(F.array_max(F.transform("picked", lambda p: F.round(T.dice(F.col("grams"), p["grams"]), 6))), F.lit(0.0))
        order = [F.col("front"), F.col("R").desc(), F.exists("picked", lambda p: p["family"] == F.col("family")), F.round(near, 6), F.sha2(F.concat(F.lit(f"{seed}:"), "cand"), 256), F.col("cand")]
        one = choices.withColumn("__k", F.row_number().over(Window.partitionBy("request").orderBy(*order))).filter("__k = 1")
        now = one.select("request", "cand", F.lit(i + 1).alias("pick"), F.struct("cand", "family", "changed", "whole", "grams").alias("new"))
        out = now if out is None else out.unionByName(now)
        rest = choices.join(now.select("request", F.col("cand").alias("__c"), "new"), "request").filter(F.col("cand") != F.col("__c"))
        rest = rest.withColumn("picked", F.array_append("picked", F.col("new"))).drop("new", "__c")
    return out.select("request", "cand", "pick")


def outcome(pool: DataFrame, selected: DataFrame, picks: int = PICKS) -> DataFrame:
    """(request, selected, reason): how many candidates each request got, and why fewer than ``picks``."""
    n = selected.groupBy("request").agg(F.count(F.lit(1)).alias("selected"))
    has = lambda v: F.coalesce(F.bool_or(F.col("verdict") == v), F.lit(False))
    state = pool.groupBy("request").agg(has("passed").alias("p"), has("needs_review").alias("r"))
    j = state.join(n, "request", "left").withColumn("selected", F.coalesce("selected", F.lit(0)))
    why = F.when(F.col("selected") >= picks, F.lit(None).cast("string")).when(F.col("selected") > 0, "candidate_shortage").when(F.col("r"), "needs_review").when(F.col("p"), "quality_rejected").otherwise("no_valid_candidate")
    return j.select("request", "selected", why.alias("reason"))


def finalised(cands: DataFrame, order: list, most: int = PICKS) -> DataFrame:
    """(request, cand, place): the first ``most`` passed candidates of each request in order, no two of one text, none that says
    no more than its source (blanks and full stops aside).
    """
    bare = lambda c: F.regexp_replace(c, r"[\s。！？!?]+", "")
    ok = cands.filter((F.col("verdict") == "passed") & (bare(F.col("source")) != bare(F.col("text"))))
    key = F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])
    one = ok.groupBy("request", F.sha2("text", 256).alias("fp")).agg(F.min(key).alias("o"))
    w = Window.partitionBy("request").orderBy("o")
    return one.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("request", F.col("o.cand").alias("cand"), "place")


def replay_chain(runs: DataFrame, depth: int = 20) -> DataFrame:
    """(id, steps, intact): for runs (id, parent, parent_hash, hash), how many parents lead back, ``depth`` at most, and whether
    each hash recorded for a parent is the parent's own. A run without parent is intact; a missing parent or a chain longer than
    ``depth`` is not.
    """
    own = runs.select(F.col("id").alias("__p"), F.col("hash").alias("__h"), F.col("parent").alias("__gp"), F.col("parent_hash").alias("__gh"))
    now = runs.select("id", F.col("parent").alias("at"), F.col("parent_hash").alias("want"), F.lit(0).alias("steps"), F.lit(True).alias("intact"))
    done = now.filter("at is null")
    now = now.filter("at is not null")
    for _ in range(depth):
        j = now.join(own, now["at"] == own["__p"], "left")
        ok = F.col("intact") & F.coalesce(F.col("__h") == F.col("want"), F.lit(False))
        step = materialize(j.select("id", F.col("__gp").alias("at"), F.col("__gh").alias("want"), (F.col("steps") + 1).alias("steps"), ok.alias("intact"), F.col("__p").isNull().alias("gone")), "replay")
        done = done.unionByName(step.filter("at is null or gone or not intact").select("id", "at", "want", "steps", "intact"))
        now = step.filter("at is not null and not gone and intact").drop("gone")
        if now.isEmpty():
            break
    return done.unionByName(now.withColumn("intact", F.lit(False))).select("id", "steps", "intact")
