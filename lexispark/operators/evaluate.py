"""Checks, scores and statistics for comparing texts and judging results. Unknown (null) is never counted as 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions import text as T
from lexispark.operators.skew import running
from lexispark.session import materialize


def status_fold(checks: DataFrame, key: str) -> DataFrame:
    """(key, verdict): required fail → rejected; else required unknown → needs_review; else passed. Optional checks don't count."""
    need = F.col("required")
    bad = F.coalesce(F.bool_or(need & (F.col("status") == "fail")), F.lit(False))
    open_ = F.coalesce(F.bool_or(need & ((F.col("status") == "unknown") | F.col("status").isNull())), F.lit(False))
    return checks.groupBy(key).agg(F.when(bad, "rejected").when(open_, "needs_review").otherwise("passed").alias("verdict"))


def compare_runs(a: DataFrame, b: DataFrame, key: list[str], fields: list[str], group: str) -> DataFrame:
    """(group, n_a, n_b, shared, equal, holds): two runs joined row by row on a key, which includes the group. ``equal`` rows agree
    on all fields, null with null; a group holds if every row is in both runs and equal.
    """
    x = a.select(*key, F.lit(True).alias("ia"), F.struct(*fields).alias("x"))
    y = b.select(*key, F.lit(True).alias("ib"), F.struct(*fields).alias("y"))
    j = x.join(y, key, "full").select(group, F.coalesce("ia", F.lit(False)).alias("ia"), F.coalesce("ib", F.lit(False)).alias("ib"), F.col("x").eqNullSafe(F.col("y")).alias("same"))
    both = F.col("ia") & F.col("ib")
    return j.groupBy(group).agg(F.count_if("ia").alias("n_a"), F.count_if("ib").alias("n_b"), F.count_if(both).alias("shared"), F.count_if(both & F.col("same")).alias("equal"), F.bool_and(both & F.col("same")).alias("holds"))


def mean_if_all(c: Column) -> Column:
    """The mean if every value is known, else null."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """One row (auc): chance that a positive scores above a negative, ties half; by ranks of the distinct scores, no pairs.

    Scores are pre-aggregated, and the running sum goes over distinct scores only. Null if one side is empty.
    """
    by = df.filter(F.col(score).isNotNull()).groupBy(score).agg(F.sum(F.col(positive).cast("bigint")).alias("p"), F.sum((~F.col(positive)).cast("bigint")).alias("q"))
    below = running(materialize(by, "scores"), [], [F.col(score)], "q", "below", before=True)
    won = below.withColumn("w", F.col("p") * (F.col("below") + F.col("q") / 2))
    return won.agg(F.try_divide(F.sum("w"), F.sum("p").cast("double") * F.sum("q")).alias("auc"))


def skyline(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows that no other row beats in both x and y (higher is better, equal rows stay). Nulls never qualify.

    Local skylines first: the largest y per x, then a running maximum over distinct x in range-sorted parts.
    """
    per = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x).agg(F.max(y).alias("__y"))
    front = running(materialize(per, "steps"), [], [F.desc(x)], "__y", "__above", "max", before=True).filter(F.col("__above").isNull() | (F.col("__y") > F.col("__above"))).select(x, F.col("__y").alias(y))
    return df.join(front, [x, y], "left_semi")


def literal_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))))


def guard_codes(a: Column, b: Column) -> Column:
    """Codes of what b changes in the meaning of a: numbers, polarity, future to done, hearsay dropped. Language tables are fixed values."""
    neg = r"ない|なかった|never|not|n’t|nicht|没|안 "
    fut = r"だろう|予定|will |wird |明日"
    said = r"らしい|という|said|says|laut|说|라고"
    return F.array_compact(F.array(
        F.when(F.size(F.array_except(literal_set(a), literal_set(b))) > 0, F.lit("number_lost")),
        F.when(F.size(F.array_except(literal_set(b), literal_set(a))) > 0, F.lit("number_added")),
        F.when(F.pmod(F.regexp_count(a, F.lit(neg)), F.lit(2)) != F.pmod(F.regexp_count(b, F.lit(neg)), F.lit(2)), F.lit("polarity")),
        F.when(a.rlike(fut) & ~b.rlike(fut), F.lit("future_lost")),
        F.when(a.rlike(said) & ~b.rlike(said), F.lit("hearsay_dropped")),
    ))


def retention(a: Column, b: Column, n: int = 3) -> Column:
    """Share of a's n-gram set that b keeps; null for a text without grams."""
    x, y = T.gram_set(a, n), T.gram_set(b, n)
    return F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(x))


def novelty(text: Column, structure: Column, exact: Column) -> Column:
    """Class of a text by its highest similarities to what is known."""
    return F.when(text.isNull(), "undetermined").when(exact | (text > 0.95), "known_quote").when((text > 0.72) | (structure > 0.86), "adaptation").otherwise("candidate_novel")


def linear_score(features: DataFrame, coefficients: DataFrame, key: str, intercept: float = 0.0) -> DataFrame:
    """(key, score): features (key, name, value) times coefficients (name, weight) plus intercept; null without a known feature."""
    return features.join(coefficients, "name").groupBy(key).agg((F.sum(F.col("value") * F.col("weight")) + intercept).alias("score"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (rho): correlation of mean ranks. Ranks are made from counts of distinct values, not by sorting all rows in one task."""
    def ranked(c: str) -> DataFrame:
        n = df.groupBy(c).agg(F.count(F.lit(1)).alias("__n"))
        n = running(materialize(n, "values"), [], [F.col(c)], "__n", "__before", before=True)
        return n.select(c, (F.col("__before") + (F.col("__n") + 1) / 2).alias(f"r_{c}"))

    return df.join(ranked(x), x).join(ranked(y), y).agg(F.corr(f"r_{x}", f"r_{y}").alias("rho"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (ari) of two labelings, from the contingency table."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    ra = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("sa"))
    rb = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("sb"))
    tot = cells.agg(F.sum(two("n")).alias("s"), F.sum("n").alias("n"))
    j = tot.join(F.broadcast(ra)).join(F.broadcast(rb))  # one row each
    expected = F.col("sa") * F.col("sb") / (F.col("n") * (F.col("n") - 1) / 2)
    return j.select(F.try_divide(F.col("s") - expected, (F.col("sa") + F.col("sb")) / 2 - expected).alias("ari"))


def reciprocal_rank(ranked: DataFrame, query: str, relevant: str, rank: str) -> DataFrame:
    """One row (mrr): mean over queries of 1 / rank of the first relevant hit, 0 without one."""
    per = ranked.groupBy(query).agg(F.coalesce(F.max(F.when(F.col(relevant), 1.0 / F.col(rank))), F.lit(0.0)).alias("rr"))
    return per.agg(F.avg("rr").alias("mrr"))
