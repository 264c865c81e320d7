"""Window-shaped operators: forward fill, transitions, caps per group, sessions, latest versions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def forward_fill(df: DataFrame, group: list[str], order: list, column: str, out: str) -> DataFrame:
    """The last non-null value up to each row."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(column, ignorenulls=True).over(w))


def transitions(df: DataFrame, group: list[str], order: list, column: str) -> DataFrame:
    """(from_value, to_value, n): neighbours after dropping immediate repeats, counted over all groups."""
    w = Window.partitionBy(*group).orderBy(*order)
    kept = df.withColumn("__p", F.lag(column).over(w)).filter(F.col("__p").isNull() | (F.col("__p") != F.col(column)))
    pairs = kept.withColumn("to_value", F.lead(column).over(w)).filter("to_value is not null")
    return pairs.groupBy(F.col(column).alias("from_value"), "to_value").agg(F.count(F.lit(1)).alias("n"))


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row per key by the order columns, by a pre-aggregating maximum rather than a window over the key."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def sessions(df: DataFrame, user: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """(user, session_start, session_end, n): a session ends after a gap without events."""
    return df.groupBy(F.col(user), F.session_window(ts, gap).alias("__w")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("session_end")).select(
        user, F.col("__w.start").alias("session_start"), "session_end", "n"
    )


def capped(df: DataFrame, caps: list[tuple[list[str], int]], order: list) -> DataFrame:
    """Row caps of nested groups, inner first: at most k rows of each group in order. Equals the greedy loop when each inner
    group lies in one outer group.
    """
    for group, k in caps:
        df = df.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("__r") <= k).drop("__r")
    return df


def inversions(df: DataFrame, group: str, position: str, value: str) -> DataFrame:
    """(group, n, inversions, ratio): pairs i < j whose values fall, over all pairs. Counted by merging, in n log n; a group, such
    as the sentences of one text, is in one task.
    """
    kind = dict(df.dtypes)[group]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pd.factorize(pdf.sort_values(["p", "v"])["v"], sort=True)[0].astype(np.int64)
        return pd.DataFrame({group: pdf[group].iloc[:1], "n": [len(v)], "inversions": [_falls(v)]})

    g = df.select(group, F.col(position).alias("p"), F.col(value).alias("v")).groupBy(group).applyInPandas(run, f"{group} {kind}, n bigint, inversions bigint")
    return g.withColumn("ratio", F.when(F.col("n") > 1, F.col("inversions") / (F.col("n") * (F.col("n") - 1) / 2)))


def _falls(v: np.ndarray) -> int:
    """Pairs i < j with v[i] > v[j], by doubling sorted runs: each run's elements are placed among those of the run before it."""
    n, width, total = len(v), 1, 0
    a = v.copy()
    base = int(a.max()) + 1 if n else 1
    while width < n:
        block = np.arange(n) // (2 * width)
        right = (np.arange(n) // width) % 2 == 1
        # left runs, keyed by their block, are sorted as one array; those above an element lie between it and its block's end
        keys = block * base + a
        left = keys[~right]
        ends = np.searchsorted(left, (block[right] + 1) * base, side="left")
        total += int((ends - np.searchsorted(left, keys[right], side="right")).sum())
        a = np.sort(keys, kind="stable") - block * base
        width *= 2
    return total
