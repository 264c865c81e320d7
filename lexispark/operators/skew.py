"""Joins and running sums that keep one hot key from becoming one long task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.session import materialize, partitions

#: A key is hot when it holds at least 1/HOT_SHARE of the rows; so there are never more than HOT_SHARE hot keys.
HOT_SHARE = 1000
TASKS_PER_CORE = 8


def hot_rows(lookup: DataFrame, weight: str, share: int = HOT_SHARE, least: int = 2000) -> DataFrame | None:
    """The rows of lookup whose weight is at least 1/share of the total weight.

    By construction at most ``share`` rows qualify, so the result may be broadcast. None if there are none.
    """
    total, most = lookup.agg(F.sum(weight), F.max(weight)).first()
    bar = max(least, (total or 0) / share)
    return lookup.filter(F.col(weight) >= bar) if (most or 0) >= bar else None


def lookup_join(left: DataFrame, lookup: DataFrame, key: str, weight: str, share: int = HOT_SHARE) -> DataFrame:
    """Inner join of left with a lookup that has one row per key and, in ``weight``, the rows of left with that key.

    Hot keys (at most ``share``) are joined by broadcast and never shuffled by key; the others by a shuffle join.
    Null keys match nothing, as in SQL.
    """
    value = lookup.drop(weight)
    hot = hot_rows(lookup, weight, share)
    if hot is None:
        return left.join(value, key)
    hot = hot.drop(weight)
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(
        value.join(F.broadcast(hot.select(key)), key, "left_anti"), key
    )
    return left.join(F.broadcast(hot), key).unionByName(cold)


def running(df: DataFrame, group: list[str], order: list, value: str, out: str, fold: str = "sum", before: bool = False, rows_per_task: int = 50_000) -> DataFrame:
    """Running sum or max of ``value`` within ``group`` in ``order``, without a task that holds a whole group.

    Rows are range-sorted over the whole table, cut at partition borders, folded per (partition, group), and each partition
    adds what its group has in earlier partitions. The table of partition folds has one row per partition and group. With
    ``before`` the row itself is left out; the first row of a group then has 0 (sum) or null (max). Null values count as 0
    in sums; rows with equal order columns follow each other in no defined order.
    """
    spark = df.sparkSession
    # more parts than a few for each core would only add to the table of folds
    most = TASKS_PER_CORE * max(spark.sparkContext.defaultParallelism, partitions(spark))
    parts = min(max(1, -(-df.count() // rows_per_task)), most)
    keys = [*[F.col(g) for g in group], *order]
    sorted_ = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    cut = materialize(sorted_.withColumn("__part", F.spark_partition_id()).withColumn("__seq", F.monotonically_increasing_id()), "prefix")
    f, v = (F.sum, F.coalesce(F.col(value), F.lit(0))) if fold == "sum" else (F.max, F.col(value))
    folds = cut.groupBy(*group, "__part").agg(f(v).alias("__fold"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = folds.withColumn("__off", f("__fold").over(earlier)).drop("__fold")
    within = Window.partitionBy("__part", *group).orderBy("__seq").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    on = F.lit(True)
    for c in [*group, "__part"]:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = cut.withColumn("__run", f(v).over(within)).alias("a").join(offsets.alias("b"), on, "left")
    run, off = F.col("a.__run"), F.col("b.__off")
    result = F.coalesce(run, F.lit(0)) + F.coalesce(off, F.lit(0)) if fold == "sum" else F.greatest(run, off)
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], result.alias(out))


def running_sum(df: DataFrame, group: list[str], order: list, value: str, out: str, rows_per_task: int = 50_000) -> DataFrame:
    return running(df, group, order, value, out, rows_per_task=rows_per_task)
