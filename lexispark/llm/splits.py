"""Splits that keep related records together.

Records that share an author, post, group or source text are joined into components by large-star small-star; a
component gets one split, by the hash of its identifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.operators.graph import connected_components, entity_edges
from lexispark.session import materialize

#: Components of at least 1/LARGE of the records are placed one by one; there are never more than LARGE of them.
LARGE = 500


def _untidy(c: str):
    return F.lower(F.trim(F.col(c)))


def components(comparisons: DataFrame) -> DataFrame:
    """(comparisonid, component) of every distinct non-null comparisonid.

    Two records belong together if they share a non-null authorid, postid or private.group (case and outer blanks
    ignored) or the same source text, or are joined through others; rows of one comparisonid are one record. Blank ids
    are ids like others. A record that shares nothing is a component of its own, named by itself.
    """
    edges = entity_edges(comparisons, "comparisonid", [_untidy("authorid"), _untidy("postid"), _untidy("private.group"), F.col("source")])
    joined = connected_components(edges)
    ids = comparisons.select("comparisonid").filter(F.col("comparisonid").isNotNull()).distinct()
    return ids.join(joined.withColumnRenamed("node", "comparisonid"), "comparisonid", "left").select(
        "comparisonid", F.coalesce("component", "comparisonid").alias("component")
    )


def broken(comparisons: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(comparisonid) of every record of a component whose recorded non-null splits differ."""
    parts = components(comparisons) if parts is None else parts
    said = comparisons.select("comparisonid", F.col("private.split").alias("split")).filter("split is not null")
    torn = said.join(parts, "comparisonid").groupBy("component").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).filter("lo <> hi")
    return parts.join(torn.select("component"), "component", "left_semi").select("comparisonid")


def assign(comparisons: DataFrame, targets: DataFrame, seed: str = "split", balance: bool = True) -> DataFrame:
    """(comparisonid, component, split) with one split per component and shares near ``targets`` (split, target_share).

    With ``balance`` components of at least 1/LARGE of the records, at most LARGE, go to the split with most room left,
    largest first; the rest go by sha-256 of the component identifier into ranges in proportion to the room that remains. So
    the same records get the same split on every run. Without it all go by the hash into ranges in proportion to the targets:
    then new records move no component that they do not join, but one giant component may leave the shares far from the
    targets. Targets with a null or non-positive share get nothing.
    """
    spark = comparisons.sparkSession
    parts = materialize(components(comparisons), "components")
    goal = {r["split"]: float(r["target_share"]) for r in targets.select("split", "target_share").distinct().limit(1001).collect() if r["split"] is not None and (r["target_share"] or 0) > 0}
    if not goal or len(goal) > 1000:
        raise ValueError("between 1 and 1000 splits with a positive share are needed")
    total = parts.count()
    names = sorted(goal)
    room = {s: total * goal[s] / sum(goal.values()) for s in names}
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.filter(F.col("n") >= max(2, total / LARGE)).orderBy(F.desc("n"), "component").collect() if total and balance else []
    placed = {}
    for r in large:
        best = max(names, key=lambda s: room[s])
        placed[r["component"]] = best
        room[best] -= r["n"]
    left = {s: max(room[s], 0.0) for s in names}
    whole = sum(left.values()) or 1.0
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("component").cast("string")), 256), 1, 13), 16, 10).cast("double") / float(16**13)
    by_hash, edge = F.lit(names[-1]), 1.0
    for s in reversed(names):
        edge -= left[s] / whole
        by_hash = by_hash if s == names[-1] else F.when(u < edge + left[s] / whole, s).otherwise(by_hash)
    fixed = spark.createDataFrame(list(placed.items()) or [], "component string, fixed string")
    return parts.join(F.broadcast(fixed), "component", "left").select("comparisonid", "component", F.coalesce("fixed", by_hash).alias("split"))
