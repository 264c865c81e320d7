"""Half-open spans [start, end): overlap, containment, tiling, gaps, conflicts, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(a: str, b: str) -> Column:
    """Touching spans do not overlap."""
    return (F.col(f"{a}.start") < F.col(f"{b}.end")) & (F.col(f"{b}.start") < F.col(f"{a}.end"))


def contains(outer: str, inner: str) -> Column:
    return (F.col(f"{outer}.start") <= F.col(f"{inner}.start")) & (F.col(f"{inner}.end") <= F.col(f"{outer}.end"))


def span_join(left: DataFrame, right: DataFrame, key: str, how: str = "overlap", cell: int = 1024) -> DataFrame:
    """left ⋈ right on key where the spans overlap (or left contains right). Columns: those of left as l_*, of right as r_*.

    Spans meet in cells of ``cell`` positions, so that the spans of one very long text are not all compared with each other;
    a pair is kept only in the first cell that both touch.
    """
    l = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    cells = lambda s, e: F.explode(F.sequence(F.floor(s / cell), F.floor(F.greatest(e - 1, s) / cell)))
    l = l.withColumn("cell", cells(F.col("l_start"), F.col("l_end")))
    r = r.withColumn("cell", cells(F.col("r_start"), F.col("r_end")))
    on = (F.col(f"l_{key}") == F.col(f"r_{key}")) & (l["cell"] == r["cell"])
    over = (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end"))
    inside = (F.col("l_start") <= F.col("r_start")) & (F.col("r_end") <= F.col("l_end"))
    first = l["cell"] == F.floor(F.greatest("l_start", "r_start") / cell)
    return l.join(r, on & (over if how == "overlap" else inside) & first).drop("cell")


def tiling(spans: DataFrame, key: str, length: DataFrame) -> DataFrame:
    """(key, tiles): whether the spans cover the text [0, n) exactly once, end to end. ``length``: (key, n)."""
    w = Window.partitionBy(key).orderBy("start", "end")
    s = spans.withColumn("__ok", F.col("start") == F.coalesce(F.lag("end").over(w), F.lit(0)))
    g = s.groupBy(key).agg(F.bool_and("__ok").alias("ok"), F.max("end").alias("last"))
    return length.join(g, key, "left").select(key, F.when(F.col("n") == 0, F.col("ok").isNull()).otherwise(F.coalesce(F.col("ok") & (F.col("last") == F.col("n")), F.lit(False))).alias("tiles"))


def gaps(spans: DataFrame, key: str, length: DataFrame) -> DataFrame:
    """(key, start, end): the parts of [0, n) that no span covers."""
    reach = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    ends = spans.select(key, "start", "end").unionByName(length.select(key, F.col("n").alias("start"), F.col("n").alias("end")))
    return ends.withColumn("from", F.coalesce(F.max("end").over(reach), F.lit(0))).filter(F.col("from") < F.col("start")).select(key, F.col("from").alias("start"), F.col("start").alias("end"))


def conflicts(edits: DataFrame, key: str) -> DataFrame:
    """(key, edit_id): edits that start before an earlier edit ends, or insert where another inserts."""
    w = Window.partitionBy(key).orderBy("start", "end", "edit_id")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    twin = (F.lag("start").over(w) == F.col("start")) & (F.lag("end").over(w) == F.col("end")) & (F.col("start") == F.col("end"))
    return edits.withColumn("__c", (F.col("start") < F.coalesce(before, F.lit(-1))) | F.coalesce(twin, F.lit(False))).filter("__c").select(key, "edit_id")


def render(texts: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """(key, text): each text with its edits (start, end, to) applied; edits must not conflict. Order: start, then end."""
    per = edits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "to"))).alias("e"))
    acc = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    t = F.col("text")
    folded = F.aggregate(
        F.col("e"), acc,
        lambda a, x: F.struct(F.concat(a["out"], F.substring(t, a["at"] + 1, x["start"] - a["at"]), x["to"]).alias("out"), x["end"].cast("int").alias("at")),
        lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))),
    )
    return texts.join(per, key, "left").select(key, F.when(F.col("e").isNull(), t).otherwise(folded).alias("text"))


def output_offsets(edits: DataFrame, key: str) -> DataFrame:
    """edits with out_start: where each edit's text begins in the rendered text."""
    w = Window.partitionBy(key).orderBy("start", "end", "edit_id").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(F.length("to") - (F.col("end") - F.col("start"))).over(w), F.lit(0))
    return edits.withColumn("out_start", F.col("start") + shift)
