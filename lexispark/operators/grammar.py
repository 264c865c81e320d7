"""Template grammars as tables: evidence gates, hash-ordered draws, segment orders, and bindings of constructions.

Random choices of a generator become hash orders, so a draw depends on its seed and row only, not on partitioning.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def evidenced(templates: DataFrame, texts: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """templates with support: the number of texts (of the template's own ``by``, if given) that hold its ``evidence``.

    Templates are a table of bounded size (a grammar is written by hand), so their phrases are broadcast and texts are scanned once.
    """
    t = F.broadcast(templates.select("template", "evidence", *([by] if by else [])).distinct())
    x = texts.select(F.col(column).alias("__text"), *([F.col(by).alias("__by")] if by else []))
    on = F.contains(F.col("__text"), F.col("evidence"))
    if by:
        on = on & (F.col("__by") == F.col(by))
    n = x.join(t, on).groupBy("template").agg(F.count(F.lit(1)).alias("support"))
    return templates.join(n, "template", "left").withColumn("support", F.coalesce("support", F.lit(0)))


def drawn(options: DataFrame, group: list[str], option: list[str], k: int, seed: str) -> DataFrame:
    """The first k options of each group in the order of a seeded hash of group and option, with turn from 1."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in [*group, *option]]), 256)
    w = Window.partitionBy(*group).orderBy(h, *option)
    return options.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= k)


def filled(template: Column, slots: dict[str, Column]) -> Column:
    """A template with {name} replaced by each slot; a null slot makes the text null."""
    for k, v in slots.items():
        template = F.replace(template, F.lit("{" + k + "}"), v)
    return template


def ordered(segments: DataFrame, key: str, role: str, n: str, ranks: dict[str, dict[str, int]]) -> DataFrame:
    """(key, plan, n, place): the segments of a text in the order of each plan: by the rank of their role (those without a rank
    last), then as they stand.
    """
    plans = F.array(*[F.struct(F.lit(p).alias("plan"), F.coalesce(*[F.when(F.col(role) == r, i) for r, i in rank.items()], F.lit(99)).alias("rank")) for p, rank in ranks.items()])
    x = segments.select(key, n, F.explode(plans).alias("p")).select(key, n, "p.plan", "p.rank")
    return x.withColumn("place", F.row_number().over(Window.partitionBy(key, "plan").orderBy("rank", n))).select(key, "plan", n, "place")


def bound(texts: DataFrame, key: list[str], column: str, constructions: list[tuple[str, str, str]]) -> DataFrame:
    """(key..., construction, a, b, text): every construction (id, pattern of two groups, template of {a} and {b}) that fits."""
    c = F.col(column)
    fits = [F.when(c.rlike(p), F.struct(F.lit(i).alias("construction"), F.regexp_extract(c, p, 1).alias("a"), F.regexp_extract(c, p, 2).alias("b"), F.lit(t).alias("t"))) for i, p, t in constructions]
    x = texts.select(*key, F.explode(F.array_compact(F.array(*fits))).alias("z")).select(*key, "z.*")
    return x.select(*key, "construction", "a", "b", filled(F.col("t"), {"a": F.col("a"), "b": F.col("b")}).alias("text"))


def without_conflicts(plans: DataFrame, edits: DataFrame, key: list[str]) -> DataFrame:
    """plans (key..., plan, start, end) times the edits (key..., edit, start, end) of the same text, less those that overlap the plan's own
    stretch; one row per pair.
    """
    e = edits.select(*key, "edit", F.col("start").alias("es"), F.col("end").alias("ee"))
    return plans.join(e, key).filter((F.col("ee") <= F.col("start")) | (F.col("es") >= F.col("end"))).select(*key, "plan", "edit")


def chunked(rows: DataFrame, group: list[str], order: list[str], size: str, most: int) -> DataFrame:
    """rows with chunk, from 0: within each group, in order, a row goes to the current chunk if it still fits into ``most``, else it
    begins the next. The fold is sequential, so a group is in one task; groups are files of bounded size.
    """
    fields = StructType([*rows.schema.fields, StructField("chunk", IntegerType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out, used, n = [], 0, 0
        for s in pdf[size]:
            if used and used + s > most:
                n, used = n + 1, 0
            used += s
            out.append(n)
        return pdf.assign(chunk=pd.Series(out, index=pdf.index, dtype="int32"))

    return rows.groupBy(*group).applyInPandas(run, fields)
