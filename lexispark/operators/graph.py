"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.operators.skew import lookup_join
from lexispark.session import discard, materialize, releasing


def entity_edges(df: DataFrame, node: str, entities: list) -> DataFrame:
    """Edges (a, b) that join every record with the least record that shares one of its entities.

    ``entities`` are columns (expressions); a null entity joins nothing. An entity held by n records gives n - 1 edges,
    never n squared. A hot entity is no hot task: its least record is found by a pre-aggregated minimum, and the rows of
    entities that hold a thousandth of them or more meet it by broadcast.
    """
    names = [f"e{i}" for i in range(len(entities))]
    flat = df.select(F.col(node).alias("n"), *[c.cast("string").alias(k) for c, k in zip(entities, names)])
    pairs = flat.select(
        "n", F.explode(F.array(*[F.when(F.col(k).isNotNull(), F.sha2(F.concat(F.lit(f"{k}:"), F.col(k)), 256)) for k in names])).alias("e")
    ).filter(F.col("n").isNotNull() & F.col("e").isNotNull())
    least = pairs.groupBy("e").agg(F.min("n").alias("m"), F.max("n").alias("x"), F.count(F.lit(1)).alias("size")).filter("m < x").drop("x")
    met = lookup_join(pairs, materialize(least, "entities"), "e", "size")
    return met.filter(F.col("n") != F.col("m")).select(F.col("n").alias("a"), F.col("m").alias("b")).distinct()


def _minima(edges: DataFrame) -> DataFrame:
    """(u, m, size): the least of each node and its neighbours, and its degree."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("size")).select("u", F.least("u", "m").alias("m"), "size")


def _meet(edges: DataFrame, hub: bool) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) with the minimum m of their node u, and the minima. With a ``hub`` centres of many edges meet theirs by
    broadcast, for which the minima are written first.
    """
    if not hub:
        least = _minima(edges)
        return edges.join(least.drop("size"), "u"), least
    least = materialize(_minima(edges), "minima")
    return lookup_join(edges, least, "u", "size"), least


def _large_star(edges: DataFrame, hub: bool) -> tuple[DataFrame, DataFrame]:
    """The star of every node's larger neighbours around the least node near it, and a table to discard when it was read."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    met, least = _meet(both, hub)
    return met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), least


def _small_star(edges: DataFrame, hub: bool) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    met, least = _meet(down, hub)
    return (
        met.select(F.col("v").alias("a"), F.col("m").alias("b"))
        .unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        .filter("a <> b").distinct()
    ), least


def _state(edges: DataFrame) -> tuple:
    """Edge count and an order-free checksum; equal states before and after a round mean a fixpoint."""
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


#: Edges at one node from which on it is looked at more closely whether it is hot.
HUB = 2000


def _has_hub(edges: DataFrame) -> bool:
    ends = edges.select(F.explode(F.array("a", "b")).alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    return (ends.agg(F.max("n")).first()[0] or 0) >= HUB


@releasing
def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b); component is the least node joined to it.

    Alternates large-star and small-star until nothing changes; every round is written to the shared folder, so a lost
    executor costs at most one round. Loops and repeated edges do no harm; an empty input gives an empty result. Nodes
    may be of any ordered type. Nulls are dropped.
    """
    if set(edges.columns) != {"a", "b"}:
        raise ValueError("edges must have the columns a and b")
    now = materialize(edges.filter("a is not null and b is not null and a <> b").distinct(), "cc")
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        hub = _has_hub(now)
        large, used = _large_star(now, hub)
        # between the stars only a hub's minima, which are looked at first, make a table worth its while
        wide = materialize(large, "cc") if hub else large
        small, more = _small_star(wide, hub)
        before, now = now, materialize(small, "cc")
        for t in (used, wide, more, before):
            discard(t)
        after = _state(now)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("components did not settle")
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
