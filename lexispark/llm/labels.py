"""Consensus from several annotators' labels: confidence-aware truth discovery.

Every item is a (comparison, dimension). An annotator's error is not their observed mean label distance but its upper
bound: the summed distance over the chi-squared quantile at ``alpha / 2`` for their number of votes. Few votes make the
bound wide and the vote weak, which keeps the long tail of contributors from deciding items. Truths and bounds are
recomputed in turn until the bounds settle. The truth of an item is the choice of least weighted distance: the sum of the
weights of the votes for other choices, with 0-1 distance.

With ``habits`` an annotator's weight depends on the choice voted for. It is the log-odds that the vote speaks for its
choice: an annotator of error e answers the truth with 1 - e and else by habit, h(choice). The habit comes from the votes
that miss the current truths, so one who answers ``tie`` to everything gains little weight for ``tie`` although they are
often right on ties; a prior of the choices counts as one more vote. Without, the weight is one over the bound, the same for
all their votes.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.session import discard, materialize, partitions

CHOICES = ("left", "right", "tie", "both_bad")
ABSTAIN = "cannot_judge"
#: The annotators' figures travel to the driver and back by broadcast only while there are no more than this; a larger
#: pool is joined by shuffle.
POOL_LIMIT = 100_000
KEY = ["comparisonid", "dimension"]


def answers(prefs: DataFrame) -> DataFrame:
    """The answer that counts of each annotator to each item: (comparisonid, dimension, annotatorid, choice).

    Rows without annotatorid or choice, or with a blank or unknown choice, are no answers. The highest revision counts
    (null: lowest); repeats of one revision are settled by the latest saved_at, received_at, then choice. Case and outer
    blanks of choice are ignored. A null comparisonid or dimension is a value like any other. Other columns are ignored.
    """
    choice = F.lower(F.trim("choice"))
    rank = F.struct(F.coalesce("revision", F.lit(-1)).alias("r"), F.col("saved_at").alias("s"), F.col("received_at").alias("x"), choice.alias("c"))
    rows = prefs.filter(F.col("annotatorid").isNotNull() & choice.isin(*CHOICES, ABSTAIN))
    best = rows.select(*KEY, "annotatorid", rank.alias("rank")).groupBy(*KEY, "annotatorid").agg(F.max("rank").alias("rank"))
    return best.select(*KEY, "annotatorid", F.col("rank.c").alias("choice"))


def chi2_quantile(p: float, n):
    """Wilson-Hilferty approximation of the chi-squared quantile, as a column of n."""
    z = NormalDist().inv_cdf(p)
    n = F.greatest(n.cast("double"), F.lit(1.0))
    base = 1 - F.lit(2.0) / (9 * n) + F.lit(z) * F.sqrt(F.lit(2.0) / (9 * n))
    return n * F.pow(F.greatest(base, F.lit(0.0)), F.lit(3.0)) + F.lit(1e-6)


def _sum(cols):
    return sum(cols[1:], cols[0])


def _weighted(votes: DataFrame, params: DataFrame, habits: bool) -> DataFrame:
    """votes with l, the weight of each."""
    own = F.element_at(F.array(*[f"h{i}" for i in range(len(CHOICES))]), F.col("k") + 1)
    strength = F.log(((1 - F.col("e")) + F.col("e") * own) / (F.col("e") * own)) if habits else 1 / F.col("e")
    return votes.join(params, "annotatorid").withColumn("l", strength)


def _shares(df: DataFrame, prior: list[float], habits: bool) -> DataFrame:
    """df with p0..p3, the shares of the choices, of the weights s0..s3."""
    k = range(len(CHOICES))
    if not habits:
        total = _sum([F.col(f"s{i}") for i in k])
        return df.withColumns({f"p{i}": F.col(f"s{i}") / total for i in k})
    df = df.withColumns({f"s{i}": F.col(f"s{i}") + F.lit(prior[i]) for i in k}).withColumn("top", F.greatest(*[f"s{i}" for i in k]))
    z = _sum([F.exp(F.col(f"s{i}") - F.col("top")) for i in k])
    return df.withColumns({f"p{i}": F.exp(F.col(f"s{i}") - F.col("top")) / z for i in k})


def _scored(votes: tuple[DataFrame, DataFrame | None], params: DataFrame, prior: list[float], habits: bool) -> DataFrame:
    """votes (of usual and of crowded items) with p0..p3, the shares of the choices of the vote's item, and nv, its votes."""
    usual, crowded = votes
    item = Window.partitionBy(*KEY)
    mine = [F.when(F.col("k") == i, F.col("l")).otherwise(0.0) for i in range(len(CHOICES))]
    df = _weighted(usual, params, habits).withColumns({f"s{i}": F.sum(c).over(item) for i, c in enumerate(mine)} | {"nv": F.count(F.lit(1)).over(item)})
    df = _shares(df, prior, habits)
    if crowded is None:
        return df
    many = _weighted(crowded, params, habits)
    # pre-aggregated; at most CROWDED items, so the sums may be broadcast
    sums = many.groupBy(*KEY).agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(mine)], F.count(F.lit(1)).alias("nv"))
    a, b = many.alias("a"), F.broadcast(_shares(sums, prior, habits)).alias("b")
    met = a.join(b, F.col("a.comparisonid").eqNullSafe(F.col("b.comparisonid")) & F.col("a.dimension").eqNullSafe(F.col("b.dimension")))
    names = [c for c in df.columns if c not in many.columns]
    return df.unionByName(met.select(*[f"a.{c}" for c in many.columns], *[f"b.{c}" for c in names]))


#: Items with 1/CROWDED of all votes or more, and CROWD votes at least, are summed up before they meet their votes.
CROWDED, CROWD = 1000, 100_000


def _parted(votes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Votes of usual items, exchanged by item once for all rounds, and votes of crowded ones, which stay where they are."""
    sizes = votes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    bar = max(CROWD, votes.count() / CROWDED)
    hot = sizes.filter(F.col("n") >= bar).select(*[F.col(c).alias(f"_{c}") for c in KEY])
    crowded = None
    if not hot.isEmpty():
        on = F.col("comparisonid").eqNullSafe(F.col("_comparisonid")) & F.col("dimension").eqNullSafe(F.col("_dimension"))
        crowded = materialize(votes.join(F.broadcast(hot), on, "left_semi"), "crowded")
        votes = votes.join(F.broadcast(hot), on, "left_anti")
    # a persisted table keeps its partitioning, and a lost part is read again from the file
    return votes.repartition(partitions(votes.sparkSession), *KEY).persist(StorageLevel.MEMORY_AND_DISK), crowded


def discover(prefs: DataFrame, alpha: float = 0.3, rounds: int = 10, tol: float = 0.005, least: int = 3, habits: bool = True) -> tuple[DataFrame, DataFrame]:
    """Consensus per item and reliability per annotator.

    Items: comparisonid, dimension, choice, support (share of the choice), agreement (share of the pairs of votes that
    agree), votes; only items with at least ``least`` votes other than abstentions. Equal support goes to the choice
    named first in CHOICES. Annotators: annotatorid, votes, error (its upper bound), weight (log-odds of a vote of
    average habit), reliability (1 - mean distance to the truths). ``habits``: see above. An empty input gives empty tables.
    """
    spark, k = prefs.sparkSession, range(len(CHOICES))
    code = F.create_map(*[x for i, c in enumerate(CHOICES) for x in (F.lit(c), F.lit(i))])
    votes = materialize(answers(prefs).filter(F.col("choice") != ABSTAIN).select(*KEY, "annotatorid", code[F.col("choice")].alias("k")), "votes")
    params = votes.select("annotatorid").distinct().select(
        "annotatorid", F.lit(0.4).alias("e"), *[F.lit(1.0 / len(CHOICES)).alias(f"h{i}") for i in k], F.lit(0.0).alias("d"), F.lit(0).cast("bigint").alias("n")
    )
    votes = _parted(votes)
    stats = None
    prior, last = [0.0] * len(CHOICES), None
    for _ in range(rounds):
        params, rows = _place(params)
        if rows is None:
            # the largest change is taken where the figures lie
            change = None if last is None else params.join(last, "annotatorid").agg(F.max(F.abs(F.col("e") - F.col("was")))).first()[0]
            last = params.select("annotatorid", F.col("e").alias("was"))
        else:
            now = {r["annotatorid"]: r["e"] for r in rows}
            if not now:
                break
            change = None if last is None else max(abs(e - last[a]) for a, e in now.items())
            last = now
        if change is not None and change < tol:
            break
        scored = _scored(votes, params, prior, habits).withColumn("d", 1 - F.element_at(F.array(*[f"p{i}" for i in k]), F.col("k") + 1))
        past, stats = stats, materialize(
            scored.groupBy("annotatorid").agg(
                F.count(F.lit(1)).alias("n"), F.sum("d").alias("d"),
                *[F.sum(F.when(F.col("k") == i, F.col("d")).otherwise(0.0)).alias(f"w{i}") for i in k],
                *[F.sum(F.col(f"p{i}") / F.col("nv")).alias(f"q{i}") for i in k],
            ), "stats",
        )
        if past is not None:
            discard(past)
        share = stats.agg(*[F.sum(f"q{i}").alias(f"q{i}") for i in k]).first()
        total = sum(share) or 1.0
        pi = [x / total for x in share]
        prior = [float(math.log(max(p, 1e-6))) for p in pi]
        miss = (F.col("d") + 0.02) / chi2_quantile(alpha / 2, F.col("n"))
        wrong = _sum([F.col(f"w{i}") for i in k])
        habit = [(F.col(f"w{i}") + 1.0) / (wrong + len(CHOICES)) for i in k]
        hit = _sum([h * F.lit(p) for h, p in zip(habit, pi)])
        error = F.least(F.greatest(miss / F.greatest(1 - hit, F.lit(0.2)), F.lit(0.02)), F.lit(0.97)) if habits else F.greatest(miss, F.lit(0.02))
        params = stats.select("annotatorid", error.alias("e"), *[h.alias(f"h{i}") for i, h in enumerate(habit)], "d", "n")
    else:
        params, _ = _place(params)
    best = F.greatest(*[f"p{i}" for i in k])
    pick = F.coalesce(*[F.when(F.col(f"p{i}") == F.col("best"), F.lit(c)) for i, c in enumerate(CHOICES)])
    by_item = _scored(votes, params, prior, habits).groupBy(*KEY).agg(
        *[F.max(f"p{i}").alias(f"p{i}") for i in k], *[F.sum(F.when(F.col("k") == i, 1).otherwise(0)).alias(f"n{i}") for i in k], F.count(F.lit(1)).alias("votes")
    )
    pairs = _sum([F.col(f"n{i}") * (F.col(f"n{i}") - 1) for i in k])
    items = by_item.filter(F.col("votes") >= least).withColumn("best", best).select(
        *KEY, pick.alias("choice"), F.col("best").alias("support"), (pairs / (F.col("votes") * (F.col("votes") - 1))).alias("agreement"), "votes"
    )
    people = params.select(
        "annotatorid", F.col("n").alias("votes"), F.col("e").alias("error"),
        F.log((1 - F.col("e") * 0.75) / (F.col("e") * 0.25)).alias("weight"), (1 - F.try_divide("d", "n")).alias("reliability"),
    )
    return items, people


def _place(params: DataFrame) -> tuple[DataFrame, list | None]:
    """The annotators' figures as a local table to broadcast, with its rows, or past POOL_LIMIT as a written table."""
    rows = params.limit(POOL_LIMIT + 1).collect()
    if len(rows) > POOL_LIMIT:
        return materialize(params, "annotators"), None
    return F.broadcast(params.sparkSession.createDataFrame(rows, params.schema)), rows
