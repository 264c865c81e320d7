"""Mixing sources to target weights by weighted fair queueing.

Every source is shuffled by hash. A text's virtual finish time is the number of its source's tokens up to and with it,
over the source's target weight; the mix is the global order by finish time, cut at the total budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.tokens import TOKENIZERS, token_counts
from lexispark.operators.skew import running_sum
from lexispark.session import materialize


def tidy_source(c):
    """One spelling per source: lower case, no outer blanks, underscore for hyphen and blank."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[-\s]+", "_")


def candidates(docs: DataFrame, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """(doc_id, mix_source, tokens): one row per distinct text with tokens, under its lowest doc_id.

    A text that several documents hold is one text, so that it isn't used more often than allowed; it belongs to the
    source of its lowest doc_id that has a source. Null and empty texts and documents without a source are left out.
    """
    rows = docs.select("doc_id", "text", tidy_source(F.col("source")).alias("mix_source")).filter("text <> '' and mix_source <> ''")
    first = rows.groupBy(F.sha2("text", 256).alias("fp")).agg(F.min_by(F.struct("doc_id", "mix_source"), "doc_id").alias("r"))
    keep = materialize(first.select("r.*"), "texts")
    texts = docs.select("doc_id", "text").join(keep.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return keep.join(token_counts(texts, tokenizer=tokenizer), "doc_id").filter("tokens > 0")


#: More targets than this are refused: their table is broadcast, and one row for each reaches the driver.
MOST_TARGETS = 100_000


def mix(docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: str = "mix", tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    Mix: finish, mix_source, doc_id, pass (0-based use of the text), tokens, in order of finish. Report: one row per target with
    target_share, reached_share, tokens, available (tokens at most, with repeats), texts, uses. ``budget`` is the total
    in tokens; by default the largest at which every source that has texts reaches its share within max_repeats.
    Sources that aren't in targets are left out; targets without texts reach 0. Targets: mix_source, target_share,
    max_repeats; rows with a null or non-positive share or repeats give nothing.
    """
    goals = targets.select(tidy_source(F.col("mix_source")).alias("mix_source"), "target_share", F.coalesce("max_repeats", F.lit(0)).alias("max_repeats")).distinct()
    wanted = goals.filter("target_share > 0 and max_repeats > 0")
    if wanted.limit(MOST_TARGETS + 1).count() > MOST_TARGETS:
        raise ValueError(f"at most {MOST_TARGETS} targets are possible")
    own = materialize(candidates(docs, tokenizer).join(F.broadcast(wanted), "mix_source"), "candidates")
    sums = own.groupBy("mix_source").agg(F.sum("tokens").alias("size"), F.first("target_share").alias("share"), F.first("max_repeats").alias("most"))
    rows = sums.collect()  # one row per target
    whole = sum(r["share"] for r in rows)
    level = min((r["size"] * r["most"] / r["share"] for r in rows), default=0.0)  # virtual time at which the first source runs dry
    if budget is not None:
        level = min(level, budget / whole) if whole else 0.0
    shuffled = own.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256))
    cum = running_sum(shuffled, ["mix_source"], [F.col("h"), F.col("doc_id")], "tokens", "cum")
    sized = cum.join(F.broadcast(sums.select("mix_source", "size")), "mix_source")
    # how often a text finishes before the cut; only these uses are made, and the next one if the source runs short
    full = F.floor((F.lit(level * (1 + 1e-12)) * F.col("target_share") - F.col("cum")) / F.col("size")) + 1
    timed = materialize(sized.withColumn("uses", F.greatest(F.least(full, F.col("max_repeats")), F.lit(0)).cast("int")), "timed")
    chosen = timed.filter("uses > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)).alias("pass")).select(
        ((F.col("pass") * F.col("size") + F.col("cum")) / F.col("target_share")).alias("finish"), "mix_source", "doc_id", "pass", "tokens"
    )
    spare = timed.filter("uses < max_repeats").select("mix_source", "doc_id", F.col("uses").alias("pass"), "tokens")
    for extra in _top_up(spare, chosen, {r["mix_source"]: level * r["share"] for r in rows}):
        chosen = chosen.unionByName(extra.withColumn("finish", F.lit(level)))
    ordered = chosen.orderBy("finish", "mix_source", "doc_id", "pass")
    reached = chosen.groupBy("mix_source").agg(F.sum("tokens").alias("tokens"), F.count_distinct("doc_id").alias("texts"), F.count(F.lit(1)).alias("uses"))
    total = F.lit(float(chosen.agg(F.sum("tokens")).first()[0] or 1))
    report = goals.join(reached, "mix_source", "left").join(sums.select("mix_source", (F.col("size") * F.col("most")).alias("available")), "mix_source", "left").select(
        "mix_source", "target_share", "max_repeats", (F.coalesce("tokens", F.lit(0)) / total).alias("reached_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("uses", F.lit(0)).alias("uses"),
    )
    return ordered, report


def _top_up(spare: DataFrame, chosen: DataFrame, goal: dict[str, float], rounds: int = 6) -> list[DataFrame]:
    """Where a long text at the cut leaves a source short, spare uses (the next of each text) that fill what is missing: in
    each round the largest that fits, in the last the one that comes nearest. One row per source and round reaches the driver.
    """
    spark = chosen.sparkSession
    have = {r[0]: r[1] for r in chosen.groupBy("mix_source").agg(F.sum("tokens")).collect()}
    lack = {s: g - (have.get(s) or 0) for s, g in goal.items() if g > (have.get(s) or 0)}
    taken: list = []
    for i in range(rounds):
        if not lack:
            break
        need = F.broadcast(spark.createDataFrame(list(lack.items()), "mix_source string, lack double"))
        used = F.broadcast(spark.createDataFrame(taken or [], "mix_source string, doc_id bigint, pass int, tokens bigint"))
        free = spare.join(used.drop("tokens"), ["mix_source", "doc_id", "pass"], "left_anti").join(need, "mix_source")
        last = i == rounds - 1
        fits = free if last else free.filter(F.col("tokens") <= F.col("lack"))
        near = F.struct(F.abs(F.col("tokens") - F.col("lack")), "doc_id", "pass")
        best = fits.groupBy("mix_source").agg(F.min_by(F.struct("doc_id", "pass", "tokens"), near).alias("b")).select("mix_source", "b.*").collect()
        new = [tuple(r) for r in best if abs(r["tokens"] - lack[r["mix_source"]]) < lack[r["mix_source"]]]
        taken += new
        for s, _, _, t in new:
            lack[s] -= t
    return [spark.createDataFrame(taken, "mix_source string, doc_id bigint, pass int, tokens bigint")] if taken else []
