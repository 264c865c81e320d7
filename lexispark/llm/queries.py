"""The queries of the training-data operators. Each takes (spark, sf_dir) and runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm import labels, lookalikes, mixing, mojibake, sentences, splits, subjects, tokens
from lexispark.session import materialize, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restore(table(spark, d, "posts"), table(spark, d, "sections")).select("tbl", "rec_id").distinct()


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restore(table(spark, d, "posts"), table(spark, d, "sections"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return labels.discover(table(spark, d, "preferences"))[0].select("comparisonid", "dimension", "choice")


def p2_items(spark: SparkSession, d: str) -> DataFrame:
    return labels.discover(table(spark, d, "preferences"))[0]


def p2_plain(spark: SparkSession, d: str) -> DataFrame:
    return labels.discover(table(spark, d, "preferences"), habits=False)[0]


def p2_annotators(spark: SparkSession, d: str) -> DataFrame:
    return labels.discover(table(spark, d, "preferences"))[1]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.broken(table(spark, d, "comparisons"))


def p3_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign(table(spark, d, "comparisons"), table(spark, d, "split_targets"))


def p3_hashed(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign(table(spark, d, "comparisons"), table(spark, d, "split_targets"), balance=False)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    posts, captures = table(spark, d, "posts"), table(spark, d, "ginza_discourse_modesty")
    cases = materialize(mojibake.cases(posts, None), "cases")
    return sentences.split(sentences.corpus(posts, captures).join(cases, ["tbl", "rec_id"], "left_anti")).select("tbl", "rec_id", "start_at").distinct()


def p4_spans(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split(sentences.corpus(table(spark, d, "posts"), table(spark, d, "ginza_discourse_modesty"))).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.same_looking(table(spark, d, "posts"))


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.normal_forms(table(spark, d, "posts"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.classes(table(spark, d, "posts"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p6_text(spark: SparkSession, d: str) -> DataFrame:
    return tokens.decode(tokens.encode(table(spark, d, "documents")))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.classify(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subject_areas")).select("doc_id", "subject")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(table(spark, d, "documents"), p8_found(spark, d))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_restored, p2_found, p2_items, p2_plain, p2_annotators, p3_found, p3_split, p3_hashed, p4_found, p4_spans, p5_found, p5_forms, p5_classes, p6_ids, p6_text, p7_mix, p7_shares, p8_found, p8_shares)}


def oracle_sql() -> dict[str, str]:
    return {}
