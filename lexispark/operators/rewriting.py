"""Rule-based rewriting: dictionaries, greedy span choice, plans, checks by recomputation, and selection of candidates.

The steps that are sequential within one text (longest-match scanning, greedy choice, diverse selection) run on Arrow
batches or per key; all others are DataFrame plans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Literals that no rule may touch.
PROTECTED = re.compile(r"https?://\S+|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|「[^「」]*」|『[^『』]*』")


def scan_dictionary(text: str, rules: list[tuple[str, str, str, int]], capacity: int = 100_000) -> tuple[str, list[tuple[int, int, str]]]:
    """One pass from the left: at each place the longest rule (then highest priority, then least id) replaces its source.

    rules: (id, source, target, priority). Inserted text is not scanned again; protected literals are skipped whole.
    Returns the text and the edits (start, end, id) in source offsets. A result beyond ``capacity`` characters is an error.
    """
    best: dict[str, tuple] = {}
    for i, src, dst, pri in rules:
        if src and (src not in best or (-pri, i) < best[src][0]):
            best[src] = ((-pri, i), dst, i)
    if not best:
        return text, []
    rx = re.compile("|".join(re.escape(s) for s in sorted(best, key=lambda s: (-len(s), best[s][0]))))
    out, edits, at = [], [], 0
    safe = [(m.start(), m.end()) for m in PROTECTED.finditer(text)]
    bounds = [*safe, (len(text), len(text))]
    pos = 0
    for a, b in bounds:
        while m := rx.search(text, pos, a):
            out += [text[at : m.start()], best[m[0]][1]]
            edits.append((m.start(), m.end(), best[m[0]][2]))
            at = pos = m.end()
        pos = max(pos, b)
    result = "".join(out) + text[at:]
    if len(result) > capacity:
        raise ValueError("the result is longer than the capacity")
    return result, edits


def apply_dictionary(texts: DataFrame, key: str, column: str, rules: list[tuple[str, str, str, int]]) -> DataFrame:
    """(key, text, edits) of every non-null text; the rules are few (a hundred or so) and travel with the plan."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [scan_dictionary(t, rules) for t in b[column]]
            yield pd.DataFrame({key: b[key], "text": [x for x, _ in done], "edits": [[{"start": s, "end": e, "rule": r} for s, e, r in x] for _, x in done]})

    kind = dict(texts.dtypes)[key]
    return texts.filter(F.col(column).isNotNull()).select(key, column).mapInPandas(run, f"{key} {kind}, text string, edits array<struct<start: int, end: int, rule: string>>")


def greedy_spans(spans: list[tuple[int, int]]) -> list[int]:
    """Indices of the spans taken when the longest (then earliest) that overlaps none taken before is taken each time."""
    taken: list[tuple[int, int]] = []
    keep = []
    for i in sorted(range(len(spans)), key=lambda i: (spans[i][0] - spans[i][1], spans[i][0], i)):
        a, b = spans[i]
        if all(not (a < d and c < b) for c, d in taken):
            taken.append((a, b))
            keep.append(i)
    return sorted(keep)


def choose_spans(spans: DataFrame, key: str) -> DataFrame:
    """The spans (key, id, start, end) of each text that the greedy choice keeps."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "end", "id"])
        return pdf.iloc[greedy_spans(list(zip(pdf["start"], pdf["end"])))]

    s = spans.select(key, "id", "start", "end")
    return s.groupBy(key).applyInPandas(run, s.schema)


# Plain for polite endings.
REGISTER = [("ませんでした", "なかった"), ("でしょう", "だろう"), ("ましょう", "よう"), ("ました", "た"), ("ません", "ない"), ("でした", "だった"), ("です", "だ"), ("ます", "る"), ("ください", "くれ"), ("ですか", "か"), ("ますか", "るか")]


def to_plain(texts: DataFrame, key: str, column: str) -> DataFrame:
    """Polite endings as plain ones, longest first, in one pass, outside quotes, URLs and mails."""
    return apply_dictionary(texts, key, column, [(f"r{i:02}", a, b, 0) for i, (a, b) in enumerate(REGISTER)])


def cascade(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered regular replacements, folded into one expression."""
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def surface_map(tokens: DataFrame, form: str, surface: str, least: int = 2) -> DataFrame:
    """(form, surface): the most frequent surface of each form, seen at least ``least`` times; ties to the lesser surface."""
    n = tokens.groupBy(form, surface).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return n.groupBy(form).agg(F.min_by(surface, F.struct(-F.col("n"), F.col(surface))).alias(surface))


def plans(sources: DataFrame, options: DataFrame, key: str, variants: int = 6) -> DataFrame:
    """(key, variant, option ids): each source with each variant number takes every option whose rank fits the variant; plans of
    equal options are one. ``options``: (key, id, level). Null or missing options give the empty plan.
    """
    taken = options.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(variants - 1)))).filter((F.col("level") <= F.col("v")) | (F.pmod(F.xxhash64("id"), F.lit(variants)) == F.col("v")))
    per = taken.groupBy(key, "v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    full = sources.select(key).distinct().withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    j = full.join(per.withColumnRenamed("v", "variant"), [key, "variant"], "left").select(key, "variant", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    return j.groupBy(key, "ids").agg(F.min("variant").alias("variant"))


def verify_edits(texts: DataFrame, key: str, column: str, results: DataFrame, rules: list[tuple[str, str, str, int]]) -> DataFrame:
    """(key, ok): whether the edits of each result (key, text, edits) prove it. Nothing is rewritten again: every edit must name a
    rule whose source stands in the original where the edit says, edits must follow each other, and the original with the
    rules' targets put in their places must be the result. A text without result, or the reverse, is not proven.
    """
    source, target = (F.create_map(*[x for r in rules for x in (F.lit(r[0]), F.lit(r[i]))]) for i in (1, 2))
    j = texts.select(key, F.col(column).alias("__a")).join(results.select(key, F.col("text").alias("__b"), "edits"), key, "full")
    before = lambda i: F.when(i > 0, F.try_element_at("edits", i)["end"]).otherwise(0)
    sound = F.forall(F.transform("edits", lambda e, i: (e["start"] >= before(i)) & (F.substring("__a", e["start"] + 1, e["end"] - e["start"]) == source[e["rule"]])), lambda ok: F.coalesce(ok, F.lit(False)))
    pieces = F.transform("edits", lambda e, i: F.concat(F.substring("__a", before(i) + 1, e["start"] - before(i)), target[e["rule"]]))
    last = F.coalesce(F.element_at(F.transform("edits", lambda e: e["end"]), -1), F.lit(0))
    rebuilt = F.concat(F.array_join(pieces, ""), F.substring("__a", F.when(F.size("edits") > 0, last).otherwise(0) + 1, F.length("__a")))
    return j.select(key, F.coalesce(sound & (rebuilt == F.col("__b")), F.lit(False)).alias("ok"))


def trigrams(text: str) -> frozenset[str]:
    """text.gram_set of a string."""
    return frozenset(text[i : i + 3] for i in range(len(text) - 2)) or frozenset([text] if text else [])


def diverse(scored: DataFrame, key: str, k: int = 3, weight: float = 1.4, content: str = "grams") -> DataFrame:
    """(key, id, rank): up to k candidates per key (key, id, score, content), each time the one of highest score minus
    ``weight`` times its highest Dice similarity to those chosen; ties to the lesser id. One per key is always chosen.
    ``content`` has their grams, or texts, which stand for their trigrams and are less to shuffle.
    Candidates of a key are bounded by the search that made them.
    """
    kinds = dict(scored.dtypes)
    grams = trigrams if kinds[content] == "string" else frozenset

    def picked(own: Iterator[tuple]) -> Iterator[tuple]:
        rows = [[i, s, grams(g), 0.0] for _, i, s, g in own]
        for rank in range(1, min(k, len(rows)) + 1):
            best = rows.pop(max(range(len(rows)), key=lambda n: rows[n][1] - weight * rows[n][3]))
            for r in rows:
                r[3] = max(r[3], 2 * len(r[2] & best[2]) / max(1, len(r[2]) + len(best[2])))
            yield best[0], rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema: list = []

        def read() -> Iterator[tuple]:
            for b in batches:
                schema[:] = [b.schema.field(0).type, b.schema.field(1).type, pa.int32()]
                yield from zip(*(c.to_pylist() for c in b.columns))

        found = ((q, *x) for q, own in groupby(read(), key=itemgetter(0)) for x in picked(own))
        while part := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema)], [key, "id", "rank"])

    rows = scored.select(key, "id", "score", content).repartition(key).sortWithinPartitions(key, "id", "score", content)
    return rows.mapInArrow(run, f"{key} {kinds[key]}, id {kinds['id']}, rank int")


def edit_script(a: list[str], b: list[str], limit: int = 30) -> list[tuple[str, str, str]]:
    """(kind, from, to) by the longest common subsequence of two token lists: replace, remove or insert."""
    n, m = len(a), len(b)
    dp = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            dp[i][j] = dp[i + 1][j + 1] + 1 if a[i] == b[j] else max(dp[i + 1][j], dp[i][j + 1])
    out, i, j, x, y = [], 0, 0, [], []

    def flush():
        if x or y:
            out.append(("replace" if x and y else "remove" if x else "insert", "".join(x), "".join(y)))
            x.clear()
            y.clear()

    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            flush()
            i, j = i + 1, j + 1
        elif j >= m or (i < n and dp[i + 1][j] >= dp[i][j + 1]):
            x.append(a[i])
            i += 1
        else:
            y.append(b[j])
            j += 1
    flush()
    return out[:limit]


def edit_scripts(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, kind, before, after) of each pair of token arrays; the pairs are sentences, not documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame([(k, *e) for k, x, y in zip(p[key], p[a], p[b]) for e in edit_script(list(x), list(y))], columns=[key, "kind", "before", "after"])

    kind = dict(pairs.dtypes)[key]
    return pairs.select(key, a, b).mapInPandas(run, f"{key} {kind}, kind string, before string, after string")
