"""Queries of the table-driven classifiers and rewriters over the lines of posts, with SQL twins made from the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions import patterns as P
from lexispark.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def lines(s: SparkSession, d: str) -> DataFrame:
    """(id, n, line): the non-blank lines of every distinct post content, n from 1."""
    p = table(s, d, "posts").filter("content is not null").select("id", "content").distinct()
    return p.select("id", F.posexplode(F.split("content", "\n", -1)).alias("n", "line")).select("id", (F.col("n") + 1).alias("n"), "line").filter(F.col("line").rlike("[^\\s\x0b　  -   ]"))


LINES = "p AS (SELECT DISTINCT id, content FROM posts WHERE content IS NOT NULL), l AS (SELECT id, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1))::INTEGER AS n FROM p), x AS (SELECT id, n, line FROM l WHERE regexp_matches(line, '[^\\s\x0b　  -   ]'))"


def q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def sql_first(c: str, t: list, default: str | None = None) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, {q(p)}) THEN {q(k)}" for k, p in t) + (f" ELSE {q(default)}" if default else "") + " END"


def sql_all(c: str, t: list) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({c}, {q(p)}) THEN {q(k)} END" for k, p in t) + "], lambda z: z IS NOT NULL)"


def sql_score(c: str, t: list) -> str:
    return "(" + " + ".join(f"CASE WHEN regexp_matches({c}, {q(p)}) THEN {n} ELSE 0 END" for n, p in t) + ")"


def sql_replaced(c: str, steps: list) -> str:
    for p, to in steps:
        c = f"regexp_replace({c}, {q(p)}, {q(to)}, 'g')"
    return c


# Families, acts, dimensions
@query(f"WITH {LINES} SELECT id, n, unnest(CASE WHEN len(f) > 0 THEN f ELSE ['general'] END) AS family FROM (SELECT id, n, {sql_all('line', P.QUOTE_FAMILIES)} AS f FROM x)")
def quote_families(s, d):
    return lines(s, d).select("id", "n", F.explode(P.labels(F.col("line"), P.QUOTE_FAMILIES, "general")).alias("family"))


@query(rf"WITH {LINES}, c AS (SELECT *, regexp_replace(line, '[\s　]+', '', 'g') AS tight FROM x) SELECT id, n, coalesce(" + "[" + ", ".join(f"CASE WHEN regexp_matches(line, {q(p)}) OR regexp_matches(tight, {q(p)}) THEN {q(k)} END" for k, p in P.SPEECH_ACTS) + "].list_filter(lambda z: z IS NOT NULL)[1], 'unclassified') AS act FROM c")
def primary_acts(s, d):
    tight = F.regexp_replace("line", r"[\s　]+", "")
    acts = [F.when(F.col("line").rlike(p) | tight.rlike(p), F.lit(k)) for k, p in P.SPEECH_ACTS]
    return lines(s, d).select("id", "n", F.coalesce(*acts, F.lit("unclassified")).alias("act"))


@query(f"WITH {LINES} SELECT id, n, {sql_all('line', P.STYLE_DIMENSIONS)} AS dimensions, {sql_first('line', P.VARIATIONS, 'plain')} AS variation, {sql_first('line', P.NARRATIVES, 'self')} AS narrative FROM x")
def style_families(s, d):
    c = F.col("line")
    return lines(s, d).select("id", "n", P.labels(c, P.STYLE_DIMENSIONS).alias("dimensions"), P.first(c, P.VARIATIONS, "plain").alias("variation"), P.first(c, P.NARRATIVES, "self").alias("narrative"))


# F13, F14, LG6: achievements, actions, persona, topic, evaluation
_PLANNED = sql_score(f"regexp_replace(line, '{P.PLAN_KEPT}', '', 'g')", [P.PLANNED])
_ACTION = f"CASE WHEN regexp_matches(line, '{P.ACTION}') THEN 1 + {sql_score('line', P.ACTIONS)} + CASE WHEN regexp_matches(line, '{P.PROBLEM}') AND NOT regexp_matches(line, '{P.SELF}') THEN -6 ELSE 0 END END"


@query(f"WITH {LINES} SELECT id, n, ({sql_score('line', P.ACHIEVEMENT)} + {_PLANNED})::INTEGER AS achievement, ({_ACTION})::INTEGER AS action, regexp_matches(line, '{P.PROBLEM}') AS problem FROM x")
def sentence_scores(s, d):
    c = F.col("line")
    return lines(s, d).select("id", "n", P.achievement(c).cast("int").alias("achievement"), P.action(c).cast("int").alias("action"), c.rlike(P.PROBLEM).alias("problem"))


@query(f"WITH p AS (SELECT DISTINCT id, content AS line FROM posts WHERE content IS NOT NULL) SELECT id, line AS content_, {sql_first('line', P.PERSONAS, 'ナイト')} AS persona, {sql_first('line', P.TOPICS, 'その程度の状況')} AS topic, split_part({sql_first('line', P.EVALUATIONS)}, ':', 1) AS polarity, split_part({sql_first('line', P.EVALUATIONS)}, ':', 2) AS noun FROM p".replace("line AS content_", "sha256(line) AS fp"))
def text_context(s, d):
    c = F.col("content")
    t = table(s, d, "posts").filter("content is not null").select("id", "content").distinct().withColumn("e", P.first(c, P.EVALUATIONS))
    return t.select("id", F.sha2("content", 256).alias("fp"), P.first(c, P.PERSONAS, "ナイト").alias("persona"), P.first(c, P.TOPICS, "その程度の状況").alias("topic"), F.split_part("e", F.lit(":"), F.lit(1)).alias("polarity"), F.split_part("e", F.lit(":"), F.lit(2)).alias("noun"))


@query(f"WITH {LINES}, y AS (SELECT *, {sql_score('line', P.ACHIEVEMENT)} + {_PLANNED} AS a, {_ACTION} AS b, regexp_matches(line, '{P.PROBLEM}') AS pr FROM x) SELECT id, min(CASE WHEN pr THEN n END)::INTEGER AS problem_at, arg_max(n, (a, -n)) FILTER (WHERE a > 0)::INTEGER AS achievement_at, arg_max(n, (b, -n)) FILTER (WHERE b IS NOT NULL)::INTEGER AS action_at, bool_or(pr) AND coalesce(bool_or(a > 0), false) AS turned FROM y GROUP BY id")
def event_frame_index(s, d):
    c = F.col("line")
    y = lines(s, d).withColumn("a", P.achievement(c)).withColumn("b", P.action(c)).withColumn("pr", c.rlike(P.PROBLEM))
    at = lambda v, on: F.max_by(F.when(on, F.col("n")), F.when(on, F.struct(F.col(v), -F.col("n"))))
    return y.groupBy("id").agg(
        F.min(F.when(F.col("pr"), F.col("n"))).alias("problem_at"), at("a", F.col("a") > 0).alias("achievement_at"), at("b", F.col("b").isNotNull()).alias("action_at"),
        (F.bool_or("pr") & F.bool_or(F.col("a") > 0)).alias("turned"),
    )


# F18, LG7, LG12: the part of each line, actors carried forward, arcs, roles that follow each other
_ROLE = f"CASE WHEN regexp_matches(line, '[「『]') THEN 'dialogue' ELSE coalesce({sql_first('''regexp_replace(line, '「[^」]*」|『[^』]*』', '', 'g')''', P.SURFACE_ROLES)}, CASE WHEN k = 1 THEN 'setting' ELSE 'background' END) END"


def ranked(s, d) -> DataFrame:
    """Lines with their number among the lines of their post; posts delivered with one content each."""
    w = Window.partitionBy("id").orderBy("n", "line")
    return lines(s, d).withColumn("k", F.row_number().over(w))


_ORDER = f"{LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n, line) AS k FROM x), v AS (SELECT *, {_ROLE} AS role FROM r)"


@query(f"WITH {_ORDER} SELECT id, n, sha256(line) AS fp, role FROM v")
def surface_roles(s, d):
    return ranked(s, d).select("id", "n", F.sha2("line", 256).alias("fp"), P.surface_role(F.col("line"), F.col("k") - 1).alias("role"))


@query(f"WITH {_ORDER}, g AS (SELECT *, lag(role) OVER (PARTITION BY id ORDER BY k) AS before FROM v) SELECT role, before, count(*)::BIGINT AS n, count(*) FILTER (WHERE role = before)::BIGINT AS repeats FROM g GROUP BY 1, 2")
def role_sequences(s, d):
    v = ranked(s, d).withColumn("role", P.surface_role(F.col("line"), F.col("k") - 1)).withColumn("before", F.lag("role").over(Window.partitionBy("id").orderBy("k")))
    return v.groupBy("role", "before").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == F.col("before")).alias("repeats"))


@query(f"WITH {_ORDER}, f AS (SELECT id, count(*) AS facts, min(k) FILTER (WHERE role = 'problem') AS a, min(k) FILTER (WHERE role = 'result') AS z FROM v GROUP BY 1) SELECT id, facts::BIGINT AS facts, a::INTEGER AS crisis, z::INTEGER AS resolution, coalesce(facts >= 8 AND a < z, false) AS arc FROM f")
def discourse_arcs(s, d):
    v = ranked(s, d).withColumn("role", P.surface_role(F.col("line"), F.col("k") - 1))
    first = lambda r: F.min(F.when(F.col("role") == r, F.col("k")))
    f = v.groupBy("id").agg(F.count(F.lit(1)).alias("facts"), first("problem").alias("crisis"), first("result").alias("resolution"))
    return f.withColumn("arc", F.coalesce((F.col("facts") >= 8) & (F.col("crisis") < F.col("resolution")), F.lit(False)))


_ACTOR = "([A-Za-z][A-Za-z0-9_-]{0,12}さん|[一-龠々ァ-ヶー]{1,12}さん)"


@query(f"WITH {_ORDER}, a AS (SELECT id, k, sha256(line) AS fp, nullif(coalesce(nullif(regexp_extract(line, '{_ACTOR}', 1), ''), nullif(regexp_extract(line, '^(俺|私|僕|自分)(?:は|が)', 1), ''), regexp_extract(line, '^([A-Za-z一-龠々ァ-ヶー]{{1,12}})(?:は|が)', 1)), '') AS actor FROM v) SELECT id, k::INTEGER AS k, fp, last_value(actor IGNORE NULLS) OVER (PARTITION BY id ORDER BY k ROWS UNBOUNDED PRECEDING) AS actor FROM a")
def actors_carried(s, d):
    x = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    actor = F.coalesce(x(_ACTOR), x("^(俺|私|僕|自分)(?:は|が)"), x("^([A-Za-z一-龠々ァ-ヶー]{1,12})(?:は|が)"))
    w = Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return ranked(s, d).withColumn("a", actor).select("id", "k", F.sha2("line", 256).alias("fp"), F.last("a", ignorenulls=True).over(w).alias("actor"))


# Anchors and targets
@query(rf"WITH {LINES}, m AS (SELECT id, n, line, regexp_extract(line, '(?:>>|＞＞)\s*[0-9]+', 0) AS a, len(regexp_extract_all(line, '(?:>>|＞＞)\s*[0-9]+')) AS c FROM x), b AS (SELECT *, trim(split_part(line, a, 1)) AS before, trim(substr(line, length(split_part(line, a, 1)) + length(a) + 1)) AS after FROM m WHERE c > 0) SELECT id, n, CASE WHEN c > 1 THEN 'coordination' WHEN before = '' AND after = '' THEN 'standalone_reply' WHEN regexp_matches(after, {q(P.ANCHOR_AFTER[0][1])}) THEN 'fused_performative' WHEN regexp_matches(after, {q(P.ANCHOR_AFTER[1][1])}) OR regexp_matches(line, '{P.AGREED}') THEN 'agreement_target' ELSE coalesce({sql_first('after', P.ANCHOR_AFTER[2:])}, CASE WHEN before <> '' AND after <> '' THEN 'embedded_argument' WHEN before = '' THEN 'prefixed_clause' ELSE 'sentence_tail_reference' END) END AS class FROM b")
def anchor_classes(s, d):
    rx = r"(?:>>|＞＞)\s*[0-9]+"
    x = lines(s, d).withColumn("c", F.regexp_count("line", F.lit(rx))).filter("c > 0").withColumn("a", F.regexp_extract("line", rx, 0)).withColumn("h", F.split_part("line", F.col("a"), F.lit(1)))
    after = F.trim(F.substring("line", F.length("h") + F.length("a") + 1, F.length("line")))
    return x.select("id", "n", P.anchor_class(F.trim("h"), after, F.col("line"), F.col("c")).alias("class"))


_TARGETS = " UNION ALL ".join(f"SELECT id, n, {q(r)} AS roles, regexp_extract(line, {q(p)}, 1) AS raw FROM x WHERE regexp_matches(line, {q(p)})" for r, p in P.TARGETS)


@query(f"WITH {LINES}, t AS ({_TARGETS}), c AS (SELECT id, n, roles, trim({sql_replaced('raw', P.TARGET_CLEANUP)}) AS value FROM t) SELECT id, value, list_sort(list_distinct(flatten(list(string_split(roles, ','))))) AS roles, count(DISTINCT n)::BIGINT AS evidence FROM c WHERE length(value) <= 20 AND NOT regexp_matches(value, {q(P.NO_TARGET)}) GROUP BY 1, 2")
def anchor_targets(s, d):
    found = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(r).alias("roles"), F.regexp_extract("line", p, 1).alias("raw"))) for r, p in P.TARGETS]))
    t = lines(s, d).select("id", "n", F.explode(found).alias("t")).select("id", "n", "t.roles", P.clean_target(F.col("t.raw")).alias("value")).filter("value is not null")
    return t.groupBy("id", "value").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("roles", ","))))).alias("roles"), F.count_distinct("n").alias("evidence"))


# Literals, masks, clean-up
def _sql_protected(c: str) -> str:
    parts, rest = [], c
    for kind, p in P.PROTECTED:
        parts.append(f"list_transform(regexp_extract_all({rest}, {q(p)}), lambda z: {{'kind': '{kind}', 'raw': z}})")
        rest = f"regexp_replace({rest}, {q(p)}, ' ', 'g')"
    return "flatten([" + ", ".join(parts) + "])"


@query(f"SELECT doc_id, v.kind AS kind, v.raw AS raw, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest({_sql_protected('text')}) AS v FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2, 3")
def protected_values(s, d):
    t = table(s, d, "documents").filter("text is not null")
    return t.select("doc_id", F.explode(P.protected(F.col("text"))).alias("v")).groupBy("doc_id", "v.kind", "v.raw").agg(F.count(F.lit(1)).alias("n"))


_HELD = "「[^」]*」|https?://[A-Za-z0-9./?=&_%-]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]+"


@query(f"WITH t AS (SELECT doc_id, text, regexp_extract_all(text, {q(_HELD)}) AS kept, string_split_regex(text, {q(_HELD)}) AS parts FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(kept)::INTEGER AS held, sha256(array_to_string(list_transform(parts, lambda z, i: translate(z, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || coalesce(kept[i], '')), '')) AS fp FROM t")
def masked_rewrite(s, d):
    """Upper case outside quotes, links and addresses: these are masked, the rest is rewritten, and they are put back."""
    t = table(s, d, "documents").filter("text is not null")
    masked, kept = P.mask(F.col("text"), _HELD)
    t = t.select("doc_id", masked.alias("m"), kept.alias("kept"))
    return t.select("doc_id", F.size("kept").alias("held"), F.sha2(P.unmask(F.translate("m", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.col("kept")), 256).alias("fp"))


@query(f"WITH c AS (SELECT DISTINCT comparisonid, right_text AS t FROM comparisons WHERE right_text IS NOT NULL) SELECT comparisonid, sha256(trim({sql_replaced('t', P.CLEANUP)})) AS cleaned, sha256(regexp_replace(trim(t), '。+$', '')) AS ending FROM c")
def cleaned_candidates(s, d):
    c = table(s, d, "comparisons").filter("right_text is not null").select("comparisonid", F.col("right_text").alias("t")).distinct()
    return c.select("comparisonid", F.sha2(P.clean_candidate(F.col("t")), 256).alias("cleaned"), F.sha2(F.regexp_replace(F.trim("t"), "。+$", ""), 256).alias("ending"))


# filters
@query(r"WITH " + LINES + r" SELECT id, count(*)::BIGINT AS kept FROM x WHERE length(line) BETWEEN 8 AND 120 AND NOT regexp_matches(line, 'https?://|>>[0-9]+|＞＞[0-9]+') GROUP BY 1")
def corpus_lines(s, d):
    ok = F.length("line").between(8, 120) & ~F.col("line").rlike("https?://|>>[0-9]+|＞＞[0-9]+")
    return lines(s, d).filter(ok).groupBy("id").agg(F.count(F.lit(1)).alias("kept"))


@query("SELECT comparisonid, list_distinct(list_filter([CASE WHEN f.featureversion NOT IN ('v1', 'v2') OR f.featureversion IS NULL THEN 'unsupported_feature_version' END, CASE WHEN len(f.features) <> 2 OR f.features IS NULL THEN 'two_sides_needed' END, CASE WHEN source IS NULL OR source = '' THEN 'missing_source' END], lambda z: z IS NOT NULL)) AS errors FROM (SELECT DISTINCT ON (comparisonid) comparisonid, source, private AS f FROM comparisons ORDER BY comparisonid)")
def capability_gate(s, d):
    c = table(s, d, "comparisons").dropDuplicates(["comparisonid"])
    bad = [
        (F.col("private.featureversion").isNull() | ~F.col("private.featureversion").isin("v1", "v2"), "unsupported_feature_version"),
        (F.col("private.features").isNull() | (F.size("private.features") != 2), "two_sides_needed"), (F.col("source").isNull() | (F.col("source") == ""), "missing_source"),
    ]
    return c.select("comparisonid", F.array_compact(F.array(*[F.when(b, F.lit(k)) for b, k in bad])).alias("errors"))
