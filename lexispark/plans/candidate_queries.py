"""Queries over candidate texts: the two texts of each comparison are candidates of the post that they answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions import patterns as P
from lexispark.functions import text as T
from lexispark.operators import candidates as K
from lexispark.operators import evaluate as E
from lexispark.plans.rule_queries import q, sql_replaced
from lexispark.session import materialize, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def candidates(s: SparkSession, d: str) -> DataFrame:
    """(request, cand, source, text, x, y): two candidates of each distinct comparison; x and y are two recorded features."""
    c = table(s, d, "comparisons").filter("postid is not null and source is not null").dropDuplicates(["comparisonid"])
    core = F.regexp_replace("source", "\n＃[0-9]+$", "")
    side = lambda n, col, i: F.struct(F.concat("comparisonid", F.lit(n)).alias("cand"), F.col(col).alias("text"), F.col("private.features")[i]["repetition"].alias("x"), F.col("private.features")[i]["clauses"].alias("y"))
    return c.select(F.col("postid").alias("request"), core.alias("source"), F.explode(F.array(side("-l", "left_text", 0), side("-r", "right_text", 1))).alias("c")).select("request", "source", "c.*")


CANDS = """cd AS (SELECT DISTINCT ON (comparisonid) comparisonid, postid AS request, regexp_replace(source, chr(10) || '＃[0-9]+$', '') AS source, left_text, right_text, private.features AS f FROM comparisons WHERE postid IS NOT NULL AND source IS NOT NULL ORDER BY comparisonid),
ca AS (SELECT request, comparisonid || '-l' AS cand, source, left_text AS text, f[1]['repetition'] AS x, f[1]['clauses'] AS y FROM cd UNION ALL SELECT request, comparisonid || '-r', source, right_text, f[2]['repetition'], f[2]['clauses'] FROM cd)"""
_NUM = "list_sort(regexp_extract_all({c}, '" + K.NUMBER + "'))"
_CNT = "len(regexp_extract_all({c}, '{p}')) % 2"
_TESTS = [
    ("V-coverage", "contains(text, source)", "fail"), ("V-quantity", f"{_NUM.format(c='source')} = {_NUM.format(c='text')}", "fail"),
    ("V-polarity", f"{_CNT.format(c='source', p=K.NEGATIVE)} = {_CNT.format(c='text', p=K.NEGATIVE)}", "fail"), ("V-temporal", f"regexp_matches(source, '{K.FUTURE}') = regexp_matches(text, '{K.FUTURE}')", "fail"),
    ("V-attribution", f"regexp_matches(source, '{K.HEARSAY}') = regexp_matches(text, '{K.HEARSAY}')", "unknown"), ("V-length", "length(text) <= greatest(100, length(source) * 2)", "fail"),
    ("V-rhetoric", "NOT regexp_matches(text, '[！!]{3,}|。。')", "fail"),
]
CHECKS = CANDS + ", ch AS (" + " UNION ALL ".join(f"SELECT request, cand, '{k}' AS code, CASE WHEN {t} THEN 'pass' WHEN NOT ({t}) THEN '{bad}' ELSE 'unknown' END AS status, {str(k != 'V-rhetoric').lower()} AS required FROM ca" for k, t, bad in _TESTS) + ")"
VERDICTS = CHECKS + ", vd AS (SELECT cand, CASE WHEN bool_or(required AND status = 'fail') THEN 'rejected' WHEN bool_or(required AND status = 'unknown') THEN 'needs_review' ELSE 'passed' END AS verdict FROM ch GROUP BY 1)"


# Named checks; A32: verdicts
@query(f"WITH {CHECKS} SELECT cand, code, status, required FROM ch")
def candidate_checks(s, d):
    return K.check_rows(candidates(s, d)).select("cand", "code", "status", "required")


@query(f"WITH {VERDICTS} SELECT * FROM vd")
def candidate_verdicts(s, d):
    return E.status_fold(K.check_rows(candidates(s, d)), "cand")


# Quality and profile
_CL = "list_filter(string_split_regex(text, '[、。]'), lambda z: z <> '')"
_VAR = "regexp_replace(" + sql_replaced("{c}", [(P.SELVES, "<SELF>\\1"), (P.YOUS, "<YOU>\\1")]) + r", '[\p{{P}}\p{{Z}}\s]', '', 'g')"
_AT = "CASE WHEN source <> '' AND contains(text, source) THEN instr(text, source) END"
POOL = VERDICTS + f""", pr AS (SELECT ca.*, verdict, CASE verdict WHEN 'passed' THEN 1 WHEN 'rejected' THEN 0 END AS C, coalesce((len({_CL}) >= 1 AND len(list_filter({_CL}, lambda z: length(z) > 100)) = 0 AND length(text) <= greatest(100, length(source) * 2))::INTEGER, 0) AS R, {_AT} AS po_ FROM ca JOIN vd USING (cand)),
pf AS (SELECT *, substr(text, 1, po_ - 1) AS hd, substr(text, po_ + length(source)) AS tl FROM pr),
po AS (SELECT request, cand, source, text, verdict, C, R, x, y, CASE WHEN po_ IS NULL THEN 'inside' WHEN hd <> '' AND tl <> '' THEN 'both' WHEN hd <> '' THEN 'head' WHEN tl <> '' THEN 'tail' ELSE 'none' END AS family, {_VAR.format(c="CASE WHEN po_ IS NULL THEN text ELSE hd || '|' || tl END")} AS changed, {_VAR.format(c='text')} AS whole FROM pf)"""


def pool(s: SparkSession, d: str) -> DataFrame:
    c = candidates(s, d)
    v = c.join(E.status_fold(K.check_rows(c), "cand"), "cand")
    good, readable = K.quality(F.col("text"), F.col("source"), F.col("verdict"))
    family, changed = K.profile(F.col("source"), F.col("text"))
    return v.select("request", "cand", "source", "text", "verdict", good.alias("C"), readable.alias("R"), "x", "y", family.alias("family"), changed.alias("changed"), P.variant_text(F.col("text")).alias("whole"))


@query(f"WITH {POOL} SELECT cand, C::INTEGER AS c, R::INTEGER AS r, family, sha256(changed) AS changed, sha256(whole) AS whole FROM po")
def candidate_profiles(s, d):
    return pool(s, d).select("cand", F.col("C").alias("c"), F.col("R").alias("r"), "family", F.sha2("changed", 256).alias("changed"), F.sha2("whole", 256).alias("whole"))


# The whole drive from checks to selection and outcome
_G = "CASE WHEN length({c}) >= 3 THEN list_distinct(list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i, 3))) WHEN length({c}) > 0 THEN [{c}] ELSE [] END"
_DICE = "2 * len(list_intersect(k.grams, p.grams)) / greatest(len(k.grams) + len(p.grams), 1)"
_RANKED = POOL + f""", cp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY R DESC, cand) AS pn FROM po) WHERE pn <= {K.POOL}),
fr AS (SELECT a.*, CASE WHEN a.x IS NULL OR a.y IS NULL THEN 0 ELSE (SELECT count(*) FROM cp b WHERE b.request = a.request AND b.x >= a.x AND b.y >= a.y AND (b.x > a.x OR b.y > a.y)) END AS front FROM cp a),
el AS (SELECT *, {_G.format(c='changed')} AS grams, max(R) OVER (PARTITION BY request) AS br FROM fr WHERE verdict = 'passed' AND C >= 1 AND R >= 0.5), k0 AS (SELECT * FROM el WHERE R >= br - 0.15)"""


def _round(i: int) -> str:
    before = " UNION ALL ".join(f"SELECT * FROM s{j}" for j in range(1, i)) or "SELECT * FROM k0 WHERE false"
    return f""", b{i} AS ({before}), c{i} AS (SELECT k.request, k.cand, any_value(k.front) AS front, any_value(k.R) AS R, coalesce(bool_or(p.family = k.family), false) AS old, coalesce(max(round({_DICE}, 6)), 0) AS near, any_value(k.family) AS family FROM k0 k LEFT JOIN b{i} p ON p.request = k.request WHERE NOT EXISTS (SELECT 1 FROM b{i} z WHERE z.request = k.request AND (z.cand = k.cand OR z.whole = k.whole OR (z.family = k.family AND z.changed = k.changed))) GROUP BY 1, 2),
s{i} AS (SELECT k0.* FROM k0 JOIN (SELECT cand, row_number() OVER (PARTITION BY request ORDER BY front, R DESC, old, near, sha256('seed:' || cand), cand) AS n FROM c{i}) o ON o.cand = k0.cand AND n = 1)"""


_PICKED = _RANKED + _round(1) + _round(2) + _round(3) + ", sel AS (SELECT request, cand, 1 AS pick FROM s1 UNION ALL SELECT request, cand, 2 FROM s2 UNION ALL SELECT request, cand, 3 FROM s3)"


def selection(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = materialize(K.fronts(K.bounded(pool(s, d), [F.desc("R"), "cand"]), "x", "y"), "pool")
    return p, materialize(K.select_diverse(p, "seed"), "picks")


@query(f"WITH {_PICKED} SELECT request, cand, pick::INTEGER AS pick FROM sel")
def gated_selection(s, d):
    return selection(s, d)[1]


@query(f"WITH {_PICKED}, n AS (SELECT request, count(*) AS c FROM sel GROUP BY 1), st AS (SELECT request, bool_or(verdict = 'passed') AS p, bool_or(verdict = 'needs_review') AS r FROM cp GROUP BY 1) SELECT st.request, coalesce(c, 0)::BIGINT AS selected, CASE WHEN c >= 3 THEN NULL WHEN c > 0 THEN 'candidate_shortage' WHEN r THEN 'needs_review' WHEN p THEN 'quality_rejected' ELSE 'no_valid_candidate' END AS reason FROM st LEFT JOIN n USING (request)")
def request_outcomes(s, d):
    return K.outcome(*selection(s, d))


# Finalisation; L8: rotated suggestions
@query(rf"WITH {VERDICTS}, ok AS (SELECT request, min(cand) AS cand FROM ca JOIN vd USING (cand) WHERE verdict = 'passed' AND regexp_replace(source, '[\s。！？!?]+', '', 'g') <> regexp_replace(text, '[\s。！？!?]+', '', 'g') GROUP BY request, sha256(text)), r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY cand) AS place FROM ok) SELECT request, cand, place::INTEGER AS place FROM r WHERE place <= 3")
def final_candidates(s, d):
    c = candidates(s, d)
    return K.finalised(c.join(E.status_fold(K.check_rows(c), "cand"), "cand"), ["cand"])


@query(f"WITH {CANDS}, o AS (SELECT request, cand, row_number() OVER (PARTITION BY request ORDER BY sha256('rotate:' || cand), cand) - 1 AS k, count(*) OVER (PARTITION BY request) AS n FROM ca) SELECT request, r AS turn, cand FROM o, range(3) t(r) WHERE r < n AND (k + r) % n = 0".replace("r AS turn", "r::INTEGER AS turn"))
def rotated_suggestions(s, d):
    w = Window.partitionBy("request")
    o = candidates(s, d).withColumn("k", F.row_number().over(w.orderBy(F.sha2(F.concat(F.lit("rotate:"), "cand"), 256), "cand")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return o.select("request", "cand", "k", "n", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("turn")).filter("turn < n and (k + turn) % n = 0").select("request", "turn", "cand")


# Style score, validation total, shortlist
_MARK = "やはり|しかも|さらに|圧倒|最強|一級|一般人|リアル|事実|真実|明らか|だろうな|らしい"
_DIM = "len(list_filter([" + ", ".join(f"CASE WHEN regexp_matches({{c}}, {q(p)}) THEN {q(k)} END" for k, p in P.STYLE_DIMENSIONS) + "], lambda z: z IS NOT NULL))"
_DIMA = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({{c}}, {q(p)}) THEN {q(k)} END" for k, p in P.STYLE_DIMENSIONS) + "], lambda z: z IS NOT NULL)"
_STYLE = f"(least(1.0::DOUBLE, len(regexp_extract_all(text, '{_MARK}')) / greatest(2.0::DOUBLE, length(text) / 34.0::DOUBLE)) * 0.1::DOUBLE + least(1.0::DOUBLE, (len({_DIMA.format(c='text')}) * 0.65::DOUBLE + len(list_filter({_DIMA.format(c='text')}, lambda z: NOT list_contains({_DIMA.format(c='source')}, z))) * 0.35::DOUBLE) / 4) * 0.3::DOUBLE) / 0.4::DOUBLE"
_SEM = "(len(list_intersect({a}, {b}))::DOUBLE / nullif(len({a}), 0))".format(a=_G.format(c="source"), b=_G.format(c="text"))
_FLU = "greatest(1.0::DOUBLE - CASE WHEN regexp_matches(text, '。。') THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN regexp_matches(text, '[！!]{2,}') THEN 0.1::DOUBLE ELSE 0 END, 0)"


def _scored(s: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    mine, theirs = P.labels(c, P.STYLE_DIMENSIONS), P.labels(F.col("source"), P.STYLE_DIMENSIONS)
    marks = F.least(F.lit(1.0), F.regexp_count(c, F.lit(_MARK)) / F.greatest(F.lit(2.0), F.length(c) / F.lit(34.0)))
    dims = F.least(F.lit(1.0), (F.size(mine) * 0.65 + F.size(F.array_except(mine, theirs)) * 0.35) / 4)
    fluent = F.greatest(F.lit(1.0) - F.when(c.rlike("。。"), 0.2).otherwise(0.0) - F.when(c.rlike("[！!]{2,}"), 0.1).otherwise(0.0), F.lit(0.0))
    x = candidates(s, d).select("request", "cand", F.round((marks * 0.1 + dims * 0.3) / 0.4, 6).alias("style"), F.round(E.retention(F.col("source"), c), 6).alias("semantic"), F.round(fluent, 6).alias("fluency"))
    total = F.round(0.5 * F.coalesce("semantic", F.lit(0.0)) + 0.3 * F.col("style") + 0.2 * F.col("fluency"), 6)
    return x.withColumn("total", total).withColumn("passed", F.coalesce((F.col("semantic") >= 0.62) & (F.col("fluency") >= 0.65), F.lit(False)))


_SCORED = CANDS + f", s0 AS (SELECT request, cand, round({_STYLE}, 6) AS style, round({_SEM}, 6) AS semantic, round({_FLU}, 6) AS fluency FROM ca), sc AS (SELECT *, round(0.5::DOUBLE * coalesce(semantic, 0) + 0.3::DOUBLE * style + 0.2::DOUBLE * fluency, 6) AS total, coalesce(semantic >= 0.62 AND fluency >= 0.65, false) AS passed FROM s0)"


@query(f"WITH {_SCORED} SELECT cand, style::DOUBLE AS style, semantic::DOUBLE AS semantic, fluency::DOUBLE AS fluency, total::DOUBLE AS total, passed FROM sc")
def style_totals(s, d):
    return _scored(s, d).drop("request")


@query(f"WITH {_SCORED}, m AS (SELECT *, max(total) FILTER (WHERE passed) OVER (PARTITION BY request) AS best FROM sc) SELECT request, cand, total::DOUBLE AS total FROM m WHERE passed AND total >= best - 0.08 AND semantic >= 0.7 AND style >= 0.05")
def shortlist(s, d):
    best = F.max(F.when(F.col("passed"), F.col("total"))).over(Window.partitionBy("request"))
    return _scored(s, d).withColumn("best", best).filter("passed and total >= best - 0.08 and semantic >= 0.7 and style >= 0.05").select("request", "cand", "total")


# Fragments and lines kept
@query(f"WITH {CANDS}, g AS (SELECT cand, CASE WHEN length(source) >= 8 THEN list_distinct(list_transform(range(1, length(source) - 6), lambda i: substr(source, i, 8))) ELSE [source] END AS f, string_split(source, chr(10)) AS ln, text FROM ca) SELECT cand, round(len(list_filter(f, lambda z: contains(text, z)))::DOUBLE / len(f), 6) AS fragments, round(len(list_filter(ln, lambda z: contains(text, z)))::DOUBLE / len(ln), 6) AS lines, len(regexp_extract_all(text, '「'))::INTEGER = len(regexp_extract_all(text, '」'))::INTEGER AS dialogue FROM g")
def fragment_retention(s, d):
    frag = F.array_distinct(F.when(F.length("source") >= 8, F.transform(F.sequence(F.lit(1), F.length("source") - 7), lambda i: F.substring("source", i, F.lit(8)))).otherwise(F.array("source")))
    ln = F.split("source", "\n", -1)
    share = lambda a: F.round(F.size(F.filter(a, lambda z: F.contains(F.col("text"), z))).cast("double") / F.size(a), 6)
    return candidates(s, d).select("cand", share(frag).alias("fragments"), share(ln).alias("lines"), (F.regexp_count("text", F.lit("「")) == F.regexp_count("text", F.lit("」"))).alias("dialogue"))


# Learned edits, from what comparisons change at the end of a text, applied to other texts
@query(f"WITH {POOL}, e AS (SELECT changed AS rule, count(*) AS n FROM po WHERE family = 'tail' AND length(changed) BETWEEN 3 AND 24 GROUP BY 1), t AS (SELECT rule, n, row_number() OVER (ORDER BY n DESC, rule) AS k FROM e) SELECT rule, n::BIGINT AS n FROM t WHERE k <= 20")
def learned_edits(s, d):
    p = pool(s, d).filter((F.col("family") == "tail") & F.length("changed").between(3, 24))
    return p.groupBy(F.col("changed").alias("rule")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule").limit(20)


# Replays; S18: a run is a comparison whose parent is the one before it of its post
@query("WITH RECURSIVE c AS (SELECT DISTINCT ON (comparisonid) comparisonid AS id, postid, sha256(source) AS h FROM comparisons WHERE postid IS NOT NULL AND source IS NOT NULL ORDER BY comparisonid), r AS (SELECT id, h AS hash, lag(id) OVER w AS parent, CASE WHEN substr(h, 1, 1) = '0' THEN 'other' ELSE lag(h) OVER w END AS parent_hash FROM c WINDOW w AS (PARTITION BY postid ORDER BY id)), walk AS (SELECT id, parent AS at, parent_hash AS want, 0 AS steps, true AS intact FROM r UNION ALL SELECT w.id, CASE WHEN w.want = r.hash THEN r.parent END, r.parent_hash, w.steps + 1, coalesce(w.want = r.hash, false) FROM walk w JOIN r ON r.id = w.at WHERE w.steps < 20 AND w.intact) SELECT id, max(steps)::INTEGER AS steps, bool_and(intact) AS intact FROM walk GROUP BY 1")
def replayed_runs(s, d):
    c = table(s, d, "comparisons").filter("postid is not null and source is not null").dropDuplicates(["comparisonid"]).select(F.col("comparisonid").alias("id"), "postid", F.sha2("source", 256).alias("hash"))
    w = Window.partitionBy("postid").orderBy("id")
    r = c.withColumn("parent", F.lag("id").over(w)).withColumn("parent_hash", F.when(F.substring("hash", 1, 1) == "0", "other").otherwise(F.lag("hash").over(w))).drop("postid")
    return K.replay_chain(materialize(r, "runs"), 20)
