"""Queries over events, orders, annotations, captures and vectors, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.operators import captures as C
from lexispark.operators import evaluate as E
from lexispark.operators import spans as P
from lexispark.operators import sequences as W
from lexispark.operators import vectors as V
from lexispark.operators.skew import running_sum
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


# Streams of events, batch side
@query("""
WITH l AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM l)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*)::BIGINT AS n FROM s GROUP BY user_id, sid""")
def user_sessions(s: SparkSession, d: str) -> DataFrame:
    return W.sessions(table(s, d, "events"), "user_id", "ts")


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id, k::INTEGER AS k FROM r WHERE k <= 8")
def last_n_history(s, d):
    return V.top_k(table(s, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 8, "k").select("user_id", "event_id", "k")


@query("SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value, max(ts) AS ts FROM events GROUP BY 1, 2")
def latest_revision(s, d):
    e = table(s, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return W.latest(e, ["user_id", "event_type"], ["ts"])


@query("WITH r AS (SELECT user_id, event_id, ts, length(props) AS b, max(ts) OVER (PARTITION BY user_id) AS newest, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, sum(length(props)) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS used FROM events) SELECT user_id, event_id FROM r WHERE k <= 20 AND used <= 160 AND newest - ts <= INTERVAL 5 DAY")
def retention_top20(s, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = table(s, d, "events").withColumn("newest", F.max("ts").over(Window.partitionBy("user_id"))).withColumn("k", F.row_number().over(w))
    e = e.withColumn("used", F.sum(F.length("props")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.filter("k <= 20 and used <= 160 and newest - ts <= interval 5 days").select("user_id", "event_id")


_STAGE = "CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END"


@query(f"WITH e AS (SELECT user_id, ts, event_id, {_STAGE} AS st FROM events), m AS (SELECT *, max(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e) SELECT user_id, event_id, st::INTEGER AS stage FROM m WHERE before IS NULL OR st > before")
def job_fsm_replay(s, d):
    st = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "purchase", 3).otherwise(4)
    before = F.max("stage").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    e = table(s, d, "events").withColumn("stage", st).withColumn("before", before)
    return e.filter("before is null or stage > before").select("user_id", "event_id", "stage")


@query("WITH l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events), k AS (SELECT * FROM l WHERE prev IS NULL OR prev <> event_type), n AS (SELECT event_type AS from_value, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_value FROM k) SELECT from_value, to_value, count(*)::BIGINT AS n FROM n WHERE to_value IS NOT NULL GROUP BY 1, 2")
def event_transitions(s, d):
    return W.transitions(table(s, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events")
def actor_carry_forward(s, d):
    e = table(s, d, "events").withColumn("p", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return W.forward_fill(e, ["user_id"], ["ts", "event_id"], "p", "last_purchase").select("event_id", "last_purchase")


@query("WITH a AS (SELECT user_id, min(ts) AS crisis FROM events WHERE event_type = 'error' GROUP BY 1), b AS (SELECT user_id, crisis, min(ts) FILTER (WHERE event_type = 'view' AND ts > crisis) AS reveal FROM events JOIN a USING (user_id) GROUP BY 1, 2), c AS (SELECT user_id, crisis, reveal, min(ts) FILTER (WHERE event_type = 'purchase' AND ts > reveal) AS resolution FROM events JOIN b USING (user_id) GROUP BY 1, 2, 3) SELECT * FROM c")
def crisis_order(s, d):
    e = table(s, d, "events").select("user_id", "ts", "event_type")
    a = e.filter("event_type = 'error'").groupBy("user_id").agg(F.min("ts").alias("crisis"))
    b = e.join(a, "user_id").groupBy("user_id", "crisis").agg(F.min(F.when((F.col("event_type") == "view") & (F.col("ts") > F.col("crisis")), F.col("ts"))).alias("reveal"))
    return e.join(b, "user_id").groupBy("user_id", "crisis", "reveal").agg(F.min(F.when((F.col("event_type") == "purchase") & (F.col("ts") > F.col("reveal")), F.col("ts"))).alias("resolution"))


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), p AS (SELECT a.user_id, count(*) FILTER (WHERE a.event_id > b.event_id) AS inv FROM r a JOIN r b ON a.user_id = b.user_id AND a.k < b.k GROUP BY 1), v AS (SELECT user_id, count(*) AS n FROM r GROUP BY 1) SELECT user_id, n::BIGINT AS n, coalesce(inv, 0)::BIGINT AS inversions, CASE WHEN n > 1 THEN coalesce(inv, 0) / (n * (n - 1) / 2) END::DOUBLE AS ratio FROM v LEFT JOIN p USING (user_id)")
def inversion_ratio(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return W.inversions(table(s, d, "events").withColumn("k", F.row_number().over(w)), "user_id", "k", "event_id")


@query("WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events), m AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY k) AS j FROM r WHERE k % 7 = 1) SELECT event_type, event_id FROM m WHERE j <= 1200")
def every_seventh_sample(s, d):
    # few types, so a window would be one task for each: ranks come from range-sorted parts
    e = table(s, d, "events").select("event_type", "event_id", F.lit(1).alias("one"))
    return running_sum(e, ["event_type"], [F.col("event_id")], "one", "k").filter("k % 7 = 1 and (k + 6) / 7 <= 1200").select("event_type", "event_id")


@query("SELECT count(*)::BIGINT AS n, sum(n) ::BIGINT AS events FROM (SELECT props, count(*) AS n, min(event_id) AS first FROM events GROUP BY props)")
def first_occurrence(s, d):
    return table(s, d, "events").groupBy("props").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first")).agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("events"))


# Caps, skyline, diverse picks
@query("WITH a AS (SELECT l.*, o_custkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r1 FROM lineitem l JOIN orders ON l_orderkey = o_orderkey), b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY l_extendedprice DESC, l_linenumber, l_orderkey) AS r2 FROM a WHERE r1 <= 2) SELECT o_custkey, l_orderkey, l_linenumber FROM b WHERE r2 <= 12")
def topk_per_group_capped(s, d):
    j = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").join(table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    a = W.capped(j, [(["l_orderkey"], 2)], [F.desc("l_extendedprice"), "l_linenumber"])
    return W.capped(a, [(["o_custkey"], 12)], [F.desc("l_extendedprice"), "l_linenumber", "l_orderkey"]).select("o_custkey", "l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice >= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice > a.p_retailprice))")
def pareto_front(s, d):
    return E.skyline(table(s, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice").select("p_partkey", "p_size", "p_retailprice")


@query("WITH r AS (SELECT c_mktsegment, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('seed' || c_custkey::VARCHAR)) AS k FROM customer) SELECT c_mktsegment, c_custkey, k::INTEGER AS k FROM r WHERE k <= 3")
def diverse_picks(s, d):
    return V.top_k(table(s, d, "customer"), ["c_mktsegment"], [F.sha2(F.concat(F.lit("seed"), F.col("c_custkey").cast("string")), 256)], 3, "k").select("c_mktsegment", "c_custkey", "k")


# Set operators and evaluation harness
@query("SELECT kind, count(*)::BIGINT AS n, count(ref)::BIGINT AS with_ref FROM (SELECT 'post' AS kind, id AS ref FROM posts UNION ALL SELECT 'section', post_id FROM sections UNION ALL SELECT 'comparison', postid FROM comparisons) GROUP BY 1")
def evidence_union(s, d):
    u = table(s, d, "posts").select(F.lit("post").alias("kind"), F.col("id").alias("ref")).unionByName(table(s, d, "sections").select(F.lit("section").alias("kind"), F.col("post_id").alias("ref"), "category"), allowMissingColumns=True)
    u = u.unionByName(table(s, d, "comparisons").select(F.lit("comparison").alias("kind"), F.col("postid").alias("ref")), allowMissingColumns=True)
    return u.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("ref").alias("with_ref"))


@query("WITH a AS (SELECT DISTINCT id FROM posts), b AS (SELECT DISTINCT postid AS id FROM comparisons WHERE postid IS NOT NULL) SELECT status, count(*)::BIGINT AS n FROM (SELECT id, 'retained' AS status FROM a WHERE id IN (SELECT id FROM b) UNION ALL SELECT id, 'removed' FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'added' FROM b WHERE id NOT IN (SELECT id FROM a)) GROUP BY 1")
def before_after_diff(s, d):
    a = table(s, d, "posts").select("id").distinct()
    b = table(s, d, "comparisons").select(F.col("postid").alias("id")).filter("id is not null").distinct()
    j = a.withColumn("x", F.lit(1)).join(b.withColumn("y", F.lit(1)), "id", "full")
    return j.groupBy(F.when(F.col("y").isNull(), "removed").when(F.col("x").isNull(), "added").otherwise("retained").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT dimension, revision, count(*)::BIGINT AS n, count(DISTINCT comparisonid)::BIGINT AS items, count(*) FILTER (WHERE choice IS NULL)::BIGINT AS silent, bool_and(saved_at <= received_at) AS ordered FROM preferences GROUP BY GROUPING SETS ((dimension), (dimension, revision))")
def crosstab_grouping_sets(s, d):
    return table(s, d, "preferences").groupingSets([["dimension"], ["dimension", "revision"]], "dimension", "revision").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("comparisonid").alias("items"), F.count_if(F.col("choice").isNull()).alias("silent"), F.bool_and(F.col("saved_at") <= F.col("received_at")).alias("ordered")
    )


@query("SELECT vec_id * 10 + i AS id, label + i::INTEGER AS label FROM embeddings, range(10) r(i)")
def tile_workload(s, d):
    e = table(s, d, "embeddings").select("vec_id", "label").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return e.select((F.col("vec_id") * 10 + F.col("i")).alias("id"), (F.col("label") + F.col("i")).alias("label"))


@query("WITH a AS (SELECT user_id, min(event_id) FILTER (WHERE event_type = 'signup') AS e0, min(event_id) FILTER (WHERE event_type = 'view') AS e1, min(event_id) FILTER (WHERE event_type = 'purchase') AS e2 FROM events GROUP BY 1) SELECT stage, count(*)::BIGINT AS users FROM (SELECT unnest([CASE WHEN e0 IS NOT NULL THEN 'signup' END, CASE WHEN e0 IS NOT NULL AND e1 IS NOT NULL THEN 'view' END, CASE WHEN e0 IS NOT NULL AND e1 IS NOT NULL AND e2 IS NOT NULL THEN 'purchase' END]) AS stage FROM a) WHERE stage IS NOT NULL GROUP BY 1")
def stage_funnel(s, d):
    has = lambda t: F.bool_or(F.col("event_type") == t)
    a = table(s, d, "events").groupBy("user_id").agg(has("signup").alias("a"), has("view").alias("b"), has("purchase").alias("c"))
    stages = F.array_compact(F.array(F.when(F.col("a"), "signup"), F.when(F.col("a") & F.col("b"), "view"), F.when(F.col("a") & F.col("b") & F.col("c"), "purchase")))
    return a.select(F.explode(stages).alias("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("users"))


# judging
@query("WITH p AS (SELECT comparisonid, annotatorid, dimension, lower(trim(choice)) AS choice, row_number() OVER (PARTITION BY comparisonid, annotatorid, dimension ORDER BY revision DESC, received_at DESC) AS k FROM preferences WHERE annotatorid IS NOT NULL AND choice IS NOT NULL), l AS (SELECT * FROM p WHERE k = 1), v AS (SELECT comparisonid, dimension, count(DISTINCT choice) AS c, count(*) AS n FROM l GROUP BY 1, 2) SELECT l.dimension, count(*)::BIGINT AS labels, count(*) FILTER (WHERE choice IN ('left', 'right'))::BIGINT AS directional, count(DISTINCT annotatorid)::BIGINT AS annotators, (SELECT round(avg(CASE WHEN c > 1 THEN 1.0 ELSE 0.0 END), 6) FROM v WHERE v.dimension = l.dimension AND n > 1)::DOUBLE AS disagreement FROM l GROUP BY l.dimension")
def preference_stats(s, d):
    p = table(s, d, "preferences").filter("annotatorid is not null and choice is not null")
    last = W.latest(p.select("comparisonid", "annotatorid", "dimension", F.lower(F.trim("choice")).alias("choice"), "revision", "received_at"), ["comparisonid", "annotatorid", "dimension"], ["revision", "received_at"])
    last = materialize(last, "latest")
    v = last.groupBy("comparisonid", "dimension").agg(F.count_distinct("choice").alias("c"), F.count(F.lit(1)).alias("n")).filter("n > 1").groupBy("dimension").agg(F.round(F.avg(F.when(F.col("c") > 1, 1.0).otherwise(0.0)), 6).alias("disagreement"))
    a = last.groupBy("dimension").agg(F.count(F.lit(1)).alias("labels"), F.count_if(F.col("choice").isin("left", "right")).alias("directional"), F.count_distinct("annotatorid").alias("annotators"))
    return a.join(v, "dimension", "left")


@query("WITH e AS (SELECT value, event_type = 'purchase' AS y FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL), c AS (SELECT value, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS q FROM e GROUP BY 1), w AS (SELECT p, q, coalesce(sum(q) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT round(sum(p * (below + q / 2)) / (sum(p)::DOUBLE * sum(q)), 6)::DOUBLE AS auc FROM w")
def auc_with_ties(s, d):
    e = table(s, d, "events").filter("value is not null and event_type is not null").select("value", (F.col("event_type") == "purchase").alias("y"))
    return E.auc(e, "value", "y").select(F.round("auc", 6).alias("auc"))


@query("WITH c AS (SELECT id, 'content' AS code, CASE WHEN content IS NULL THEN 'unknown' WHEN trim(content) = '' THEN 'fail' ELSE 'pass' END AS status, true AS required FROM posts UNION ALL SELECT id, 'date', CASE WHEN post_date IS NULL THEN 'unknown' ELSE 'pass' END, false FROM posts UNION ALL SELECT id, 'board', CASE WHEN board IS NULL THEN 'unknown' ELSE 'pass' END, true FROM posts) SELECT id, CASE WHEN bool_or(required AND status = 'fail') THEN 'rejected' WHEN bool_or(required AND status = 'unknown') THEN 'needs_review' ELSE 'passed' END AS verdict FROM c GROUP BY id")
def status_fold(s, d):
    p = table(s, d, "posts")
    check = lambda code, status, req: p.select("id", F.lit(code).alias("code"), status.alias("status"), F.lit(req).alias("required"))
    known = lambda c: F.when(F.col(c).isNull(), "unknown").otherwise("pass")
    content = F.when(F.col("content").isNull(), "unknown").when(F.trim("content") == "", "fail").otherwise("pass")
    return E.status_fold(check("content", content, True).unionAll(check("date", known("post_date"), False)).unionAll(check("board", known("board"), True)), "id")


@query("SELECT user_id, CASE WHEN count(value) = count(*) THEN round(avg(value), 6) END::DOUBLE AS mean_if_all, round(avg(value), 6)::DOUBLE AS mean_known FROM (SELECT user_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS value FROM events) GROUP BY 1")
def result_summary(s, d):
    e = table(s, d, "events").select("user_id", F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("value"))
    return e.groupBy("user_id").agg(F.round(E.mean_if_all(F.col("value")), 6).alias("mean_if_all"), F.round(F.avg("value"), 6).alias("mean_known"))


@query("WITH f AS (SELECT DISTINCT comparisonid, private.features[1] AS f FROM comparisons WHERE private IS NOT NULL) SELECT comparisonid, round(map_extract(f, 'length')[1] * 0.5 + map_extract(f, 'sentences')[1] * -0.25 + map_extract(f, 'repetition')[1] * -1.0 + 0.1, 6)::DOUBLE AS score FROM f WHERE map_extract(f, 'length')[1] IS NOT NULL")
def linear_evaluator(s, d):
    f = table(s, d, "comparisons").filter("private is not null").select("comparisonid", F.explode(F.col("private.features")[0]).alias("name", "value")).distinct()
    w = s.createDataFrame([("length", 0.5), ("sentences", -0.25), ("repetition", -1.0)], "name string, weight double")
    return E.linear_score(f, F.broadcast(w), "comparisonid", 0.1).select("comparisonid", F.round("score", 6).alias("score"))


@query("WITH e AS (SELECT user_id, count(*)::DOUBLE AS n, max(value) AS v FROM events GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS a, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS b FROM e) SELECT round(corr(a, b), 6)::DOUBLE AS rho FROM r")
def spearman_activity(s, d):
    e = table(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("value").alias("v"))
    return E.spearman(materialize(e, "e"), "n", "v").select(F.round("rho", 6).alias("rho"))


# Dense vectors; every 50th vector asks
_NB = "nb AS (SELECT q.vec_id AS query_id, v.vec_id, q.label = v.label AS hit, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS sim FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM nb)"


def dense_neighbours(s, d) -> DataFrame:
    """(query_id, vec_id, hit, sim, rank): the ten nearest of every 50th vector."""
    e = table(s, d, "embeddings")
    asks = e.filter(F.col("vec_id") % 50 == 0)
    near = V.dense_top_k(e, asks, "vec_id", "embedding", 10, ["label"])
    own = asks.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"))
    return near.join(own, "query_id").withColumn("hit", F.col("label") == F.col("ql"))


@query(f"WITH {_NB} SELECT query_id, vec_id, sim::DOUBLE AS sim, rank::INTEGER AS rank FROM rk WHERE rank <= 10")
def embedding_topk(s, d):
    return dense_neighbours(s, d).select("query_id", "vec_id", "sim", "rank")


@query(f"WITH {_NB}, p AS (SELECT query_id, coalesce(max(CASE WHEN hit THEN 1.0 / rank END), 0) AS rr FROM rk WHERE rank <= 10 GROUP BY 1) SELECT round(avg(rr), 6)::DOUBLE AS mrr FROM p")
def embedding_mrr(s, d):
    return E.reciprocal_rank(dense_neighbours(s, d), "query_id", "hit", "rank").select(F.round("mrr", 6).alias("mrr"))


@query("WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT label, i, avg(v) AS m FROM x GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM m GROUP BY 1) SELECT label, i::INTEGER AS i, round(m / norm, 5)::DOUBLE AS weight FROM m JOIN n USING (label)")
def embedding_centroid(s, d):
    x = table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("p", "v"))
    m = x.groupBy("label", "p").agg(F.avg(F.col("v").cast("double")).alias("m"))
    n = m.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return m.join(n, "label").select("label", (F.col("p") + 1).alias("i"), F.round(F.col("m") / F.col("norm"), 5).alias("weight"))


@query("WITH c AS (SELECT label, vec_id % 7 AS other, count(*) AS n FROM embeddings GROUP BY 1, 2), a AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM c), x AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM c GROUP BY label)), y AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM c GROUP BY other)) SELECT round((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6)::DOUBLE AS ari FROM a, x, y")
def adjusted_rand(s, d):
    e = table(s, d, "embeddings").select("label", (F.col("vec_id") % 7).alias("other"))
    return E.adjusted_rand(e, "label", "other").select(F.round("ari", 6).alias("ari"))


# Profiles of posts
@query(r"WITH p AS (SELECT DISTINCT ON (id) id, board, content, post_date, crawled_at FROM posts ORDER BY id, crawled_at DESC), y AS (SELECT *, try_cast(regexp_extract(post_date, '^(\d{2,4})[/.-]', 1) AS INTEGER) AS yy FROM p) SELECT board, CASE WHEN yy < 70 THEN 2000 + yy WHEN yy < 100 THEN 1900 + yy ELSE yy END::INTEGER AS year, count(*)::BIGINT AS posts, count(content)::BIGINT AS with_text, round(avg(length(content)), 4)::DOUBLE AS mean_length FROM y GROUP BY 1, 2")
def era_profiles(s, d):
    p = W.latest(table(s, d, "posts").select("id", "board", "content", "post_date", "crawled_at"), ["id"], ["crawled_at"])
    yy = F.expr(r"try_cast(nullif(regexp_extract(post_date, '^(\\d{2,4})[/.-]', 1), '') as int)")
    year = F.when(yy < 70, yy + 2000).when(yy < 100, yy + 1900).otherwise(yy)
    return p.groupBy("board", year.alias("year")).agg(F.count(F.lit(1)).alias("posts"), F.count("content").alias("with_text"), F.round(F.avg(F.length("content")), 4).alias("mean_length"))


@query("WITH i AS (SELECT DISTINCT id, unnest(intents) AS intent, length(content) AS len FROM posts WHERE content <> ''), s AS (SELECT intent, count(DISTINCT id)::BIGINT AS support FROM i GROUP BY 1), r AS (SELECT intent, id, row_number() OVER (PARTITION BY intent ORDER BY min(len), id) AS k FROM i GROUP BY intent, id) SELECT intent, support, min(id) FILTER (WHERE k = 1) AS shortest, min(id) FILTER (WHERE k = 2) AS second FROM s JOIN r USING (intent) WHERE k <= 2 GROUP BY 1, 2")
def series_profiles(s, d):
    i = table(s, d, "posts").filter("content <> ''").select("id", F.explode("intents").alias("intent"), F.length("content").alias("len")).groupBy("intent", "id").agg(F.min("len").alias("len"))
    sup = i.groupBy("intent").agg(F.count(F.lit(1)).alias("support"))
    top = V.top_k(i, ["intent"], ["len", "id"], 2, "k")
    e = top.groupBy("intent").agg(F.min(F.when(F.col("k") == 1, F.col("id"))).alias("shortest"), F.min(F.when(F.col("k") == 2, F.col("id"))).alias("second"))
    return sup.join(e, "intent")


# The line ledger
@query(r"WITH l AS (SELECT DISTINCT ON (line) * FROM sections ORDER BY line, category NULLS LAST, post_id NULLS LAST, text NULLS LAST), f AS (SELECT line, coalesce(category, 'unknown') AS category, last_value(post_id IGNORE NULLS) OVER (ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS post, line - lag(CASE WHEN regexp_replace(text, '[\s　]', '', 'g') <> '' THEN line END IGNORE NULLS) OVER (ORDER BY line) AS gap FROM l) SELECT * FROM f")
def line_ledger(s, d):
    return C.line_ledger(table(s, d, "sections"))


# spans of captures: J9-J11, J16, J17, W13, W14, D12, D16, F23
_CAP = "c AS (SELECT DISTINCT ON (case_id) case_id, source, analysis FROM ginza_discourse_modesty ORDER BY case_id, capturedat), tk AS (SELECT case_id, t.id, t.text, t.dep, t.head, t.pos, t.span.\"start\" AS s, t.span.\"end\" AS e FROM (SELECT case_id, unnest(analysis.tokens) AS t FROM c)), sn AS (SELECT case_id, x.\"start\" AS s, x.\"end\" AS e FROM (SELECT case_id, unnest(analysis.sentences) AS x FROM c))"


@query(f"WITH {_CAP} SELECT case_id, count(*)::BIGINT AS tokens, count(*) FILTER (WHERE substr(source, s + 1, e - s) <> tk.text)::BIGINT AS misplaced, count(*) FILTER (WHERE head < 0 OR head >= len(analysis.tokens))::BIGINT AS bad_heads FROM tk JOIN c USING (case_id) GROUP BY 1")
def analysis_validation(s, d):
    return C.validate(C.cases(table(s, d, "ginza_discourse_modesty")))


@query(f"WITH {_CAP} SELECT sn.case_id, sn.s::INTEGER AS sentence_start, count(*)::BIGINT AS tokens, count(*) FILTER (WHERE sn.s <= tk.s AND tk.e <= sn.e)::BIGINT AS inside FROM sn JOIN tk ON sn.case_id = tk.case_id AND sn.s < tk.e AND tk.s < sn.e GROUP BY 1, 2")
def span_overlap(s, d):
    c = C.cases(table(s, d, "ginza_discourse_modesty"))
    j = P.span_join(C.sentences(c), C.tokens(c).select("case_id", "start", "end", "id"), "case_id")
    inside = (F.col("l_start") <= F.col("r_start")) & (F.col("r_end") <= F.col("l_end"))
    return j.groupBy(F.col("l_case_id").alias("case_id"), F.col("l_start").alias("sentence_start")).agg(F.count(F.lit(1)).alias("tokens"), F.count_if(inside).alias("inside"))


@query(f"WITH {_CAP}, o AS (SELECT case_id, s, e, lag(e) OVER (PARTITION BY case_id ORDER BY s, e) AS pe FROM sn), g AS (SELECT case_id, bool_and(s = coalesce(pe, 0)) AS ok, max(e) AS last FROM o GROUP BY 1) SELECT c.case_id, coalesce(ok AND last = length(source), length(source) = 0) AS tiles FROM c LEFT JOIN g USING (case_id)")
def span_tiling(s, d):
    c = C.cases(table(s, d, "ginza_discourse_modesty"))
    return P.tiling(C.sentences(c), "case_id", c.select("case_id", F.length("source").alias("n")))


@query(f"WITH {_CAP}, a AS (SELECT case_id, s, e FROM sn UNION ALL SELECT case_id, length(source), length(source) FROM c), g AS (SELECT case_id, coalesce(max(e) OVER (PARTITION BY case_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f, s FROM a) SELECT case_id, f::INTEGER AS \"start\", s::INTEGER AS \"end\" FROM g WHERE f < s")
def span_gaps(s, d):
    c = C.cases(table(s, d, "ginza_discourse_modesty"))
    return P.gaps(C.sentences(c), "case_id", c.select("case_id", F.length("source").alias("n")))


@query(f"WITH {_CAP}, x AS (SELECT case_id, id, s, e, max(e) OVER (PARTITION BY case_id ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT case_id, id, s, CASE WHEN id % 3 = 0 THEN e + 2 ELSE e END AS e FROM tk)) SELECT case_id, id::INTEGER AS edit_id FROM x WHERE s < coalesce(b, -1)")
def edit_conflicts(s, d):
    t = C.tokens(C.cases(table(s, d, "ginza_discourse_modesty")))
    return P.conflicts(t.select("case_id", F.col("id").alias("edit_id"), "start", F.when(F.col("id") % 3 == 0, F.col("end") + 2).otherwise(F.col("end")).alias("end")), "case_id")


@query(f"WITH {_CAP} SELECT case_id, sha256(string_agg(CASE WHEN id % 4 = 0 THEN '<' || text || '>' ELSE text END || substr(source, e + 1, nx - e), '' ORDER BY s)) AS rendered FROM (SELECT tk.*, source, coalesce(lead(s) OVER (PARTITION BY case_id ORDER BY s), length(source)) AS nx FROM tk JOIN c USING (case_id)) GROUP BY case_id HAVING min(s) = 0 AND bool_and(e <= nx) AND bool_and(substr(source, s + 1, e - s) = text)")
def edit_render(s, d):
    c = C.cases(table(s, d, "ginza_discourse_modesty"))
    t = C.tokens(c)
    w = Window.partitionBy("case_id").orderBy("start")
    sound = t.join(c.select("case_id", "source"), "case_id").withColumn("nx", F.coalesce(F.lead("start").over(w), F.length("source")))
    sound = sound.groupBy("case_id").agg((F.min("start") == 0).alias("a"), F.bool_and(F.col("end") <= F.col("nx")).alias("b"), F.bool_and(F.substring("source", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")).alias("c")).filter("a and b and c").select("case_id")
    edits = t.filter(F.col("id") % 4 == 0).select("case_id", "start", "end", F.concat(F.lit("<"), F.col("text"), F.lit(">")).alias("to"))
    return P.render(c.select("case_id", F.col("source").alias("text")).join(sound, "case_id", "left_semi"), edits, "case_id").select("case_id", F.sha2("text", 256).alias("rendered"))


@query(f"WITH RECURSIVE {_CAP}, up AS (SELECT case_id, id, id AS node, head FROM tk UNION SELECT up.case_id, up.id, tk.id, tk.head FROM up JOIN tk ON tk.case_id = up.case_id AND tk.id = up.head WHERE up.node <> up.head) SELECT case_id, id::INTEGER AS id, (count(*) - 1)::BIGINT AS depth FROM up GROUP BY 1, 2")
def dependency_depth(s, d):
    return C.depths(C.tokens(C.cases(table(s, d, "ginza_discourse_modesty"))))


@query(f"WITH {_CAP} SELECT sn.case_id, sn.s::INTEGER AS at, max(tk.e)::INTEGER AS token_end FROM sn LEFT JOIN tk ON sn.case_id = tk.case_id AND tk.e <= sn.s AND trim(tk.text) <> '' GROUP BY 1, 2")
def asof_token(s, d):
    c = C.cases(table(s, d, "ginza_discourse_modesty"))
    return C.as_of(C.sentences(c).select("case_id", F.col("start").alias("at")).distinct(), C.tokens(c).filter(F.trim("text") != ""))


@query(f"WITH {_CAP}, o AS (SELECT case_id, s, substr(source, s + 1, 3) AS head FROM sn JOIN c USING (case_id)) SELECT case_id, s::INTEGER AS \"start\", lag(head) OVER w AS before, lead(head) OVER w AS after FROM o WINDOW w AS (PARTITION BY case_id ORDER BY s)")
def neighbour_sentences(s, d):
    c = C.cases(table(s, d, "ginza_discourse_modesty"))
    o = C.sentences(c).join(c.select("case_id", "source"), "case_id").withColumn("h", F.substring("source", F.col("start") + 1, F.lit(3)))
    w = Window.partitionBy("case_id").orderBy("start")
    return o.select("case_id", "start", F.lag("h").over(w).alias("before"), F.lead("h").over(w).alias("after"))


@query()
def proposition_scopes(s, d):
    return C.propositions(C.tokens(C.cases(table(s, d, "ginza_discourse_modesty"))))


@query()
def extracted_facts(s, d):
    return C.facts(C.tokens(C.cases(table(s, d, "ginza_discourse_modesty"))))


# Manifest hashes
@query("SELECT tbl, count(*)::BIGINT AS rows, bit_xor(('0x' || substr(sha256(k), 1, 15))::BIGINT) AS digest FROM (SELECT 'documents' AS tbl, doc_id::VARCHAR || ':' || coalesce(text, '') AS k FROM documents UNION ALL SELECT 'posts', id || ':' || coalesce(content, '') FROM posts) GROUP BY 1")
def snapshot_manifest(s, d):
    from lexispark.sources.snapshots import digest

    a = digest(table(s, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))).alias("k")), "documents")
    return a.unionAll(digest(table(s, d, "posts").select(F.concat("id", F.lit(":"), F.coalesce("content", F.lit(""))).alias("k")), "posts"))
