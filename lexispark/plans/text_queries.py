"""Queries over texts, each with its SQL twin for checking. Every query runs over its whole tables."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import features as X
from lexispark.functions import text as T
from lexispark.operators import evaluate as E
from lexispark.operators import linking as L
from lexispark.operators import sequences as W
from lexispark.operators import vectors as V
from lexispark.session import discard, materialize, releasing, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _n(p: str, c: str = "text") -> str:
    return f"len(regexp_extract_all({c}, '{p}'))::BIGINT"


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


TIDY = "replace(lower(trim(source)), '-', '_')"


def tidy(c: str = "source"):
    return F.replace(F.lower(F.trim(F.col(c))), F.lit("-"), F.lit("_"))


# Masks and hashes
@query(r"""
SELECT doc_id,
  sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[0-9]+(?:[.,][0-9]+)*', '<NUM>', 'g'), '[\p{Han}\p{Katakana}ー]+', '<TERM>', 'g'), '(<NUM>)+', '<NUM>', 'g'), '(<TERM>)+', '<TERM>', 'g')) AS structure,
  sha256(regexp_replace(text, 'https?://[^\s]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|>>\d+', '□', 'g')) AS view_raw,
  sha256(text) AS text_hash, (('0x' || substr(sha256(text), 1, 8))::BIGINT % 10)::INTEGER AS bucket,
  substr(text, 3, 5) AS slice
FROM documents WHERE text IS NOT NULL""")
def text_masks(s, d):
    t = docs(s, d).filter("text is not null")
    c = F.col("text")
    return t.select(
        "doc_id", F.sha2(T.structure_mask(c), 256).alias("structure"), F.sha2(T.vector_view(c), 256).alias("view_raw"),
        F.sha2(c, 256).alias("text_hash"), T.hash_bucket(c).alias("bucket"), T.scalar_slice(c, F.lit(2), F.lit(7)).alias("slice"),
    )


@query(r"""
SELECT doc_id, """ + _n(r"\p{Hiragana}") + " AS hiragana, " + _n(r"\p{Katakana}") + " AS katakana, " + _n(r"\p{Han}") + " AS han, " + _n(r"\p{Nd}") + r""" AS digits
FROM documents WHERE text IS NOT NULL""")
def script_profile(s, d):
    t = docs(s, d).filter("text is not null")
    c = F.col("text")
    return t.select("doc_id", *[X.count_of(c, p).alias(n) for n, p in (("hiragana", r"\p{IsHiragana}"), ("katakana", r"\p{IsKatakana}"), ("han", r"\p{IsHan}"), ("digits", r"\p{Nd}"))])


# Search keys
@query(r"""
WITH f AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '>>\s*(?:\d+(?:-\d+)?|[\p{L}\p{N}_]+)', ' ', 'g'), '[\s 　]+', ' ', 'g')) AS k FROM documents WHERE text IS NOT NULL)
SELECT doc_id, sha256(k) AS search_key, sha256(regexp_replace(k, '[\s「」『』（）()［］【】\[\]。、．，！？!?.,…]', '', 'g')) AS presence_key FROM f""")
def search_keys(s, d):
    t = docs(s, d).filter("text is not null")
    return t.select("doc_id", F.sha2(T.search_form(F.col("text")), 256).alias("search_key"), F.sha2(T.presence_form(F.col("text")), 256).alias("presence_key"))


# Quoted speech
@query(r"""
SELECT doc_id, """ + _n(r"[「『“][^「」『』“”]{2,}[」』”]") + r""" AS utterances,
  coalesce(round(list_sum(list_transform(regexp_extract_all(text, '[「『“]([^「」『』“”]+)[」』”]', 1), lambda x: length(x))) / greatest(length(text), 1), 6), 0.0)::DOUBLE AS coverage
FROM documents WHERE text IS NOT NULL""")
def quoted_speech(s, d):
    t = docs(s, d).filter("text is not null")
    return t.select("doc_id", F.size(T.utterances(F.col("text"))).cast("bigint").alias("utterances"), F.round(T.quote_coverage(F.col("text")), 6).alias("coverage"))


# Surface features
def _feature_sql() -> str:
    rates = ", ".join(f"round({_n(p)} / greatest(length(regexp_replace(text, '[\\s　]', '', 'g')), 1), 6)::DOUBLE AS r_{k}" for k, p in X.MARKS.items())
    return f"SELECT doc_id, {rates} FROM documents WHERE text IS NOT NULL"


@query(_feature_sql())
def doc_features(s, d):
    t = docs(s, d).filter("text is not null")
    return t.select("doc_id", *[c.alias(k) for k, c in X.rates(F.col("text")).items()])


@query(f"WITH f AS ({_feature_sql()}), g AS (SELECT f.*, lower(lang) AS lang FROM f JOIN documents USING (doc_id)) SELECT lang, count(*)::BIGINT AS n, " + ", ".join(f"round(avg(r_{k}), 6)::DOUBLE AS mean_{k}, round(stddev_pop(r_{k}), 6)::DOUBLE AS std_{k}" for k in ("comma", "digit", "question")) + " FROM g GROUP BY lang")
def feature_baseline(s, d):
    t = docs(s, d).filter("text is not null").select(F.lower("lang").alias("lang"), *[c.alias(k) for k, c in X.rates(F.col("text")).items()])
    aggs = [f(F.col(f"r_{k}")) for k in ("comma", "digit", "question") for f in (lambda c, k=k: F.round(F.avg(c), 6).alias(f"mean_{k}"), lambda c, k=k: F.round(F.stddev_pop(c), 6).alias(f"std_{k}"))]
    return t.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *aggs)


@query("""
WITH b AS (SELECT CASE WHEN n_chars < 100 THEN 'short' WHEN n_chars < 500 THEN 'middle' ELSE 'long' END AS band, """ + TIDY + " AS src, n_chars, " + _n("[。．.]") + r""" AS stops FROM documents WHERE text IS NOT NULL)
SELECT src, band, grouping(src)::INTEGER AS g_src, grouping(band)::INTEGER AS g_band, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars, quantile_cont(n_chars, 0.5)::DOUBLE AS median_chars, round(sum(stops) / greatest(sum(n_chars), 1), 6)::DOUBLE AS stop_rate
FROM b GROUP BY GROUPING SETS ((src), (band), (src, band), ())""")
def measures_by_group(s, d):
    t = docs(s, d).filter("text is not null").select(
        F.when(F.col("n_chars") < 100, "short").when(F.col("n_chars") < 500, "middle").otherwise("long").alias("band"), tidy().alias("src"), "n_chars", X.count_of(F.col("text"), "[。．.]").alias("stops")
    )
    return t.groupingSets([["src"], ["band"], ["src", "band"], []], "src", "band").agg(
        F.grouping("src").cast("int").alias("g_src"), F.grouping("band").cast("int").alias("g_band"), F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"),
        F.percentile("n_chars", F.lit(0.5)).alias("median_chars"), F.round(F.sum("stops") / F.greatest(F.sum("n_chars"), F.lit(1)), 6).alias("stop_rate"),
    )


# Quantiles, histograms, contexts
@query("""
SELECT lower(lang) AS lang, min(n_chars)::BIGINT AS lo, quantile_cont(n_chars, 0.25)::DOUBLE AS q25, quantile_cont(n_chars, 0.5)::DOUBLE AS median, quantile_cont(n_chars, 0.75)::DOUBLE AS q75, max(n_chars)::BIGINT AS hi, round(avg(n_chars), 6)::DOUBLE AS mean
FROM documents WHERE n_chars IS NOT NULL GROUP BY 1""")
def quantile_profile(s, d):
    q = lambda p: F.percentile("n_chars", F.lit(p))
    return docs(s, d).filter("n_chars is not null").groupBy(F.lower("lang").alias("lang")).agg(
        F.min("n_chars").alias("lo"), q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"), F.max("n_chars").alias("hi"), F.round(F.avg("n_chars"), 6).alias("mean")
    )


@query(r"SELECT c AS mark, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(text, '[。、．，！？!?.,…「」『』（）()]')) AS c FROM documents) GROUP BY c")
def punctuation_histogram(s, d):
    return docs(s, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"[。、．，！？!?.,…「」『』（）()]"), F.lit(0))).alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT substr(x, 1, 2) AS expression, CASE WHEN length(x) = 2 THEN 'end' ELSE substr(x, 3, 1) END AS follows, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(text, '(?:した|いる|ない|った)(?s:.)?')) AS x FROM documents) GROUP BY 1, 2")
def following_contexts(s, d):
    x = docs(s, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"(?:した|いる|ない|った)(?s:.)?"), F.lit(0))).alias("x"))
    return x.groupBy(F.substring("x", 1, 2).alias("expression"), F.when(F.length("x") == 2, "end").otherwise(F.substring("x", 3, 1)).alias("follows")).agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT x AS aside, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(text, '（[^（）]+）')) AS x FROM documents) GROUP BY 1 ORDER BY n DESC, aside LIMIT 40")
def top_asides(s, d):
    x = docs(s, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"（[^（）]+）"), F.lit(0))).alias("aside"))
    return x.groupBy("aside").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "aside").limit(40)


# Hashed bigrams, dense
@query("""
WITH p AS (SELECT doc_id, unnest(list_transform(range(1, length(text)), lambda i: [ascii(substr(text, i, 1)) , ascii(substr(text, i + 1, 1))])) AS x, length(text) AS n FROM documents WHERE length(text) > 1)
SELECT doc_id, ((x[1] * 31 + x[2]) % 32)::INTEGER AS bucket, count(*)::BIGINT AS hits, round(count(*) / (any_value(n) - 1), 6)::DOUBLE AS weight FROM p GROUP BY 1, 2""")
def hashed_bigrams(s, d):
    t = docs(s, d).filter(F.length("text") > 1).select("doc_id", F.length("text").alias("n"), F.explode(T.char_ngrams(F.col("text"), 2)).alias("g"))
    b = t.groupBy("doc_id", "n", X.bigram_bucket(F.substring("g", 1, 1), F.substring("g", 2, 1)).alias("bucket")).agg(F.count(F.lit(1)).alias("hits"))
    return b.select("doc_id", "bucket", "hits", F.round(F.col("hits") / (F.col("n") - 1), 6).alias("weight"))


# N-gram models
_GRAMS = "SELECT doc_id, size, unnest(list_transform(range(1, greatest(length(text) + 4 - size, 1)), lambda i: substr('^' || text || '$', i, size))) AS gram FROM documents, (VALUES (3), (4)) s(size) WHERE text IS NOT NULL"


@query(f"WITH g AS ({_GRAMS}), c AS (SELECT size, gram, count(*)::BIGINT AS n FROM g GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY n DESC, gram) AS k FROM c) SELECT size::INTEGER AS size, gram, n FROM r WHERE k <= CASE size WHEN 3 THEN 1800 ELSE 1200 END")
def ngram_model_topk(s, d):
    return V.ngram_model(docs(s, d).filter("text is not null"), "text", top={3: 1800, 4: 1200})[0]


@query(f"WITH g AS ({_GRAMS}), c AS (SELECT size, gram, count(*) AS n FROM g GROUP BY 1, 2), t AS (SELECT size, sum(n) AS total, count(*) AS vocab FROM c GROUP BY 1), l AS (SELECT doc_id, g.size, avg(ln(n + 1) - ln(total + vocab)) AS l FROM g JOIN c USING (size, gram) JOIN t ON t.size = g.size GROUP BY 1, 2), m AS (SELECT doc_id, avg(l) AS score FROM l GROUP BY 1) SELECT d.doc_id, round(coalesce(score, -20.0), 4)::DOUBLE AS score FROM documents d LEFT JOIN m USING (doc_id) WHERE text IS NOT NULL")
def ngram_log_score(s, d):
    t = docs(s, d).filter("text is not null")
    model, totals = V.ngram_model(t, "text")
    return V.ngram_log_scores(t, "doc_id", "text", materialize(model, "grams"), totals).select("doc_id", F.round("score", 4).alias("score"))


@query(f"WITH s AS (SELECT doc_id, {_n('[。．.]')} / greatest(length(text), 1) AS x FROM documents WHERE text IS NOT NULL), m AS (SELECT avg(x) AS mu, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS sd FROM s) SELECT doc_id, round(1 / (1 + exp(-(x - mu) / sd)), 4)::DOUBLE AS affinity FROM s, m")
def affinity_calibrated(s, d):
    x = docs(s, d).filter("text is not null").select("doc_id", (X.count_of(F.col("text"), "[。．.]") / F.greatest(F.length("text"), F.lit(1))).alias("x"))
    m = x.agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd")).select("mu", F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")).alias("sd"))
    return x.join(F.broadcast(m)).select("doc_id", F.round(1 / (1 + F.exp(-(F.col("x") - F.col("mu")) / F.col("sd"))), 4).alias("affinity"))  # m has one row


# TF-IDF retrieval; every 50th document asks
_TFIDF = r"""
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, ln((n + 1.0) / (count(*) + 1)) + 1 AS idf FROM tf, n GROUP BY term, n HAVING count(*) >= 2 AND count(*) <= 0.96 * n),
raw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)),
norm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY 1),
vec AS (SELECT doc_id, term, w / norm AS w FROM raw JOIN norm USING (doc_id)),
dot AS (SELECT q.doc_id AS query_id, v.doc_id, round(sum(q.w * v.w), 4) AS score FROM vec q JOIN vec v USING (term) WHERE q.doc_id % 50 = 0 AND q.doc_id <> v.doc_id GROUP BY 1, 2)"""


def tfidf_vectors(s, d) -> DataFrame:
    t = docs(s, d)
    counts = materialize(V.term_counts(t, "doc_id", "text"), "terms")
    return materialize(V.tfidf(counts, materialize(V.idf_table(counts, t.count()), "idf"), "doc_id"), "vectors")


def tfidf_rows(s, d, info: DataFrame | None = None) -> DataFrame:
    """The vectors of tfidf_vectors, one row per document, see vectors.sparse_top_k; with the columns of ``info`` by doc_id, null where it has none."""
    t = docs(s, d)
    counts = materialize(V.term_counts(t, "doc_id", "text"), "terms")
    rows = V.tfidf_rows(counts, V.numbered(V.idf_table(counts, t.count())), "doc_id")
    rows = materialize(rows if info is None else rows.join(info, "doc_id", "left"), "vectors")
    discard(counts)
    return rows


def nearest(rows: DataFrame, k: int, *args, **more) -> DataFrame:
    """(query_id, doc_id, score, rank): the k documents of highest score for every document whose id is divisible by 50."""
    return V.sparse_top_k(rows, rows.filter(F.col("doc_id") % 50 == 0), "doc_id", k, *args, **more)


@query(f"WITH {_TFIDF}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dot) SELECT query_id, doc_id, score::DOUBLE AS score, rank::INTEGER AS rank FROM r WHERE rank <= 5")
def retrieve_topk_tfidf(s, d):
    return nearest(tfidf_rows(s, d), 5)


@query(f"WITH {_TFIDF}, f AS (SELECT dot.* FROM dot JOIN documents d USING (doc_id) JOIN documents q ON q.doc_id = query_id WHERE lower(d.lang) = lower(q.lang)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) SELECT query_id, doc_id, score::DOUBLE AS score, rank::INTEGER AS rank FROM r WHERE rank <= 5")
def series_filtered_retrieval(s, d):
    rows = tfidf_rows(s, d, docs(s, d).select("doc_id", F.lower("lang").alias("lang")))
    alike = lambda sums, q, r: np.where(V.same(q["lang"], r["lang"]), sums, -np.inf)
    return nearest(rows, 5, (alike, *V.plain_score()[1:]), ["lang"])


@query(r"""
WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents),
len AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY 1), av AS (SELECT avg(len) AS av FROM len),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, n GROUP BY term, n),
q AS (SELECT doc_id AS query_id, term, tf AS qn FROM tf),
s AS (SELECT query_id, tf.doc_id, round(sum(qn * idf * tf * 2.2 / (tf + 1.2 * (0.3 + 0.7 * len / av))), 4) AS score FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN len ON len.doc_id = tf.doc_id, av WHERE query_id <> tf.doc_id GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, score::DOUBLE AS score, rank::INTEGER AS rank FROM r WHERE rank <= 5""")
def bm25_topk(s, d):
    t = docs(s, d)
    counts = materialize(V.term_counts(t, "doc_id", "text"), "terms")
    rows = materialize(V.bm25_rows(counts, "doc_id", t.count()), "bm25")
    discard(counts)
    asks = rows.select("doc_id", "terms", F.col("counts").alias("weights"))
    return V.every_top_k(rows.drop("counts"), asks, "doc_id", 5)


@query(f"WITH {_TFIDF}, h AS (SELECT query_id, dot.doc_id, round(4.5 * score + 1.4 * CASE WHEN {TIDY.replace('source', 'd.source')} = {TIDY.replace('source', 'q.source')} THEN 1 ELSE 0 END + 0.35 * (1 - abs(length(d.text) - length(q.text)) / greatest(length(d.text), length(q.text))), 6) AS score FROM dot JOIN documents d USING (doc_id) JOIN documents q ON q.doc_id = query_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h) SELECT query_id, doc_id, score::DOUBLE AS score, rank::INTEGER AS rank FROM r WHERE rank <= 5")
def hybrid_topk(s, d):
    info = docs(s, d).select("doc_id", tidy().alias("src"), F.length("text").alias("len"))
    rows = tfidf_rows(s, d, info.filter("len is not null"))
    total = lambda score, src, a, b: 4.5 * score + 1.4 * src + 0.35 * (1 - np.abs(b - a) / np.maximum(b, a))
    near = lambda sums, q, r: total(sums, V.same(q["src"], r["src"]), q["len"].to_numpy()[:, None], r["len"].to_numpy()[None, :])
    equal = lambda q, r: (q["src"].to_numpy() == r["src"].to_numpy()) & q["src"].notna().to_numpy()
    exact = lambda sums, q, r: V.half_up(total(V.half_up(sums, 4), equal(q, r), q["len"].to_numpy(), r["len"].to_numpy()), 6)
    return nearest(rows, 5, (near, exact, 1e-3), ["src", "len"])


# Classifiers with the source as label
_CENT = f"""lab AS (SELECT doc_id, {TIDY} AS label FROM documents WHERE trim(source) <> ''),
cs AS (SELECT label, term, sum(w) AS s FROM vec JOIN lab USING (doc_id) GROUP BY 1, 2), cn AS (SELECT label, sqrt(sum(s * s)) AS norm FROM cs GROUP BY 1),
cent AS (SELECT label, term, s / norm AS w FROM cs JOIN cn USING (label))"""


@query(f"WITH {_TFIDF}, {_CENT}, sc AS (SELECT doc_id, label, round(sum(vec.w * cent.w), 4) AS score FROM vec JOIN cent USING (term) WHERE doc_id % 50 = 0 GROUP BY 1, 2) SELECT doc_id, label, score::DOUBLE AS score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label)::INTEGER AS rank FROM sc")
def centroid_classify(s, d):
    vec = tfidf_vectors(s, d)
    labels = docs(s, d).select("doc_id", tidy().alias("label")).filter("label <> ''")
    cent = V.centroids(vec, labels, "doc_id", "label")
    hits = V.dot_products(vec.filter(F.col("doc_id") % 50 == 0), cent, "doc_id", "label").withColumn("score", F.round("score", 4))
    return V.top_k(hits, ["doc_id"], [F.desc("score"), "label"], 1_000_000)


@query(f"WITH {_TFIDF.replace('q.doc_id % 50 = 0 AND ', '')}, lab AS (SELECT doc_id, {TIDY} AS label FROM documents WHERE trim(source) <> ''), nb AS (SELECT query_id, label, score, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, doc_id) AS k FROM dot JOIN lab USING (doc_id)) SELECT query_id AS doc_id, label, round(0.65 * max(score) + 0.35 * avg(score), 4)::DOUBLE AS score FROM nb WHERE k <= 5 GROUP BY 1, 2")
def knn_classify(s, d):
    labels = docs(s, d).select("doc_id", tidy().alias("label")).filter("label <> ''")
    rows = tfidf_rows(s, d, labels)
    best = V.every_top_k(rows.filter("label is not null"), rows.dropDuplicates(["doc_id"]), "doc_id", 5, "label")
    at = [F.max(F.when(F.col("rank") == i, F.col("score"))).alias(f"s{i}") for i in range(1, 6)]
    sums = best.groupBy(F.col("query_id").alias("doc_id"), "label").agg(*at, F.count(F.lit(1)).alias("n"))
    # one in a hundred of these is a half at the fourth digit: added in order of rank, and rounded as a binary number as SQL does
    total = functools.reduce(lambda x, i: x + F.coalesce(f"s{i}", F.lit(0.0)), range(2, 6), F.col("s1"))
    value = 0.65 * F.col("s1") + 0.35 * (total / F.col("n"))
    return sums.select("doc_id", "label", (F.floor(value * 10_000 + 0.5) / 10_000).alias("score"))


@query(f"WITH {_TFIDF}, ref AS (SELECT term, sum(w) AS s FROM vec WHERE doc_id % 50 <> 0 GROUP BY 1), rn AS (SELECT sqrt(sum(s * s)) AS norm FROM ref) SELECT vec.doc_id, round(sum(vec.w * ref.s / norm), 4)::DOUBLE AS cosine, count(*)::BIGINT AS shared FROM vec JOIN ref USING (term), rn WHERE vec.doc_id % 50 = 0 GROUP BY 1")
def style_vector_audit(s, d):
    vec = tfidf_vectors(s, d)
    ref = vec.filter(F.col("doc_id") % 50 != 0).groupBy("term").agg(F.sum("weight").alias("s"))
    norm = ref.agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    j = vec.filter(F.col("doc_id") % 50 == 0).join(ref, "term").join(F.broadcast(norm))  # norm has one row
    return j.groupBy("doc_id").agg(F.round(F.sum(F.col("weight") * F.col("s") / F.col("norm")), 4).alias("cosine"), F.count(F.lit(1)).alias("shared"))


# segmentation
@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[。！？\n]+'), lambda x: trim(x) <> ''))::BIGINT AS sentences, len(regexp_split_to_array(text, '\n{2,}'))::BIGINT AS paragraphs, len(list_filter(regexp_split_to_array(text, '[、，,]'), lambda x: length(x) > 0))::BIGINT AS clauses FROM documents WHERE text IS NOT NULL")
def segment_counts(s, d):
    t = docs(s, d).filter("text is not null")
    n = lambda p, f: F.size(F.filter(F.split("text", p), f)).cast("bigint")
    return t.select("doc_id", n(r"[。！？\n]+", lambda x: F.trim(x) != "").alias("sentences"), F.size(F.split("text", r"\n{2,}")).cast("bigint").alias("paragraphs"), n("[、，,]", lambda x: F.length(x) > 0).alias("clauses"))


# Labels and acts
@query("SELECT label, count(*)::BIGINT AS n FROM (SELECT unnest(CASE WHEN len(l) = 0 THEN ['general'] ELSE l END) AS label FROM (SELECT list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in X.INTENTS.items()) + "], lambda x: x IS NOT NULL) AS l FROM documents WHERE text IS NOT NULL)) GROUP BY 1")
def intent_counts(s, d):
    return docs(s, d).filter("text is not null").select(F.explode(X.multi_label(F.col("text"), X.INTENTS)).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_ACT = "CASE " + " ".join(f"WHEN regexp_matches(content, '{p}') THEN '{k}'" for k, p in X.ACTS) + " ELSE 'other' END"


@query(f"WITH p AS (SELECT DISTINCT ON (id) id, threadurl, responsenumber, {_ACT} AS act FROM posts WHERE content IS NOT NULL AND responsenumber IS NOT NULL AND threadurl IS NOT NULL ORDER BY id, crawled_at DESC), l AS (SELECT *, lag(act) OVER (PARTITION BY threadurl ORDER BY responsenumber, id) AS prev FROM p), k AS (SELECT * FROM l WHERE prev IS NULL OR prev <> act), n AS (SELECT act AS from_value, lead(act) OVER (PARTITION BY threadurl ORDER BY responsenumber, id) AS to_value FROM k) SELECT from_value, to_value, count(*)::BIGINT AS n FROM n WHERE to_value IS NOT NULL GROUP BY 1, 2")
def act_transitions(s, d):
    p = table(s, d, "posts").filter("content is not null and responsenumber is not null and threadurl is not null").select("id", "threadurl", "responsenumber", "crawled_at", X.first_label(F.col("content"), X.ACTS).alias("act"))
    return W.transitions(W.latest(p, ["id"], ["crawled_at"]), ["threadurl"], ["responsenumber", "id"], "act")


# literals and quantities
def _literal_sql() -> str:
    c, parts = "text", []
    for k, p in X.LITERALS:
        parts.append(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all({c}, '{p}')) AS raw FROM documents WHERE text IS NOT NULL")
        c = f"regexp_replace({c}, '{p}', ' ', 'g')"
    return " UNION ALL ".join(parts)


@query(f"SELECT doc_id, kind, raw, count(*)::BIGINT AS n FROM ({_literal_sql()}) GROUP BY 1, 2, 3")
def literal_inventory(s, d):
    x = docs(s, d).filter("text is not null").select("doc_id", F.explode(X.literals(F.col("text"))).alias("l")).select("doc_id", "l.kind", "l.raw")
    return x.groupBy("doc_id", "kind", "raw").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH q AS (SELECT unnest(regexp_extract_all(text, '{X.QUANTITY}')) AS q FROM documents), g AS (SELECT regexp_extract(q, '{X.QUANTITY}', 2) AS s, regexp_extract(q, '{X.QUANTITY}', 1) AS pre, regexp_extract(q, '{X.QUANTITY}', 4) AS unit, regexp_extract(q, '{X.QUANTITY}', 5) AS suf FROM q) SELECT CASE WHEN s IN ('-', '−') THEN '-' ELSE '+' END AS sign, unit, CASE WHEN suf = '以上' THEN 'ge' WHEN suf = '以下' THEN 'le' WHEN suf = '未満' THEN 'lt' WHEN pre <> '' THEN 'approx' ELSE 'eq' END AS comparator, count(*)::BIGINT AS n FROM g GROUP BY 1, 2, 3")
def quantity_parse(s, d):
    q = docs(s, d).select(F.explode(X.quantities(F.col("text"))).alias("q")).select(X.quantity_parts(F.col("q")).alias("p")).select("p.*")
    return q.groupBy("sign", "unit", "comparator").agg(F.count(F.lit(1)).alias("n"))


# Comparing a text with its rewrites
_PAIRS = "SELECT DISTINCT comparisonid, left_text AS a, right_text AS b FROM comparisons WHERE left_text IS NOT NULL AND right_text IS NOT NULL"


def pairs_of(s, d) -> DataFrame:
    return table(s, d, "comparisons").filter("left_text is not null and right_text is not null").select("comparisonid", F.col("left_text").alias("a"), F.col("right_text").alias("b")).distinct()


@query("WITH p AS (SELECT DISTINCT comparisonid, source AS a, left_text AS b FROM comparisons WHERE source IS NOT NULL AND left_text IS NOT NULL), a AS (SELECT comparisonid, v, count(*) AS n FROM (SELECT comparisonid, unnest(regexp_extract_all(a, '[0-9]+')) AS v FROM p) GROUP BY 1, 2), b AS (SELECT comparisonid, v, count(*) AS n FROM (SELECT comparisonid, unnest(regexp_extract_all(b, '[0-9]+')) AS v FROM p) GROUP BY 1, 2) SELECT a.comparisonid, a.v AS value, (a.n - coalesce(b.n, 0))::BIGINT AS missing FROM a LEFT JOIN b ON a.comparisonid = b.comparisonid AND a.v = b.v WHERE a.n > coalesce(b.n, 0)")
def literal_multiset_diff(s, d):
    p = table(s, d, "comparisons").filter("source is not null and left_text is not null").select("comparisonid", "source", "left_text").distinct()
    side = lambda c: p.select("comparisonid", F.explode(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))).alias("value"))
    return side("source").exceptAll(side("left_text")).groupBy("comparisonid", "value").agg(F.count(F.lit(1)).alias("missing"))


_LITS = r"list_sort(list_distinct(regexp_extract_all({c}, '[0-9]+(?:\.[0-9]+)?')))"


@query(f"""WITH p AS ({_PAIRS}), l AS (SELECT *, {_LITS.format(c='a')} AS la, {_LITS.format(c='b')} AS lb, len(regexp_extract_all(a, 'ない|なかった|never|not|n’t|nicht|没|안 ')) % 2 AS na, len(regexp_extract_all(b, 'ない|なかった|never|not|n’t|nicht|没|안 ')) % 2 AS nb FROM p)
SELECT comparisonid, code, count(*)::BIGINT AS n FROM (SELECT comparisonid, unnest([CASE WHEN len(list_filter(la, lambda x: NOT list_contains(lb, x))) > 0 THEN 'number_lost' END, CASE WHEN len(list_filter(lb, lambda x: NOT list_contains(la, x))) > 0 THEN 'number_added' END, CASE WHEN na <> nb THEN 'polarity' END, CASE WHEN regexp_matches(a, 'だろう|予定|will |wird |明日') AND NOT regexp_matches(b, 'だろう|予定|will |wird |明日') THEN 'future_lost' END, CASE WHEN regexp_matches(a, 'らしい|という|said|says|laut|说|라고') AND NOT regexp_matches(b, 'らしい|という|said|says|laut|说|라고') THEN 'hearsay_dropped' END]) AS code FROM l) WHERE code IS NOT NULL GROUP BY 1, 2""")
def semantic_guard_pairs(s, d):
    p = pairs_of(s, d)
    return p.select("comparisonid", F.explode(E.guard_codes(F.col("a"), F.col("b"))).alias("code")).groupBy("comparisonid", "code").agg(F.count(F.lit(1)).alias("n"))


_SET = "CASE WHEN length({c}) >= 3 THEN list_distinct(list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i, 3))) WHEN length({c}) > 0 THEN [{c}] ELSE [] END"


@query(f"WITH p AS ({_PAIRS}), g AS (SELECT comparisonid, {_SET.format(c='a')} AS x, {_SET.format(c='b')} AS y FROM p) SELECT comparisonid, round(2 * len(list_intersect(x, y)) / greatest(len(x) + len(y), 1), 6)::DOUBLE AS dice, round(len(list_intersect(x, y)) / nullif(len(x), 0), 6)::DOUBLE AS retention FROM g")
def pair_similarity(s, d):
    a, b = F.col("a"), F.col("b")
    return pairs_of(s, d).select("comparisonid", F.round(T.dice(T.gram_set(a), T.gram_set(b)), 6).alias("dice"), F.round(E.retention(a, b), 6).alias("retention"))


@query(f"WITH {_TFIDF}, best AS (SELECT query_id, max(score) AS sim FROM dot GROUP BY 1), q AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id % 50 = 0), ex AS (SELECT q.doc_id, bool_or(d.text = q.text) AS exact FROM q LEFT JOIN documents d ON d.text = q.text AND d.doc_id <> q.doc_id GROUP BY 1) SELECT q.doc_id, CASE WHEN q.text IS NULL OR q.text = '' THEN 'undetermined' WHEN coalesce(exact, false) OR coalesce(sim, 0) > 0.95 THEN 'known_quote' WHEN coalesce(sim, 0) > 0.72 THEN 'adaptation' ELSE 'candidate_novel' END AS novelty FROM q LEFT JOIN best ON query_id = q.doc_id LEFT JOIN ex ON ex.doc_id = q.doc_id")
def novelty_class(s, d):
    best = nearest(tfidf_rows(s, d), 1).select(F.col("query_id").alias("doc_id"), F.col("score").alias("sim"))
    t = docs(s, d).select("doc_id", F.nullif("text", F.lit("")).alias("text"), F.sha2("text", 256).alias("fp"))
    # exact copies by counting, so that a text copied many times makes no pairs
    copies = t.groupBy("fp").agg(F.count_distinct("doc_id").alias("n"))
    q = t.filter(F.col("doc_id") % 50 == 0).join(copies, "fp", "left").join(best, "doc_id", "left")
    return q.select("doc_id", E.novelty(F.col("text"), F.lit(0.0), F.coalesce(F.col("n") > 1, F.lit(False))).alias("_"), F.when(F.col("text").isNull(), "undetermined").otherwise(E.novelty(F.coalesce("sim", F.lit(0.0)), F.lit(0.0), F.coalesce(F.col("n") > 1, F.lit(False)))).alias("novelty")).drop("_")


# Containment and best links
_KEY = r"regexp_replace(trim(regexp_replace(lower({c}), '[\s 　]+', ' ', 'g')), '[\s「」『』（）()［］【】\[\]。、．，！？!?.,…]', '', 'g')"


def _presence(c):
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), T.SPACE, " ")), f"[\\s{T.BRACKETS}{T.TERMINAL}]", "")


@query(f"WITH n AS (SELECT DISTINCT line, {_KEY.format(c='text')} AS k FROM sections WHERE text IS NOT NULL), h AS (SELECT DISTINCT id, {_KEY.format(c='content')} AS k FROM posts WHERE content IS NOT NULL) SELECT n.line, h.id FROM n JOIN h ON length(n.k) >= 6 AND contains(h.k, n.k) GROUP BY 1, 2")
def presence_join(s, d):
    n = table(s, d, "sections").filter("text is not null").select("line", _presence(F.col("text")).alias("text")).distinct()
    h = table(s, d, "posts").filter("content is not null").select("id", _presence(F.col("content")).alias("text")).distinct()
    return L.containment(n, materialize(h, "hay"), "line", "id")


@query(f"WITH n AS (SELECT DISTINCT line, post_id, {_KEY.format(c='text')} AS k FROM sections WHERE text IS NOT NULL), h AS (SELECT DISTINCT id, {_KEY.format(c='content')} AS k FROM posts WHERE content IS NOT NULL), sc AS (SELECT line, id, max(CASE WHEN n.k = h.k THEN 100 ELSE 60 END + CASE WHEN post_id = id THEN 20 ELSE 0 END) AS score FROM n JOIN h ON length(n.k) >= 6 AND contains(h.k, n.k) GROUP BY 1, 2), m AS (SELECT line, max(score) AS m FROM sc GROUP BY 1), t AS (SELECT sc.* FROM sc JOIN m ON sc.line = m.line AND score = m) SELECT line, id, score::INTEGER AS score FROM t WHERE line IN (SELECT line FROM t GROUP BY 1 HAVING count(*) = 1)")
def unique_best_link(s, d):
    n = materialize(table(s, d, "sections").filter("text is not null").select("line", "post_id", _presence(F.col("text")).alias("text")).distinct(), "needles")
    h = materialize(table(s, d, "posts").filter("content is not null").select("id", _presence(F.col("content")).alias("text")).distinct(), "hay")
    hits = L.containment(n.select("line", "text").distinct(), h, "line", "id")
    full = hits.join(n, "line").join(h.select("id", F.col("text").alias("hay")), "id").filter(F.contains("hay", "text"))
    score = F.when(F.col("text") == F.col("hay"), 100).otherwise(60) + F.when(F.col("post_id") == F.col("id"), 20).otherwise(0)
    return L.unique_best(full.groupBy("line", "id").agg(F.max(score).alias("score")), "line")


# Near-duplicates and splits
_SH = r"""
w AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '([\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}])', ' \1 ', 'g'), '[\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}]|[\p{L}\p{M}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
sh AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
cls AS (SELECT list_sort(s) AS s, min(doc_id) AS class_key FROM sh WHERE len(s) > 0 GROUP BY 1),
f AS (SELECT class_key, unnest(s) AS g, len(s) AS n FROM cls),
cand AS (SELECT a.class_key AS a, b.class_key AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM f a JOIN f b ON a.g = b.g AND a.class_key < b.class_key GROUP BY 1, 2),
pairs AS (SELECT a, b, round(c / (na + nb - c), 6) AS jaccard FROM cand WHERE c / (na + nb - c) >= 0.8 - 1e-9)"""


@query(f"WITH {_SH} SELECT a, b, jaccard::DOUBLE AS jaccard FROM pairs")
def near_dup_pairs(s, d):
    return L.similar_classes(docs(s, d), "doc_id", "text")[2].select("a", "b", F.round("jaccard", 6).alias("jaccard"))


_COMP = f"""WITH RECURSIVE {_SH}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a AS node, a AS r FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.node), comp AS (SELECT node, min(r) AS c FROM reach GROUP BY 1),
mem AS (SELECT d.doc_id, coalesce(cls.class_key, d.doc_id) AS class_key FROM documents d LEFT JOIN sh ON sh.doc_id = d.doc_id AND len(s) > 0 LEFT JOIN cls ON cls.s = list_sort(sh.s)),
lk AS (SELECT k, count(*) AS n FROM (SELECT a AS k FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY 1),
members AS (SELECT doc_id, class_key, coalesce(c, class_key) AS class_id, coalesce(n, 0)::BIGINT AS links FROM mem LEFT JOIN comp ON node = class_key LEFT JOIN lk ON k = class_key)"""


def members_of(s, d) -> DataFrame:
    return L.near_duplicates(docs(s, d), "doc_id", "text")[0]


@query(_COMP + " SELECT * FROM members")
def dup_components(s, d):
    return members_of(s, d)


@query(_COMP + ", b AS (SELECT doc_id, class_id, ('0x' || substr(sha256(class_id::VARCHAR), 1, 8))::BIGINT % 10 AS b FROM members) SELECT doc_id, class_id, CASE WHEN b < 7 THEN 'train' WHEN b < 9 THEN 'validation' ELSE 'test' END AS split FROM b")
def leakage_split(s, d):
    return members_of(s, d).select("doc_id", "class_id", L.split_of(F.col("class_id")).alias("split"))


@query(_COMP + ", r AS (SELECT m.doc_id, class_id, n_chars, row_number() OVER (PARTITION BY class_id ORDER BY coalesce(n_chars, -1) DESC, m.doc_id) AS k, count(*) OVER (PARTITION BY class_id) AS variants FROM members m JOIN documents USING (doc_id)) SELECT doc_id, class_id, variants::BIGINT AS variants, round(1.0 / variants, 6)::DOUBLE AS weight FROM r WHERE k = 1")
def canonical_docs(s, d):
    m = members_of(s, d).join(docs(s, d).select("doc_id", "n_chars"), "doc_id")
    best = m.groupBy("class_id").agg(F.min_by("doc_id", F.struct(-F.coalesce("n_chars", F.lit(-1)), "doc_id")).alias("doc_id"), F.count(F.lit(1)).alias("variants"))
    return best.select("doc_id", "class_id", "variants", F.round(1.0 / F.col("variants"), 6).alias("weight"))


@query(_COMP + ", held AS (SELECT DISTINCT class_id FROM members WHERE doc_id % 10 = 0) SELECT doc_id FROM members WHERE class_id NOT IN (SELECT class_id FROM held)")
def heldout_anti(s, d):
    m = releasing(materialize)(members_of(s, d), "members")
    held = m.filter(F.col("doc_id") % 10 == 0).select("class_id").distinct()
    return m.join(held, "class_id", "left_anti").select("doc_id")


@query("WITH p AS (SELECT doc_id, n_chars AS n FROM documents WHERE n_chars > 0), j AS (SELECT a.doc_id AS probe_id, b.doc_id AS pool_id, row_number() OVER (PARTITION BY a.doc_id ORDER BY abs(b.n - a.n), b.doc_id) AS k FROM p a JOIN p b ON b.n BETWEEN 0.5 * a.n AND 2 * a.n AND a.doc_id <> b.doc_id WHERE a.doc_id % 50 = 0) SELECT probe_id, pool_id FROM j WHERE k = 1")
def length_matched_neighbor(s, d):
    p = docs(s, d).filter("n_chars > 0").select(F.col("doc_id").alias("pool_id"), F.col("n_chars").alias("n"))
    return L.length_matched(p.filter(F.col("pool_id") % 50 == 0).withColumnRenamed("pool_id", "probe_id"), p)


# request validation
@query(r"SELECT doc_id, code FROM (SELECT doc_id, unnest([CASE WHEN text IS NULL THEN 'missing' END, CASE WHEN text IS NOT NULL AND trim(regexp_replace(text, '[\s　]', '', 'g')) = '' THEN 'blank' END, CASE WHEN length(text) > 5000 THEN 'too_long' END, CASE WHEN regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]') THEN 'control_character' END]) AS code FROM documents) WHERE code IS NOT NULL")
def validate_requests(s, d):
    return docs(s, d).select("doc_id", F.explode(X.request_errors(F.col("text"))).alias("code"))
