"""Queries of sources and sinks as round trips, and of studies over their results."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions import features as X
from lexispark.functions import text as T
from lexispark.operators import captures as C
from lexispark.operators import grammar as G
from lexispark.operators import learning as M
from lexispark.operators import vectors as V
from lexispark.plans.candidate_queries import POOL, _SCORED, _scored, pool
from lexispark.plans.link_queries import _CAP
from lexispark.session import discard, materialize, shared_dir, table
from lexispark.sources import logs, snapshots

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").filter("text is not null")


# Charsets, saved logs, embedded records, HTML
@query(r"SELECT doc_id, sha256(text) AS wide, CASE WHEN regexp_full_match(text, '[\x00-\x7F\n]*') THEN sha256(text) END AS strict FROM documents WHERE text IS NOT NULL")
def charset_decoding(s, d):
    """Texts through UTF-16 and back, and UTF-8 bytes declared as ASCII, which rejects all others."""
    t = texts(s, d).select("doc_id", logs.encode_text(F.col("text"), "utf-16-le").alias("w"), F.col("text").cast("binary").alias("u"))
    return t.select("doc_id", F.sha2(logs.decode_bytes(F.col("w"), "utf-16-le"), 256).alias("wide"), F.sha2(logs.decode_bytes(F.col("u"), "ascii", True), 256).alias("strict"))


@query("SELECT text, count(*)::BIGINT AS n FROM sections WHERE text <> '' AND NOT contains(text, chr(10)) AND NOT contains(text, chr(13)) GROUP BY 1")
def saved_log_lines(s, d):
    """Lines written as gzip files to the shared folder and read again."""
    path = f"{shared_dir(s)}/log-{uuid.uuid4().hex}"
    x = table(s, d, "sections").filter("text <> ''").filter(~F.contains("text", F.lit("\n")) & ~F.contains("text", F.lit("\r")))
    x.select("text").write.option("compression", "gzip").text(path)
    return logs.read_lines(s, path, max_bytes=1 << 30).filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, lang, n_chars FROM documents")
def embedded_records(s, d):
    t = table(s, d, "documents").select(F.concat(F.lit("<script>var data = "), F.to_json(F.array(F.struct("doc_id", "lang", "n_chars"))), F.lit(";</script>")).alias("page"))
    return t.select(F.explode(logs.embedded_json(F.col("page"), "var data", "array<struct<doc_id: bigint, lang: string, n_chars: bigint>>")).alias("r")).select("r.*")


def _pages(s, d) -> DataFrame:
    p = table(s, d, "posts").filter("board is not null and responsenumber is not null and size(intents) > 0").groupBy("id").agg(F.min(F.struct("board", "responsenumber", "intents")).alias("r")).select("id", "r.*")
    parts = [F.lit("<html><head><style>p {color: red}</style></head><body><h1>"), "board", F.lit("</h1><!-- note --><div><b>"), F.col("responsenumber").cast("string"), F.lit("</b> &lt;"), F.col("intents")[0], F.lit("&gt;</div><script>x < y</script></body></html>")]
    return p.select("id", "board", "responsenumber", F.col("intents")[0].alias("intent"), F.concat(*parts).alias("html"))


_P = "p AS (SELECT id, min(row(board, responsenumber, intents)) AS r FROM posts WHERE board IS NOT NULL AND responsenumber IS NOT NULL AND len(intents) > 0 GROUP BY 1), pg AS (SELECT id, r[1] AS board, r[2]::VARCHAR AS n, r[3][1] AS intent FROM p)"


@query(f"WITH {_P} SELECT id, board || chr(10) || n || ' <' || intent || '>' AS text FROM pg")
def html_texts(s, d):
    return _pages(s, d).select("id", logs.html_text(F.col("html")).alias("text"))


@query(f"WITH {_P} SELECT id, 1 AS line, board AS text, 0::INTEGER AS bold FROM pg UNION ALL SELECT id, 2, n || ' <' || intent || '>', length(n)::INTEGER FROM pg")
def html_line_spans(s, d):
    x = logs.html_lines(_pages(s, d), "id", "html")
    return x.select("id", "line", "text", F.aggregate("spans", F.lit(0), lambda a, p: a + F.when(p["style"] == "bold", p["end"] - p["start"]).otherwise(0)).alias("bold"))


# Publish, list, activate, roll back, load
@query("SELECT 'regions' AS tbl, r_regionkey::BIGINT AS k, 2::BIGINT AS datasets FROM region")
def published_tables(s, d):
    root = f"{shared_dir(s)}/publish-{uuid.uuid4().hex}"
    r = table(s, d, "region").select(F.col("r_regionkey").cast("bigint").alias("k"))
    first = snapshots.publish({"regions": r}, root)
    second = snapshots.publish({"regions": r.filter("k > 0")}, root)
    for ident in (first, second, first):  # forth and back
        snapshots.activate(s, root, ident)
    got = snapshots.load(s, root)["regions"]
    return got.select(F.lit("regions").alias("tbl"), "k", F.lit(len(snapshots.published(s, root))).cast("bigint").alias("datasets"))


# A plug-in analyser
@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\\s]'))::BIGINT AS tokens FROM documents WHERE regexp_full_match(text, '[\\x00-\\x7F\\n]+') AND regexp_matches(text, '[^\\s]') AND NOT contains(text, '_')")
def analysed_tokens(s, d):
    t = texts(s, d).filter(F.col("text").rlike("^[\\x00-\\x7F]+$") & ~F.contains("text", F.lit("_")))
    return C.analyse(t, "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"))


# Scopes of tokens, focus of cases
@query(f"WITH {_CAP}, f AS (SELECT case_id, length(source) AS n, list_sort(list_transform(analysis.sentences, lambda z: {{'s': z.start, 'e': z.end}}))[1] AS f FROM c), a AS (SELECT case_id, 'adopted' AS kind, f.s AS start, f.e AS \"end\" FROM f WHERE f IS NOT NULL UNION ALL SELECT case_id, 'omitted', 0, coalesce(f.s, n) FROM f UNION ALL SELECT case_id, 'omitted', f.e, n FROM f WHERE f IS NOT NULL) SELECT case_id, kind, start::INTEGER AS start, \"end\"::INTEGER AS \"end\" FROM a WHERE start < \"end\"")
def focus_spans(s, d):
    return C.focus_spans(C.cases(table(s, d, "ginza_discourse_modesty")))


@query(f"WITH RECURSIVE {_CAP}, tk AS (SELECT case_id, t.id AS id, t.head AS head, t.pos AS pos, t.dep AS dep FROM (SELECT case_id, unnest(analysis.tokens) AS t FROM c)), pr AS (SELECT case_id, id FROM tk WHERE pos IN ('VERB', 'ADJ') OR (dep IN ('ROOT', 'advcl', 'acl', 'ccomp', 'conj', 'csubj', 'parataxis') AND pos IN ('NOUN', 'PROPN') AND head = id)), up AS (SELECT case_id, id, id AS at, 0 AS steps FROM tk UNION ALL SELECT up.case_id, up.id, tk.head, steps + 1 FROM up JOIN tk ON tk.case_id = up.case_id AND tk.id = up.at WHERE steps < 200 AND tk.head <> up.at AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.case_id = up.case_id AND pr.id = up.at)) SELECT tk.case_id, tk.id, count(pr.id)::BIGINT AS scopes FROM tk LEFT JOIN up ON up.case_id = tk.case_id AND up.id = tk.id LEFT JOIN pr ON pr.case_id = up.case_id AND pr.id = up.at GROUP BY 1, 2")
def token_scopes(s, d):
    t = materialize(C.tokens(C.cases(table(s, d, "ginza_discourse_modesty"))), "tokens")
    return C.assertive(C.propositions(t), t).select("case_id", "id", "scopes")


@query()
def proposition_relations(s, d):
    t = materialize(C.tokens(C.cases(table(s, d, "ginza_discourse_modesty"))), "tokens")
    return C.relations(C.propositions(t), t)


# M8: character TF-IDF of short lines, with the nearest and the nearest of like length
_GR = "g AS (SELECT line, n, t, unnest(list_transform(range(1, length(t) - k + 2), lambda i: k::VARCHAR || substr(t, i, k))) AS term FROM o, (VALUES (2), (3), (4)) z(k) WHERE length(t) >= k), tf AS (SELECT line, term, count(*) AS tf FROM g GROUP BY 1, 2)"
_CT = f"""o AS (SELECT line, min(text) AS t, length(min(text)) AS n FROM sections WHERE text <> '' GROUP BY 1), {_GR}, nd AS (SELECT count(*)::DOUBLE AS n FROM o),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2), raw AS (SELECT line, term, (1 + ln(tf)) * (ln((nd.n + 1) / (df + 1)) + 1) AS w FROM tf JOIN df USING (term), nd),
nm AS (SELECT line, sqrt(sum(w * w)) AS norm FROM raw GROUP BY 1), vec AS (SELECT raw.line, term, w / norm AS w FROM raw JOIN nm USING (line)),
dt AS (SELECT q.line AS query, v.line, round(sum(q.w * v.w), 4) AS score FROM vec q JOIN vec v USING (term) WHERE q.line % 50 = 0 AND q.line <> v.line GROUP BY 1, 2)"""


@query(f"WITH {_CT}, x AS (SELECT dt.*, b.n BETWEEN a.n * 0.5 AND a.n * 2 AS alike FROM dt JOIN o a ON a.line = query JOIN o b ON b.line = dt.line) SELECT query, arg_min(line, (-score, line)) AS nearest, max(score)::DOUBLE AS score, arg_min(line, (-score, line)) FILTER (WHERE alike) AS matched, (max(score) FILTER (WHERE alike))::DOUBLE AS matched_score FROM x GROUP BY 1")
def char_tfidf_nearest(s, d):
    """Every 50th line against all lines, by grams of 2 to 4 characters."""
    o = table(s, d, "sections").filter("text <> ''").groupBy("line").agg(F.min("text").alias("t")).withColumn("n", F.length("t"))
    grams = F.flatten(F.array(*[F.transform(T.char_ngrams(F.col("t"), k), _marked(k)) for k in (2, 3, 4)]))
    counts = materialize(o.select("line", F.explode(grams).alias("term")).groupBy("line", "term").agg(F.count(F.lit(1)).alias("tf")), "grams")
    idf = V.numbered(V.idf_table(counts, o.count(), 2, 1.0))
    rows = materialize(V.tfidf_rows(counts, idf, "line").join(o.select("line", "n"), "line"), "vectors")
    discard(counts)
    asks = rows.filter("line % 50 = 0")

    def like(sums, q, r):
        a, b = q["n"].to_numpy()[:, None], r["n"].to_numpy()[None, :]
        return np.where((b >= a * 0.5) & (b <= a * 2), sums, -np.inf)

    best = V.sparse_top_k(rows, asks, "line", 1).select(F.col("query_id").alias("query"), F.col("line").alias("nearest"), "score")
    mine = V.sparse_top_k(rows, asks, "line", 1, (like, *V.plain_score()[1:]), ["n"]).select(F.col("query_id").alias("query"), F.col("line").alias("matched"), F.col("score").alias("matched_score"))
    return best.join(mine, "query", "left")


def _marked(k: int):
    return lambda g: F.concat(F.lit(str(k)), g)


# Cluster summaries, topics by singular vectors
@query("WITH x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT label, i, avg(v) AS m FROM x GROUP BY 1, 2), a AS (SELECT i, avg(v) AS a FROM x GROUP BY 1), dv AS (SELECT label, i, round(m - a, 6) AS dev, row_number() OVER (PARTITION BY label ORDER BY round(abs(m - a), 6) DESC, i) AS k FROM m JOIN a USING (i)), ds AS (SELECT vec_id, label, round(sum((v - m) * (v - m)), 6) AS d FROM x JOIN m USING (label, i) GROUP BY 1, 2), nr AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS k FROM ds) SELECT label, 'deviation' AS kind, k::INTEGER AS k, i::BIGINT AS what FROM dv WHERE k <= 3 UNION ALL SELECT label, 'nearest', k, vec_id FROM nr WHERE k <= 5 UNION ALL SELECT label, 'size', 1, count(*) FROM embeddings GROUP BY label")
def cluster_summaries(s, d):
    e = table(s, d, "embeddings")
    x = materialize(e.select("vec_id", "label", F.posexplode("embedding").alias("p", "v")).select("vec_id", "label", (F.col("p") + 1).alias("i"), F.col("v").cast("double").alias("v")), "cells")
    m = x.groupBy("label", "i").agg(F.avg("v").alias("m"))
    a = x.groupBy("i").agg(F.avg("v").alias("a"))
    dev = V.top_k(m.join(a, "i").withColumn("dev", F.round(F.abs(F.col("m") - F.col("a")), 6)), ["label"], [F.desc("dev"), "i"], 3, "k")
    ds = x.join(F.broadcast(m), ["label", "i"]).groupBy("vec_id", "label").agg(F.round(F.sum((F.col("v") - F.col("m")) * (F.col("v") - F.col("m"))), 6).alias("d"))
    near = V.top_k(ds, ["label"], ["d", "vec_id"], 5, "k")
    size = e.groupBy("label").agg(F.count(F.lit(1)).alias("what"))
    return (
        dev.select("label", F.lit("deviation").alias("kind"), "k", F.col("i").cast("bigint").alias("what"))
        .unionByName(near.select("label", F.lit("nearest").alias("kind"), "k", F.col("vec_id").alias("what")))
        .unionByName(size.select("label", F.lit("size").alias("kind"), F.lit(1).alias("k"), "what"))
    )


@query()
def svd_topics(s, d):
    """(doc_id, cluster): k-means on the leading singular directions of the documents' words."""
    counts = materialize(V.term_counts(texts(s, d), "doc_id", "text"), "terms")
    vec = V.tfidf(counts, materialize(V.idf_table(counts, texts(s, d).count()), "idf"), "doc_id")
    u = M.truncated_svd(vec, "doc_id", "term", "weight", 8, 1 << 8)
    cols = [f"v{i}" for i in range(8)]
    return M.clusters(materialize(u.select("doc_id", *[F.col("vector")[i].alias(c) for i, c in enumerate(cols)]), "svd"), "doc_id", cols, 5)


# Audits of candidates
@query(f"WITH {_SCORED}, z AS (SELECT *, right(cand, 1) AS side FROM sc) SELECT side, count(*)::BIGINT AS n, round(avg(style), 6)::DOUBLE AS style, round(avg(total), 6)::DOUBLE AS total, count(*) FILTER (WHERE style > 0.2)::BIGINT AS above, count(*) FILTER (WHERE passed)::BIGINT AS passed FROM z GROUP BY 1")
def style_audit(s, d):
    x = _scored(s, d).withColumn("side", F.substring("cand", -1, 1))
    return x.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("style"), 6).alias("style"), F.round(F.avg("total"), 6).alias("total"), F.count_if(F.col("style") > 0.2).alias("above"), F.count_if("passed").alias("passed"))


@query(f"WITH {POOL} SELECT family, CASE WHEN changed = '' THEN 'cosmetic' WHEN regexp_matches(changed, '[0-9]') THEN 'numeric' WHEN family = 'inside' THEN 'rewrite' ELSE 'lexical' END AS category, verdict, count(*)::BIGINT AS n, count(*) FILTER (WHERE family <> 'inside' AND contains(whole, changed))::BIGINT AS within FROM po GROUP BY 1, 2, 3")
def edit_categories(s, d):
    cat = F.when(F.col("changed") == "", "cosmetic").when(F.col("changed").rlike("[0-9]"), "numeric").when(F.col("family") == "inside", "rewrite").otherwise("lexical")
    return pool(s, d).withColumn("category", cat).groupBy("family", "category", "verdict").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("family") != "inside") & F.contains("whole", "changed")).alias("within"))


# Size-bounded chunks; E8: mutations of leaves and what must reject them
@query("WITH RECURSIVE o AS (SELECT coalesce(category, '-') AS category, line, length(min(text)) AS size FROM sections WHERE text IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY line) AS i FROM o), w AS (SELECT category, line, size, i, 0 AS chunk, size AS used FROM r WHERE i = 1 UNION ALL SELECT r.category, r.line, r.size, r.i, CASE WHEN used > 0 AND used + r.size > 400 THEN chunk + 1 ELSE chunk END, CASE WHEN used > 0 AND used + r.size > 400 THEN r.size ELSE used + r.size END FROM w JOIN r ON r.category = w.category AND r.i = w.i + 1) SELECT category, line, chunk::INTEGER AS chunk FROM w")
def chunked_lines(s, d):
    o = table(s, d, "sections").filter("text is not null").groupBy(F.coalesce("category", F.lit("-")).alias("category"), "line").agg(F.length(F.min("text")).alias("size"))
    return G.chunked(o, ["category"], ["line"], "size", 400).select("category", "line", "chunk")


_LEAVES = [("featureversion", "unsupported_feature_version"), ("features[0]", "two_sides_needed"), ("features[1]", "two_sides_needed"), ("source", "missing_source")]


@query("WITH c AS (SELECT DISTINCT comparisonid FROM comparisons) SELECT comparisonid, path, code FROM c, (VALUES " + ", ".join(f"('{p}', '{c}')" for p, c in _LEAVES) + ") v(path, code)")
def leaf_mutations(s, d):
    """Each leaf of a record spoilt in turn, and the code with which the check of records rejects it."""
    c = table(s, d, "comparisons").groupBy("comparisonid").agg(F.any_value(F.size("private.features")).alias("n"))
    version = lambda p: F.when(F.lit(p == "featureversion"), F.lit("?")).otherwise("v1")
    cases = [F.struct(F.lit(p).alias("path"), version(p).alias("version"), F.lit(1 if p.startswith("features[") else 2).alias("sides"), F.lit("" if p == "source" else "x").alias("source")) for p, _ in _LEAVES]
    x = c.select("comparisonid", F.explode(F.array(*cases)).alias("m")).select("comparisonid", "m.*")
    code = F.when(~F.col("version").isin("v1", "v2"), "unsupported_feature_version").when(F.col("sides") != 2, "two_sides_needed").when(F.col("source") == "", "missing_source").otherwise("accepted")
    return x.select("comparisonid", "path", code.alias("code"))


# Admission by load, work done once per content
@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)::BIGINT AS load, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) <= 8 AS admitted FROM events")
def admitted_events(s, d):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-3_600_000_000, 0)
    e = table(s, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("load", F.count(F.lit(1)).over(w))
    return e.select("event_id", "user_id", "load", (F.col("load") <= 8).alias("admitted"))


@query(r"SELECT id, len(list_distinct(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')))::INTEGER AS words FROM (SELECT DISTINCT id, content FROM posts WHERE content IS NOT NULL)")
def memoised_words(s, d):
    """The number of different words, worked out once per distinct content and joined back by its hash."""
    p = table(s, d, "posts").filter("content is not null").select("id", "content", F.sha2("content", 256).alias("fp")).distinct()
    once = p.select("fp", "content").dropDuplicates(["fp"]).select("fp", F.size(F.array_distinct(T.words(F.col("content")))).alias("words"))
    return p.select("id", "fp").join(once, "fp").select("id", "words")


# Further text forms
@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '(?m)^[ \t]*>>\d+[ \t]*(?:\n|$)', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS stripped FROM documents WHERE text IS NOT NULL")
def anchor_lines_stripped(s, d):
    return texts(s, d).select("doc_id", F.sha2(T.strip_anchor_lines(F.col("text")), 256).alias("stripped"))


@query("WITH c(w, k) AS (VALUES " + ", ".join(f"('{w}', '{k}')" for w, k in X.CONCEPTS) + "), h AS (SELECT DISTINCT doc_id, k FROM documents JOIN c ON contains(lower(text), w)) SELECT doc_id, list_sort(list(DISTINCT w)) AS words FROM h JOIN c USING (k) GROUP BY 1")
def expanded_queries(s, d):
    return texts(s, d).select("doc_id", X.expand_query(F.col("text")).alias("words")).filter(F.size("words") > 0)


@query("WITH p AS (SELECT doc_id, unnest(list_transform(range(1, length(text)), lambda i: (ascii(substr(text, i, 1)) * 31 + ascii(substr(text, i + 1, 1))) % 32)) AS b, length(text) AS n FROM documents WHERE length(text) > 1), c AS (SELECT doc_id, n, b, count(*) AS hits FROM p GROUP BY 1, 2, 3), d AS (SELECT DISTINCT doc_id, n FROM c), a AS (SELECT d.doc_id, d.n, r.b FROM d, range(32) r(b)) SELECT a.doc_id, list(round(coalesce(hits, 0)::DOUBLE / (a.n - 1), 6) ORDER BY a.b) AS buckets FROM a LEFT JOIN c ON c.doc_id = a.doc_id AND c.b = a.b GROUP BY 1")
def dense_bigrams(s, d):
    """All 32 buckets of each text, zeros included."""
    t = texts(s, d).filter(F.length("text") > 1).select("doc_id", F.length("text").alias("n"), F.explode(T.char_ngrams(F.col("text"), 2)).alias("g"))
    b = t.withColumn("b", X.bigram_bucket(F.substring("g", 1, 1), F.substring("g", 2, 1)))
    counts = b.groupBy("doc_id", "n").agg(*[F.count_if(F.col("b") == i).alias(f"b{i}") for i in range(32)])
    return counts.select("doc_id", F.array(*[F.round(F.col(f"b{i}") / (F.col("n") - 1), 6) for i in range(32)]).alias("buckets"))
