"""Queries for rewriting, selection and learned models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import features as X
from lexispark.functions import text as T
from lexispark.operators import captures as C
from lexispark.operators import learning as M
from lexispark.operators import rewriting as R
from lexispark.operators import vectors as V
from lexispark.plans.text_queries import tfidf_rows
from lexispark.session import materialize, releasing, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
# Rules for tests of the dictionary.
RULES = [("a1", "倉庫", "蔵", 1), ("a2", "古い端末", "旧端末", 1), ("a3", "端末", "機械", 2), ("a4", "the", "THE", 0), ("a5", "Dr.", "Doctor", 0)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Dictionaries and their independent check
_KEPT = r"https?://[^\s　]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|「[^「」]*」|『[^『』]*』"


def _sql_dictionary(rules: list[tuple[str, str]]) -> str:
    """Longest source first, each as a placeholder of its own, outside what is protected."""
    longest = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    c = "z"
    for i, (a, _) in enumerate(longest):
        c = f"replace({c}, '{a}', chr({983040 + i}))"
    for i, (_, b) in enumerate(longest):
        c = f"replace({c}, chr({983040 + i}), '{b}')"
    rx = "|".join(a.replace(".", "[.]") for a, _ in longest)
    return f"WITH t AS (SELECT doc_id, regexp_extract_all(text, '{_KEPT}') AS kept, string_split_regex(text, '{_KEPT}') AS parts FROM documents WHERE text IS NOT NULL) SELECT doc_id, sha256(array_to_string(list_transform(parts, lambda z, i: {c} || coalesce(kept[i], '')), '')) AS text_hash, coalesce(list_sum(list_transform(parts, lambda z: len(regexp_extract_all(z, '{rx}')))), 0)::INTEGER AS edits FROM t"


@query(_sql_dictionary([(a, b) for _, a, b, _ in RULES]))
def dictionary_rewrite(s: SparkSession, d: str) -> DataFrame:
    return R.apply_dictionary(table(s, d, "documents"), "doc_id", "text", RULES).select("doc_id", F.sha2("text", 256).alias("text_hash"), F.size("edits").alias("edits"))


@query(f"SELECT doc_id, len(list_filter(string_split_regex(text, '{_KEPT}'), lambda z: contains(z, 'Dr.'))) = 0 AS ok FROM documents WHERE text IS NOT NULL")
def rewrite_proof(s, d):
    """Results in which one rule's every use was tampered with: the proof fails exactly there."""
    t = table(s, d, "documents").filter("text is not null")
    done = materialize(R.apply_dictionary(t, "doc_id", "text", RULES), "rewritten")
    bad = done.withColumn("text", F.when(F.exists("edits", lambda e: e["rule"] == "a5"), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return R.verify_edits(t, "doc_id", "text", bad, RULES)


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[！!]+', '!', 'g'), '[？?]+', '?', 'g'), '。{2,}', '。', 'g')) AS h FROM documents WHERE text IS NOT NULL")
def replacement_cascade(s, d):
    c = R.cascade(F.col("text"), [("[！!]+", "!"), ("[？?]+", "?"), ("。{2,}", "。")])
    return table(s, d, "documents").filter("text is not null").select("doc_id", F.sha2(c, 256).alias("h"))


@query(_sql_dictionary(R.REGISTER))
def register_plain(s, d):
    return R.to_plain(table(s, d, "documents"), "doc_id", "text").select("doc_id", F.size("edits").alias("edits"), F.sha2("text", 256).alias("text_hash"))


# K2: greedy choice among the literals of a capture
@query()
def greedy_literals(s, d):
    t = C.tokens(C.cases(table(s, d, "ginza_discourse_modesty"))).select("case_id", "id", "start", F.when(F.col("id") % 3 == 0, F.col("end") + 3).otherwise(F.col("end")).alias("end"))
    return R.choose_spans(t, "case_id")


# surfaces
@query("WITH c AS (SELECT DISTINCT ON (case_id) case_id, analysis FROM ginza_discourse_modesty ORDER BY case_id, capturedat), t AS (SELECT u.lemma AS lemma, u.text AS text FROM (SELECT unnest(analysis.tokens) AS u FROM c)), n AS (SELECT lemma, text, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY n DESC, text) AS k FROM n) SELECT lemma, text FROM r WHERE k = 1")
def surface_argmax(s, d):
    return R.surface_map(C.tokens(C.cases(table(s, d, "ginza_discourse_modesty"))), "lemma", "text")


# plans
@query()
def rewrite_plans(s, d):
    t = table(s, d, "documents").filter("text is not null")
    o = t.select("doc_id", F.explode(X.multi_label(F.col("text"), X.INTENTS)).alias("id")).withColumn("level", F.length("id") % 6)
    return R.plans(t, o, "doc_id")


# K4, K7: diverse selection
@query()
def diverse_retrieval(s, d):
    rows = tfidf_rows(s, d)
    return _diverse_parts(materialize(V.every_top_k(rows, rows, "doc_id", 14), "top"), table(s, d, "documents").select("doc_id", "text"))


@releasing
def _diverse_parts(top: DataFrame, texts: DataFrame, block: int = 20_000) -> DataFrame:
    """R.diverse of all queries of ``top``, some at a time: each candidate's text is shuffled to each query, and these files go after a step."""
    n = max(1, -(-top.filter("rank = 1").count() // block))
    out = None
    for i in range(n):
        c = top.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).join(texts, "doc_id").select("query_id", F.col("doc_id").alias("id"), "score", "text")
        part = materialize(R.diverse(c, "query_id", content="text"), "diverse")
        out = part if out is None else out.unionAll(part)
    return out


# P25: edit scripts between the two rewrites of a comparison
@query()
def rewrite_edit_scripts(s, d):
    c = table(s, d, "comparisons").filter("left_text is not null and right_text is not null").select("comparisonid", T.words(F.col("left_text")).alias("a"), T.words(F.col("right_text")).alias("b")).distinct()
    return R.edit_scripts(c, "comparisonid", "a", "b")


# models
_COLS = ["r_comma", "r_digit", "r_question", "r_latin", "r_newline"]


def _features(s, d) -> DataFrame:
    t = table(s, d, "documents").filter("text <> ''").select("doc_id", *[c.alias(k) for k, c in X.rates(F.col("text")).items() if k in _COLS])
    return materialize(M.clip_standardise(materialize(t, "rates"), _COLS), "features")


@query()
def pca_loadings(s, d):
    return M.principal_components(_features(s, d), "doc_id", _COLS)[1]


@query()
def kmeans_trials(s, d):
    return M.cluster_trials(_features(s, d), _COLS)


@query()
def style_clusters(s, d):
    return M.clusters(_features(s, d), "doc_id", _COLS, 4)


@query()
def preference_weights(s, d):
    p = table(s, d, "preferences").filter("annotatorid is not null").select("comparisonid", F.lower(F.trim("choice")).alias("choice"))
    c = table(s, d, "comparisons").filter("size(private.features) = 2").select("comparisonid", F.col("private.features")[0].alias("left"), F.col("private.features")[1].alias("right"), F.col("private.split").alias("split"))
    c = c.groupBy("comparisonid").agg(F.any_value("left").alias("left"), F.any_value("right").alias("right"), F.max("split").alias("split"))
    return M.preference_model(p.join(c, "comparisonid"), ["length", "sentences", "clauses", "repetition", "kanaRatio", "punctuationRatio"])


# Perturbation study
_MARKS = [*X.MARKS.values()]
_BI = "SELECT doc_id, '{v}' AS v, substr({c}, i, 2) AS g, count(*) AS n FROM (SELECT doc_id, {c}, unnest(range(1, length({c}))) AS i FROM t WHERE length({c}) >= 2) GROUP BY 1, 2, 3"


@query("WITH t AS (SELECT doc_id, text, array_to_string(list_reverse(string_split(text, chr(10))), chr(10)) AS reversed, replace(text, chr(10), '') AS flattened, replace(text, chr(10), '。' || chr(10)) AS periodised FROM documents WHERE text <> ''), o AS (" + _BI.format(v="text", c="text") + "), p AS (" + " UNION ALL ".join(_BI.format(v=v, c=v) for v in ("reversed", "flattened", "periodised")) + "), dot AS (SELECT p.doc_id, p.v, sum(o.n * p.n) AS d FROM o JOIN p ON o.doc_id = p.doc_id AND o.g = p.g GROUP BY 1, 2), no AS (SELECT doc_id, sum(n * n) AS s FROM o GROUP BY 1), np AS (SELECT doc_id, v, sum(n * n) AS s FROM p GROUP BY 1, 2), m AS (SELECT doc_id, v, (" + " + ".join(f"(len(regexp_extract_all(text, '{p}')) = len(regexp_extract_all(c, '{p}')))::INTEGER" for p in _MARKS) + ") AS same FROM (SELECT doc_id, text, 'reversed' AS v, reversed AS c FROM t UNION ALL SELECT doc_id, text, 'flattened', flattened FROM t UNION ALL SELECT doc_id, text, 'periodised', periodised FROM t)) SELECT np.v AS variant, count(*)::BIGINT AS n, round(avg(coalesce(d, 0)::DOUBLE / sqrt(no.s::DOUBLE * np.s::DOUBLE)), 6)::DOUBLE AS cosine, sum(same)::BIGINT AS unchanged FROM np JOIN no USING (doc_id) LEFT JOIN dot ON dot.doc_id = np.doc_id AND dot.v = np.v JOIN m ON m.doc_id = np.doc_id AND m.v = np.v GROUP BY 1")
def perturbation_study(s, d):
    """Lines reversed, joined or ended with full stops: the mean cosine of character pairs with the text as it was, and how many
    of the mark counts stay the same.
    """
    t = table(s, d, "documents").filter("text <> ''").select(
        "doc_id", "text", F.array_join(F.reverse(F.split("text", "\n", -1)), "\n").alias("reversed"), F.replace("text", F.lit("\n"), F.lit("")).alias("flattened"), F.replace("text", F.lit("\n"), F.lit("。\n")).alias("periodised")
    )
    forms = t.select("doc_id", "text", F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col(v).alias("c")) for v in ("text", "reversed", "flattened", "periodised")])).alias("f")).select("doc_id", "text", "f.v", "f.c")
    pairs = forms.filter(F.length("c") >= 2).select("doc_id", "v", F.explode(T.char_ngrams(F.col("c"), 2)).alias("g"))
    n = pairs.groupBy("doc_id", "g").agg(*[F.count_if(F.col("v") == v).alias(v) for v in ("text", "reversed", "flattened", "periodised")])
    per = n.groupBy("doc_id").agg(*[F.sum(F.col("text") * F.col(v)).alias(f"d_{v}") for v in ("reversed", "flattened", "periodised")], *[F.sum(F.col(v) * F.col(v)).alias(f"s_{v}") for v in ("text", "reversed", "flattened", "periodised")])
    cos = per.select("doc_id", F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.try_divide(F.col(f"d_{v}").cast("double"), F.sqrt(F.col("s_text").cast("double") * F.col(f"s_{v}"))).alias("c")) for v in ("reversed", "flattened", "periodised")])).alias("x")).select("doc_id", F.col("x.v").alias("v"), F.col("x.c").alias("cosine")).filter("cosine is not null")
    same = sum([(X.count_of(F.col("text"), p) == X.count_of(F.col("c"), p)).cast("int") for p in _MARKS[1:]], (X.count_of(F.col("text"), _MARKS[0]) == X.count_of(F.col("c"), _MARKS[0])).cast("int"))
    j = cos.join(forms.select("doc_id", "v", same.alias("same")), ["doc_id", "v"])
    return j.groupBy(F.col("v").alias("variant")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cosine"), 6).alias("cosine"), F.sum("same").alias("unchanged"))
