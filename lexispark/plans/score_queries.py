"""Queries of composite scores, ledgers and proofs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions import features as X
from lexispark.functions import text as T
from lexispark.operators import captures as C
from lexispark.operators import evaluate as E
from lexispark.operators import scoring as K
from lexispark.operators import vectors as V
from lexispark.plans.text_queries import _PAIRS, _SET, pairs_of, tidy
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


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").filter("text is not null")


# ledgers
@query("WITH f(frame, lex) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in K.FRAMES) + "), n AS (SELECT frame, count(*) AS n FROM f GROUP BY 1), h AS (SELECT frame, lex, doc_id FROM f JOIN documents ON contains(text, lex)), s AS (SELECT frame, doc_id FROM h JOIN n USING (frame) GROUP BY frame, doc_id, n HAVING count(DISTINCT lex) = n), l AS (SELECT frame, count(DISTINCT lex) AS k FROM h GROUP BY 1) SELECT n.frame, (SELECT count(*) FROM s WHERE s.frame = n.frame)::BIGINT AS support, coalesce(k = n, false) AS linked FROM n LEFT JOIN l USING (frame)")
def evidence_ledger(s, d):
    return K.frame_ledger(table(s, d, "documents"), "doc_id", "text")


@query("SELECT signature, count(*)::BIGINT AS n, min(doc_id) AS first FROM (SELECT doc_id, unnest(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in K.SIGNATURES) + "], lambda x: x IS NOT NULL)) AS signature FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def signature_counts(s, d):
    return docs(s, d).select("doc_id", F.explode(K.signatures(F.col("text"))).alias("signature")).groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


# Per-text scores
_NEG = "greatest(len(regexp_extract_all({c}, '" + K.NEGATION + "')) - len(regexp_extract_all({c}, '" + K.IDIOM + "')), 0)"


@query("SELECT doc_id, " + _NEG.format(c="text") + "::BIGINT AS negations, len(list_distinct(regexp_extract_all(regexp_replace(text, '[^。．.\\n]*(?:" + K.NEGATION + ")[^。．.\\n]*', '', 'g'), '" + K.DONE + "')))::BIGINT AS completions FROM documents WHERE text IS NOT NULL")
def polarity_counts(s, d):
    return docs(s, d).select("doc_id", K.negations(F.col("text")).alias("negations"), F.size(K.completions(F.col("text"))).cast("bigint").alias("completions"))


@query("SELECT CASE WHEN text IS NULL THEN 'unknown' WHEN regexp_matches(text, '[？?]') AND regexp_matches(text, '" + K.NEGATION + "') THEN 'doubt' WHEN regexp_matches(text, '断られた|negated|verschoben') THEN 'setback' WHEN regexp_matches(text, '直した|fixed|solved') THEN 'repair' WHEN regexp_matches(text, '待|waited|wartete') THEN 'waiting' WHEN regexp_matches(text, '見落とした|lost|verloren') THEN 'loss' WHEN regexp_matches(text, '[0-9]') THEN 'count' ELSE 'other' END AS frame, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def event_frames(s, d):
    return table(s, d, "documents").groupBy(K.event_frame(F.col("text")).alias("frame")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, round(greatest(1.0::DOUBLE" + "".join(f" - CASE WHEN regexp_matches(text, '{p}') THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for p, w in K.PENALTIES) + ", 0), 6)::DOUBLE AS fluency FROM documents WHERE text IS NOT NULL")
def fluency_scores(s, d):
    return docs(s, d).select("doc_id", F.round(K.fluency(F.col("text")), 6).alias("fluency"))


# L2: semantic score of a rewrite
_L = "list_distinct(regexp_extract_all({c}, '[0-9]+(?:\\.[0-9]+)?'))"


@query(f"WITH p AS ({_PAIRS}), g AS (SELECT comparisonid, {_SET.format(c='a')} AS x, {_SET.format(c='b')} AS y, {_L.format(c='a')} AS la, {_L.format(c='b')} AS lb, {_NEG.format(c='a')} % 2 = {_NEG.format(c='b')} % 2 AS same, length(b)::DOUBLE / greatest(length(a), 1) - 1.5::DOUBLE AS grown FROM p) SELECT comparisonid, round(0.68::DOUBLE * (len(list_intersect(x, y))::DOUBLE / nullif(len(x), 0)) + 0.22::DOUBLE * CASE WHEN same THEN 1 ELSE 0 END + 0.1::DOUBLE * CASE WHEN len(la) = 0 THEN 1 ELSE len(list_intersect(la, lb))::DOUBLE / len(la) END - 0.2::DOUBLE * greatest(grown, 0), 5)::DOUBLE AS score FROM g")
def semantic_scores(s, d):
    return pairs_of(s, d).select("comparisonid", F.round(K.semantic_score(F.col("a"), F.col("b")), 5).alias("score"))


# Evidence sampling
@query("WITH i AS (SELECT DISTINCT unnest(intents) AS intent, board, id FROM posts), a AS (SELECT intent, id, row_number() OVER (PARTITION BY intent ORDER BY id) AS k FROM (SELECT DISTINCT intent, id FROM i)), b AS (SELECT intent, id, row_number() OVER (PARTITION BY intent, board ORDER BY id) AS k FROM i) SELECT intent, id FROM a WHERE k <= 2 UNION SELECT intent, id FROM b WHERE k <= 2")
def lexicon_sampling(s, d):
    i = table(s, d, "posts").select("board", "id", F.explode("intents").alias("intent"))
    return K.sample_evidence(i, "intent", "board", "id")


# K6: repeated fronts
@query("WITH a AS (SELECT s_suppkey, s_nationkey AS x, s_acctbal AS y FROM supplier), f1 AS (SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.x >= a.x AND b.y >= a.y AND (b.x > a.x OR b.y > a.y))), r1 AS (SELECT * FROM a WHERE s_suppkey NOT IN (SELECT s_suppkey FROM f1)), f2 AS (SELECT a.* FROM r1 a WHERE NOT EXISTS (SELECT 1 FROM r1 b WHERE b.x >= a.x AND b.y >= a.y AND (b.x > a.x OR b.y > a.y))) SELECT s_suppkey, 1 AS front FROM f1 UNION ALL SELECT s_suppkey, 2 FROM f2")
def pareto_levels(s, d):
    a = table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("x"), F.col("s_acctbal").alias("y"))
    return K.fronts(a, "x", "y", 2).select("s_suppkey", "front")


# Blind sides
@query("SELECT comparisonid, ('0x' || substr(sha256('blind' || comparisonid), 1, 1))::INTEGER % 2 = 1 AS swapped, sha256(CASE WHEN ('0x' || substr(sha256('blind' || comparisonid), 1, 1))::INTEGER % 2 = 1 THEN b ELSE a END) AS first FROM (" + _PAIRS + ")")
def blind_sides(s, d):
    bit = F.conv(F.substring(F.sha2(F.concat(F.lit("blind"), "comparisonid"), 256), 1, 1), 16, 10).cast("int") % 2 == 1
    return pairs_of(s, d).select("comparisonid", bit.alias("swapped"), F.sha2(F.when(bit, F.col("b")).otherwise(F.col("a")), 256).alias("first"))


# Stale answers, memo of repeated work
@query("WITH m AS (SELECT comparisonid, annotatorid, dimension, max(revision) AS r FROM preferences WHERE annotatorid IS NOT NULL GROUP BY 1, 2, 3) SELECT p.dimension, count(*)::BIGINT AS stale FROM preferences p JOIN m USING (comparisonid, annotatorid, dimension) WHERE revision < r GROUP BY 1")
def stale_responses(s, d):
    p = table(s, d, "preferences").filter("annotatorid is not null")
    top = F.max("revision").over(Window.partitionBy("comparisonid", "annotatorid", "dimension"))
    return p.withColumn("r", top).filter("revision < r").groupBy("dimension").agg(F.count(F.lit(1)).alias("stale"))


@query("SELECT count(*)::BIGINT AS calls, sum(n)::BIGINT AS uses FROM (SELECT sha256(content) AS k, count(*) AS n FROM posts WHERE content IS NOT NULL GROUP BY 1)")
def memo_calls(s, d):
    k = table(s, d, "posts").filter("content is not null").groupBy(F.sha2("content", 256).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return k.agg(F.count(F.lit(1)).alias("calls"), F.sum("n").alias("uses"))


# harness
_RUN = "SELECT comparisonid, annotatorid, dimension, arg_{f}(lower(trim(choice)), (revision, coalesce(lower(trim(choice)), ''))) AS choice, arg_{f}(reason, (revision, coalesce(lower(trim(choice)), ''), coalesce(reason, ''))) AS reason FROM preferences WHERE annotatorid IS NOT NULL AND dimension IS NOT NULL AND choice IS NOT NULL GROUP BY 1, 2, 3"


@query(f"WITH a AS ({_RUN.format(f='min')}), b AS (SELECT * FROM ({_RUN.format(f='max')}) WHERE sha256(annotatorid) < 'f'), j AS (SELECT coalesce(a.dimension, b.dimension) AS dimension, a.annotatorid IS NOT NULL AS ia, b.annotatorid IS NOT NULL AS ib, a.choice IS NOT DISTINCT FROM b.choice AS same FROM a FULL JOIN b ON a.comparisonid = b.comparisonid AND a.annotatorid = b.annotatorid AND a.dimension = b.dimension) SELECT dimension, count(*) FILTER (WHERE ia)::BIGINT AS n_a, count(*) FILTER (WHERE ib)::BIGINT AS n_b, count(*) FILTER (WHERE ia AND ib)::BIGINT AS shared, count(*) FILTER (WHERE ia AND ib AND same)::BIGINT AS equal, bool_and(ia AND ib AND same) AS holds FROM j GROUP BY 1")
def controlled_gate(s, d):
    """Two runs held against each other: first answers of all annotators, last answers of those whose hash is below f."""
    p = table(s, d, "preferences").filter("annotatorid is not null and dimension is not null and choice is not null").withColumn("choice", F.lower(F.trim("choice")))
    key, order = ["comparisonid", "annotatorid", "dimension"], F.struct("revision", F.coalesce("choice", F.lit("")))
    a = p.groupBy(*key).agg(F.min_by("choice", order).alias("choice"))
    b = p.filter(F.sha2("annotatorid", 256) < "f").groupBy(*key).agg(F.max_by("choice", order).alias("choice"))
    return E.compare_runs(a, b, key, ["choice"], "dimension")


@query("SELECT type, count(*)::BIGINT AS n FROM (SELECT 'input' AS type FROM comparisons UNION ALL SELECT 'candidate' FROM (SELECT unnest([left_text, right_text]) FROM comparisons) UNION ALL SELECT 'diagnostic' FROM (SELECT unnest(private.features) FROM comparisons)) GROUP BY 1")
def record_stream(s, d):
    c = table(s, d, "comparisons")
    parts = [c.select(F.lit("input").alias("type"), F.col("comparisonid").alias("id")), c.select(F.lit("candidate").alias("type"), F.explode(F.array("left_text", "right_text")).alias("text")), c.select(F.lit("diagnostic").alias("type"), F.explode("private.features").alias("f"))]
    u = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2].select("type"), allowMissingColumns=True)
    return u.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


_CAP = "c AS (SELECT DISTINCT ON (case_id) case_id, source, analysis FROM ginza_discourse_modesty ORDER BY case_id, capturedat), tk AS (SELECT case_id, t.* FROM (SELECT case_id, unnest(analysis.tokens) AS t FROM c))"


# Token predicates and intents
@query(f"WITH {_CAP} SELECT pos, count(*)::BIGINT AS n, count(*) FILTER (WHERE len(list_filter(morphology, lambda m: contains(m, '形'))) > 0)::BIGINT AS inflected, count(*) FILTER (WHERE id = head)::BIGINT AS roots FROM tk GROUP BY 1")
def token_predicates(s, d):
    t = C.tokens(C.cases(table(s, d, "ginza_discourse_modesty")))
    return t.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.exists("morphology", lambda m: F.contains(m, F.lit("形")))).alias("inflected"), F.count_if(F.col("id") == F.col("head")).alias("roots"))


@query()
def intent_plans(s, d):
    f = C.facts(C.tokens(C.cases(table(s, d, "ginza_discourse_modesty"))))
    has = lambda c: F.bool_or(c)
    p = f.groupBy("case_id").agg(has(F.col("realization") == "conditional").alias("cond"), has(F.col("polarity") == "negative").alias("neg"), has(F.col("tense") == "past").alias("past"), F.count_distinct("predicate").alias("n"))
    return p.select("case_id", F.when(F.col("cond"), "condition").when(F.col("neg") & F.col("past"), "failure").when(F.col("neg"), "refusal").when(F.col("past"), "report").otherwise("statement").alias("intent"), "n")


@query()
def fact_comparison(s, d):
    f = materialize(C.facts(C.tokens(C.cases(table(s, d, "ginza_discourse_modesty")))), "facts")
    return C.compare_facts(f, f.filter("role is not null"), ["case_id", "lemma"], ["polarity", "tense", "realization"])


# Topic terms by word weights
@query(r"WITH tok AS (SELECT replace(lower(trim(source)), '-', '_') AS src, doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents WHERE text IS NOT NULL), tf AS (SELECT src, doc_id, term, count(*) AS n FROM tok GROUP BY 1, 2, 3), df AS (SELECT term, count(DISTINCT doc_id) AS df FROM tf GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2), w AS (SELECT src, term, round(sum((1 + ln(n)) / ln(1 + df)), 4) AS weight FROM tf JOIN df USING (term) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, term) AS rank FROM w) SELECT src, term, weight::DOUBLE AS weight, rank::INTEGER AS rank FROM r WHERE rank <= 15")
def topic_terms(s, d):
    t = docs(s, d).select(tidy().alias("src"), "doc_id", F.explode(T.words(F.col("text"))).alias("term")).groupBy("src", "doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    t = materialize(t, "tf")
    df = t.groupBy("term").agg(F.count_distinct("doc_id").alias("df")).filter("df >= 2")
    w = t.join(df, "term").groupBy("src", "term").agg(F.round(F.sum((1 + F.log("n")) / F.log(1 + F.col("df"))), 4).alias("weight"))
    return V.top_k(w, ["src"], [F.desc("weight"), "term"], 15).select("src", "term", "weight", "rank")


# bootstrap
@query()
def bootstrap_values(s, d):
    return K.bootstrap_mean(table(s, d, "events"), "value", "event_id")


# Anchors, brackets, concepts, distances
_USE = "CASE " + " ".join(f"WHEN regexp_matches(regexp_replace(content, '>>[0-9]+', ' ', 'g'), '{p}') THEN '{k}'" for k, p in X.ANCHOR_USE) + " ELSE 'unknown' END"


@query(r"SELECT CASE WHEN content IS NULL THEN NULL WHEN regexp_matches(content, '^\s*>>[0-9]+\s*$') THEN 'standalone' WHEN regexp_matches(content, '^\s*>>[0-9]+') THEN 'prefix' WHEN regexp_matches(content, '>>[0-9]+\s*$') THEN 'suffix' WHEN regexp_matches(content, '>>[0-9]+') THEN 'inline' ELSE 'none' END AS placement, CASE WHEN regexp_matches(content, '>>[0-9]+') THEN " + _USE + " END AS use, count(*)::BIGINT AS n FROM posts GROUP BY 1, 2")
def anchor_usage(s, d):
    return table(s, d, "posts").groupBy(X.anchor_placement(F.col("content")).alias("placement"), X.anchor_use(F.col("content")).alias("use")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH x AS (SELECT doc_id, substr(text, 1, length(text) // 2) AS h FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(regexp_extract_all(h, '[「『（(【《〈\\[{«“]')) > len(regexp_extract_all(h, '[」』）)】》〉\\]}»”]')) AS inside FROM x")
def inside_enclosures(s, d):
    return docs(s, d).select("doc_id", X.inside_brackets(F.col("text"), F.floor(F.length("text") / 2).cast("int")).alias("inside"))


@query("WITH c(w, k) AS (VALUES " + ", ".join(f"('{w}', '{k}')" for w, k in X.CONCEPTS) + "), h AS (SELECT DISTINCT doc_id, k FROM documents JOIN c ON contains(lower(text), w)) SELECT k AS concept, count(*)::BIGINT AS documents FROM h GROUP BY 1")
def concept_counts(s, d):
    return docs(s, d).select("doc_id", F.explode(X.concepts(F.col("text"))).alias("concept")).groupBy("concept").agg(F.count(F.lit(1)).alias("documents"))


@query("SELECT p_partkey, levenshtein(p_type, p_name)::INTEGER AS distance, round(1 - levenshtein(p_type, p_name) / greatest(length(p_type), length(p_name)), 6)::DOUBLE AS ratio FROM part")
def name_distances(s, d):
    return table(s, d, "part").select("p_partkey", F.levenshtein("p_type", "p_name").alias("distance"), F.round(X.fuzzy_ratio(F.col("p_type"), F.col("p_name")), 6).alias("ratio"))


# Diversity text, kana
_KATA = "".join(chr(x) for x in range(0x30A1, 0x30F7))


@query("SELECT doc_id, sha256(translate(text, '" + _KATA + "', '" + "".join(chr(ord(x) - 0x60) for x in _KATA) + "')) AS folded FROM documents WHERE text IS NOT NULL")
def kana_forms(s, d):
    return docs(s, d).select("doc_id", F.sha2(K.fold_kana(F.col("text")), 256).alias("folded"))


@query()
def diversity_forms(s, d):
    return docs(s, d).select("doc_id", F.sha2(K.diversity_text(F.col("text")), 256).alias("diversity"))


# Two analysed texts compared, each case with the next
_IR = f"""{_CAP}, ir AS (SELECT c.case_id, list_sort(regexp_extract_all(source, '[0-9]+')) AS quantity, len(regexp_extract_all(source, '{K.NEGATION}')) % 2 AS polarity, regexp_matches(source, '{K.DONE}') AS temporal, list_sort(regexp_extract_all(source, '「[^」]*」')) AS attribution, (SELECT list_sort(list(DISTINCT text)) FROM tk WHERE tk.case_id = c.case_id AND pos = 'NOUN') AS roles, len(analysis.tokens) AS size FROM c WHERE source IS NOT NULL)"""


@query(f"WITH {_IR}, p AS (SELECT a.case_id, a AS x, b AS y FROM ir a JOIN ir b ON b.case_id = a.case_id + 1) " + " UNION ALL ".join(f"SELECT case_id, '{k}' AS code, CASE WHEN x.{k} IS NULL OR y.{k} IS NULL THEN 'unknown' WHEN x.{k} = y.{k} THEN 'pass' ELSE 'fail' END AS status FROM p" for k in ("quantity", "polarity", "temporal", "attribution", "roles", "size")))
def ir_comparison(s, d):
    """Six checks between the analyses of each case and the next; what a side does not tell is unknown, and only for that check."""
    c = materialize(C.cases(table(s, d, "ginza_discourse_modesty")), "cases")
    found = lambda p: F.array_sort(F.regexp_extract_all("source", F.lit(p), F.lit(0)))
    nouns = C.tokens(c).filter("pos = 'NOUN'").groupBy("case_id").agg(F.array_sort(F.collect_set("text")).alias("roles"))
    ir = c.filter("source is not null").join(nouns, "case_id", "left").select(
        "case_id", found("[0-9]+").alias("quantity"), (F.regexp_count("source", F.lit(K.NEGATION)) % 2).alias("polarity"), F.col("source").rlike(K.DONE).alias("temporal"),
        found("「[^」]*」").alias("attribution"), "roles", F.size("analysis.tokens").alias("size"),
    )
    return C.compare_analyses(ir, ir.withColumn("case_id", F.col("case_id") - 1), "case_id", ["quantity", "polarity", "temporal", "attribution", "roles", "size"])


# Output offsets
@query(f"WITH {_CAP}, t AS (SELECT case_id, id AS edit_id, span.start AS start, span.end AS e, '<' || text || '>' AS new FROM tk WHERE id % 4 = 0) SELECT case_id, edit_id, (start + coalesce(sum(length(new) - (e - start)) OVER (PARTITION BY case_id ORDER BY start, edit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS out_start FROM t")
def output_offsets(s, d):
    from lexispark.operators import spans as P

    t = C.tokens(C.cases(table(s, d, "ginza_discourse_modesty"))).filter("id % 4 = 0")
    return P.output_offsets(t.select("case_id", F.col("id").alias("edit_id"), "start", "end", F.concat(F.lit("<"), "text", F.lit(">")).alias("to")), "case_id").select("case_id", "edit_id", "out_start")


