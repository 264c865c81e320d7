"""Queries that link quotes, headings, lines and posts, and order or rewrite the lines of a post by grammar tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions import patterns as P
from lexispark.functions import text as T
from lexispark.operators import grammar as G
from lexispark.operators import linking as L
from lexispark.operators.skew import running_sum
from lexispark.plans.rule_queries import _ORDER, LINES, lines, q, ranked, sql_first
from lexispark.plans.text_queries import _KEY, _SET, _presence
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


# Quotes and posts, with status
_QUOTES = f"qs AS (SELECT DISTINCT line, post_id, text FROM sections WHERE text IS NOT NULL AND length(text) <= 60), qq AS (SELECT line, post_id, {_KEY.format(c='text')} AS k FROM qs UNION SELECT line, post_id, " + _KEY.format(c="regexp_replace(text, '[（(][^）)]*[）)]', '', 'g')") + " FROM qs), qk AS (SELECT * FROM qq WHERE k <> '')"
_HAY = f"ps AS (SELECT DISTINCT id, {_KEY.format(c='content')} AS k FROM posts WHERE content IS NOT NULL)"


@query(f"WITH {_QUOTES}, {_HAY}, ca AS (SELECT DISTINCT qk.line, ps.id, bool_or(qk.post_id = ps.id) AS near FROM qk JOIN ps ON contains(ps.k, qk.k) GROUP BY 1, 2), sh AS (SELECT line, bool_or(length(k) < 5) AS short FROM qk GROUP BY 1), ag AS (SELECT line, count(*) AS n, count(*) FILTER (WHERE near) AS c, min(id) FILTER (WHERE near) AS ni, min(id) AS ai FROM ca GROUP BY 1) SELECT sh.line, coalesce(n, 0)::BIGINT AS candidates, CASE WHEN c > 0 THEN c ELSE coalesce(n, 0) END::BIGINT AS selected, CASE WHEN n IS NULL THEN 'unmatched' WHEN (CASE WHEN c > 0 THEN c ELSE n END) = 1 AND (NOT short OR c > 0) THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN (CASE WHEN c > 0 THEN c ELSE n END) = 1 AND (NOT short OR c > 0) THEN CASE WHEN c > 0 THEN ni ELSE ai END END AS id FROM sh LEFT JOIN ag USING (line)")
def quote_links(s: SparkSession, d: str) -> DataFrame:
    """Quotes of at most 60 characters: posts that hold one of two normal forms; the recorded post is preferred, a form of fewer than
    five characters needs it, and all candidates count as leakage.
    """
    qs = table(s, d, "sections").filter("text is not null and length(text) <= 60").select("line", "post_id", "text").distinct()
    bare = F.regexp_replace("text", "[（(][^）)]*[）)]", "")
    forms = qs.select("line", "post_id", F.explode(F.array(_presence(F.col("text")), _presence(bare))).alias("text")).filter("text <> ''").distinct()
    forms = materialize(forms, "quotes")
    hay = materialize(table(s, d, "posts").filter("content is not null").select("id", _presence(F.col("content")).alias("text")).distinct(), "hay")
    return L.quote_status(forms, hay)


# Posts and series
@query(f"WITH pg AS (SELECT DISTINCT category AS series, {_KEY.format(c='text')} AS k FROM sections WHERE text IS NOT NULL AND category IS NOT NULL), np AS (SELECT DISTINCT id, {_KEY.format(c='split_part(content, chr(10), 1)')} AS k, {_KEY.format(c='threadtitle')} AS t FROM posts WHERE content IS NOT NULL), m AS (SELECT DISTINCT np.id, series FROM np JOIN pg ON length(np.k) >= 6 AND contains(pg.k, np.k)), c AS (SELECT id, count(*) AS n, min(series) AS series FROM m GROUP BY 1) SELECT DISTINCT np.id, CASE WHEN n IS NULL THEN 'unclassified' WHEN n = 1 THEN 'assigned' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN series END AS series FROM np LEFT JOIN c USING (id)")
def series_of_posts(s, d):
    """The one section category in which a post's first line stands; several are ambiguous, none is unclassified."""
    pages = table(s, d, "sections").filter("text is not null and category is not null").select(F.concat_ws("|", "category", "line").alias("page"), "category", _presence(F.col("text")).alias("text")).distinct()
    posts = table(s, d, "posts").filter("content is not null").select("id", _presence(F.split_part("content", F.lit("\n"), F.lit(1))).alias("text")).distinct()
    hits = L.containment(posts, materialize(pages.select("page", "text"), "pages"), "id", "page").select("id", F.split_part("page", F.lit("|"), F.lit(1)).alias("series")).distinct()
    n = hits.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("series").alias("series"))
    status = F.when(F.col("n").isNull(), "unclassified").when(F.col("n") == 1, "assigned").otherwise("ambiguous")
    return posts.select("id").distinct().join(n, "id", "left").select("id", status.alias("status"), F.when(F.col("n") == 1, F.col("series")).alias("series"))


# Sections, headings and excerpts of the log
_ONE = "one AS (SELECT line, min(category) AS category, min(text) AS text FROM sections GROUP BY 1), se AS (SELECT *, sum((category = 'section_title')::INTEGER) OVER (ORDER BY line) AS section, sum((category = 'post_header')::INTEGER) OVER (ORDER BY line) AS post FROM one)"


def _sections(s, d) -> DataFrame:
    one = table(s, d, "sections").groupBy("line").agg(F.min("category").alias("category"), F.min("text").alias("text"))
    is_ = lambda c: F.coalesce((F.col("category") == c).cast("bigint"), F.lit(0))
    a = running_sum(one.withColumn("t", is_("section_title")), [], [F.col("line")], "t", "section")
    return running_sum(a.withColumn("h", is_("post_header")), [], [F.col("line")], "h", "post").drop("t", "h")


@query(f"WITH {_ONE} SELECT line, section::BIGINT AS section, post::BIGINT AS post, CASE WHEN category = 'section_title' THEN 'heading' WHEN category = 'post_header' THEN 'header' WHEN section > 0 AND post > 0 AND category = 'body' THEN 'excerpt' ELSE 'other' END AS kind FROM se")
def section_states(s, d):
    kind = F.when(F.col("category") == "section_title", "heading").when(F.col("category") == "post_header", "header").when((F.col("section") > 0) & (F.col("post") > 0) & (F.col("category") == "body"), "excerpt").otherwise("other")
    return _sections(s, d).select("line", "section", "post", kind.alias("kind"))


@query(f"WITH {_ONE}, h AS (SELECT line, section, list_sort(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS w FROM se WHERE category = 'section_title' AND text IS NOT NULL), e AS (SELECT line, section, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM se WHERE category = 'body' AND text IS NOT NULL) SELECT h.line AS heading, e.line AS excerpt, len(list_intersect(h.w, e.w))::INTEGER AS shared FROM h JOIN e USING (section) WHERE len(list_intersect(h.w, e.w)) > 0")
def heading_excerpts(s, d):
    x = materialize(_sections(s, d).filter("text is not null"), "sections").withColumn("w", F.array_distinct(T.words(F.col("text"))))
    h = x.filter("category = 'section_title'").select(F.col("line").alias("heading"), "section", F.col("w").alias("a"))
    e = x.filter("category = 'body'").select(F.col("line").alias("excerpt"), "section", F.col("w").alias("b"))
    return h.join(e, "section").withColumn("shared", F.size(F.array_intersect("a", "b"))).filter("shared > 0").select("heading", "excerpt", "shared")


# Quotations as context of sentences
_CAP = "c AS (SELECT DISTINCT ON (case_id) case_id, source, analysis FROM ginza_discourse_modesty ORDER BY case_id, capturedat)"


@query(f"WITH {_CAP}, se AS (SELECT case_id, unnest(analysis.sentences) AS z FROM c), sp AS (SELECT case_id, unnest(range(1, length(source) + 1)) AS i, source FROM c), op AS (SELECT case_id, i - 1 AS a, source FROM sp WHERE substr(source, i, 1) = '「'), sc AS (SELECT case_id, a, a + instr(substr(source, (a + 1)::INTEGER), '」') AS b FROM op WHERE instr(substr(source, (a + 1)::INTEGER), '」') > 0) SELECT se.case_id, z.start AS start, count(sc.a)::BIGINT AS scopes FROM se LEFT JOIN sc ON sc.case_id = se.case_id AND sc.a < z.end AND sc.b > z.start GROUP BY 1, 2")
def sentence_scopes(s, d):
    from lexispark.operators import captures as C

    c = materialize(C.cases(table(s, d, "ginza_discourse_modesty")), "cases")
    at = c.select("case_id", "source", F.explode(F.filter(F.sequence(F.lit(1), F.length("source")), lambda i: F.substring("source", i, F.lit(1)) == "「")).alias("i"))
    close = F.locate("」", F.substring("source", F.col("i"), F.length("source")))
    scopes = at.withColumn("n", close).filter("n > 0").select("case_id", (F.col("i") - 1).alias("a"), (F.col("i") - 1 + F.col("n")).alias("b"))
    j = C.sentences(c).alias("s").join(scopes.alias("q"), (F.col("s.case_id") == F.col("q.case_id")) & (F.col("q.a") < F.col("s.end")) & (F.col("q.b") > F.col("s.start")), "left")
    return j.groupBy(F.col("s.case_id").alias("case_id"), F.col("s.start").alias("start")).agg(F.count("q.a").alias("scopes"))


# The line of the linked post that is nearest to a quote, with its neighbours
@query(f"WITH qs AS (SELECT DISTINCT line, post_id, text FROM sections WHERE text <> '' AND post_id IS NOT NULL), {LINES}, g AS (SELECT qs.line AS qline, x.id, x.n, {_SET.format(c='qs.text')} AS a, {_SET.format(c='x.line')} AS b FROM qs JOIN x ON x.id = qs.post_id), r AS (SELECT qline, id, n, round(2 * len(list_intersect(a, b)) / greatest(len(a) + len(b), 1), 6) AS score FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY qline, id ORDER BY score DESC, n) AS k, lag(n) OVER (PARTITION BY qline, id ORDER BY n) AS before, lead(n) OVER (PARTITION BY qline, id ORDER BY n) AS after FROM (SELECT qline, id, n, max(score) AS score FROM r GROUP BY 1, 2, 3)) SELECT qline AS line, id, n, score::DOUBLE AS score, before, after FROM k WHERE k = 1")
def quote_contexts(s, d):
    qs = table(s, d, "sections").filter("text <> '' and post_id is not null").select(F.col("line").alias("qline"), F.col("post_id").alias("id"), "text").distinct()
    g = qs.join(lines(s, d), "id").select("qline", "id", "n", F.round(T.dice(T.gram_set(F.col("text")), T.gram_set(F.col("line"))), 6).alias("score"))
    w = Window.partitionBy("qline", "id")
    k = g.groupBy("qline", "id", "n").agg(F.max("score").alias("score")).withColumn("k", F.row_number().over(w.orderBy(F.desc("score"), "n"))).withColumn("before", F.lag("n").over(w.orderBy("n"))).withColumn("after", F.lead("n").over(w.orderBy("n")))
    return k.filter("k = 1").select(F.col("qline").alias("line"), "id", "n", "score", "before", "after")


# Relations of lines, and orders of telling
# Marks of how a line stands to the next, in order.
RELATIONS = [("reported_by", "と言っ|という|曰く|って言"), ("conditional_on", "なら|たら|れば"), ("explicit_cause", "ので|から[、。]?$|だから"), ("contrast", "けれど|けど|のに|しかし|だが|が、")]


@query(f"WITH {_ORDER}, g AS (SELECT id, k, {sql_first('line', RELATIONS)} AS type, lead(k) OVER (PARTITION BY id ORDER BY k) AS nxt FROM v) SELECT id, type, k::INTEGER AS from_line, nxt::INTEGER AS to_line FROM g WHERE type IS NOT NULL AND nxt IS NOT NULL")
def relation_edges(s, d):
    x = ranked(s, d).withColumn("type", P.first(F.col("line"), RELATIONS)).withColumn("to_line", F.lead("k").over(Window.partitionBy("id").orderBy("k")))
    return x.filter("type is not null and to_line is not null").select("id", "type", F.col("k").alias("from_line"), "to_line")


PLANS = {
    "chronological": {"setting": 0}, "result-first": {"result": 0, "setting": 1}, "turning-first": {"problem": 0, "reveal": 1, "action": 2, "result": 3},
    "status": {"result": 0, "problem": 1, "background": 2, "future": 3, "evaluation": 4, "dialogue": 5},
}


def _sql_rank(ranks: dict) -> str:
    return "CASE " + " ".join(f"WHEN role = '{r}' THEN {i}" for r, i in ranks.items()) + " ELSE 99 END"


@query(f"WITH {_ORDER}, a AS (" + " UNION ALL ".join(f"SELECT id, k, '{p}' AS plan, {_sql_rank(r)} AS rank FROM v" for p, r in PLANS.items()) + ") SELECT id, plan, k::INTEGER AS k, row_number() OVER (PARTITION BY id, plan ORDER BY rank, k)::INTEGER AS place FROM a")
def narrative_orders(s, d):
    v = ranked(s, d).withColumn("role", P.surface_role(F.col("line"), F.col("k") - 1))
    return G.ordered(v, "id", "role", "k", PLANS)


# LG9, LG11: clauses split and reworded
CLAUSES = "^(.*?)(?:て、|で、|し、|ので、|から、|、)(.+)$"
# Rewordings of a line, of which the first that fits is taken; quotes are masked.
REWORDINGS = [("から、", "ので、"), ("けど、", "が、"), ("しかし", "だが"), ("だけだ", "にすぎない"), ("ほど", "くらい"), ("まま", "ままの状態で")]


@query(f"WITH {LINES} SELECT id, n, regexp_extract(line, '{CLAUSES}', 1) AS action, regexp_extract(line, '{CLAUSES}', 2) AS result FROM x WHERE regexp_matches(line, '{CLAUSES}')")
def clause_pairs(s, d):
    return lines(s, d).filter(F.col("line").rlike(CLAUSES)).select("id", "n", F.regexp_extract("line", CLAUSES, 1).alias("action"), F.regexp_extract("line", CLAUSES, 2).alias("result"))


@query(f"WITH {LINES}, m AS (SELECT id, n, line, string_split_regex(line, '「[^」]*」') AS parts, regexp_extract_all(line, '「[^」]*」') AS kept FROM x), o AS (SELECT *, array_to_string(parts, chr(983040)) AS t FROM m), r AS (SELECT *, CASE " + " ".join(f"WHEN contains(t, {q(a)}) THEN regexp_replace(t, {q(a)}, {q(b)}, 'g')" for a, b in REWORDINGS) + " END AS w FROM o) SELECT id, n, array_to_string(list_transform(string_split(w, chr(983040)), lambda z, i: z || coalesce(kept[i], '')), '') AS reworded FROM r WHERE w IS NOT NULL")
def reworded_facts(s, d):
    held, kept = P.mask(F.col("line"), "「[^」]*」")
    x = lines(s, d).select("id", "n", held.alias("m"), kept.alias("kept"))
    new = F.coalesce(*[F.when(F.contains("m", F.lit(a)), F.replace("m", F.lit(a), F.lit(b))) for a, b in REWORDINGS])
    return x.withColumn("w", new).filter("w is not null").select("id", "n", P.unmask(F.col("w"), F.col("kept")).alias("reworded"))


# Guards of rewriting
# What forbids rewriting a line.
GUARDS = [
    ("quoted", "[「『“«„]"), ("link", "https?://"), ("mail", "[A-Za-z0-9]@[A-Za-z0-9]"), ("anchor", ">>[0-9]+|＞＞[0-9]+"), ("question", "[？?]"), ("negated", "ない|なかった|never|not |nicht"),
    ("reported", "らしい|という|曰く|said|says"), ("conditional", "なら|たら|れば| if "), ("future", "予定|明日|来週|will "), ("speculative", "かもしれ|だろう|maybe|perhaps"), ("imperative", "しろ|するな|ください|くれ"),
    ("open_bracket", "[（(][^）)]*$"), ("range", "[0-9]+[〜~-][0-9]+"), ("identifier", "[A-Z][A-Za-z]*[.-][0-9]+"), ("laugh", "[wｗ]{2,}|（笑）"), ("damaged", "�"), ("ellipsis", "…|\\.\\.\\."), ("foreign", "^[A-Za-z ,.'’]+$"),
]


@query(f"WITH {LINES} SELECT id, n, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(line, {q(p)}) THEN '{k}' END" for k, p in GUARDS) + "], lambda z: z IS NOT NULL) AS guards FROM x")
def rewrite_guards(s, d):
    return lines(s, d).select("id", "n", P.labels(F.col("line"), GUARDS).alias("guards"))


# Constructions, their plans and proofs
CONSTRUCTIONS = [("claim-reason", "^([^、。「」]{2,40})は、?([^。「」]{2,60})。$", "{b}のは{a}だ。"), ("time-action", "^(きのう|今日|明日)([^。「」]{2,60})。$", "{b}、それが{a}のこと。"), ("place-event", "^([^、。「」]{2,20})で([^、。「」]{2,40})。?$", "{b}、しかも{a}で。")]
_BOUND = "bo AS (" + " UNION ALL ".join(f"SELECT id, n, line, '{i}' AS construction, regexp_extract(line, '{p}', 1) AS a, regexp_extract(line, '{p}', 2) AS b, '{t}' AS t FROM x WHERE regexp_matches(line, '{p}')" for i, p, t in CONSTRUCTIONS) + "), re AS (SELECT *, replace(replace(t, '{{a}}', a), '{{b}}', b) AS text FROM bo)".replace("{{", "{").replace("}}", "}")


@query(f"WITH {LINES}, {_BOUND} SELECT id, n, construction, a, b, text FROM re")
def construction_bindings(s, d):
    return G.bound(lines(s, d), ["id", "n"], "line", CONSTRUCTIONS)


@query(f"WITH {LINES}, {_BOUND} SELECT construction, count(*)::BIGINT AS n, count(*) FILTER (WHERE starts_with(line, a) AND contains(line, b) AND length(text) = length(t) - 6 + length(a) + length(b))::BIGINT AS proven FROM re GROUP BY 1")
def construction_proofs(s, d):
    """The slots are looked up in the line again, without the pattern that bound them, and the text's length is counted from its parts."""
    b = G.bound(lines(s, d), ["id", "n", "line"], "line", CONSTRUCTIONS)
    t = F.coalesce(*[F.when(F.col("construction") == i, F.length(F.lit(x))) for i, _, x in CONSTRUCTIONS])
    ok = F.startswith("line", "a") & F.contains("line", "b") & (F.length("text") == t - 6 + F.length("a") + F.length("b"))
    return b.groupBy("construction").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("proven"))


@query(f"WITH {LINES}, {_BOUND}, pl AS (SELECT DISTINCT id, n, construction AS plan, 1 AS s, 1 + length(a) AS e FROM re), ed AS (SELECT DISTINCT id, n, k AS edit, instr(line, k) AS s, instr(line, k) + length(k) AS e FROM x, (VALUES " + ", ".join(f"('{a}')" for a, _ in REWORDINGS) + ") r(k) WHERE contains(line, k)) SELECT pl.id, pl.n, plan, edit FROM pl JOIN ed ON pl.id = ed.id AND pl.n = ed.n WHERE ed.e <= pl.s OR ed.s >= pl.e")
def construction_plans(s, d):
    x = lines(s, d)
    p = G.bound(x, ["id", "n"], "line", CONSTRUCTIONS).select("id", "n", F.col("construction").alias("plan"), F.lit(1).alias("start"), (F.length("a") + 1).alias("end")).distinct()
    e = F.array_compact(F.array(*[F.when(F.contains("line", F.lit(a)), F.struct(F.lit(a).alias("edit"), F.locate(a, F.col("line")).alias("start"), (F.locate(a, F.col("line")) + len(a)).alias("end"))) for a, _ in REWORDINGS]))
    return G.without_conflicts(p, x.select("id", "n", F.explode(e).alias("e")).select("id", "n", "e.*").distinct(), ["id", "n"])


# LG1, LG2, LG3, LG4, LG5, LG10, LG13, L1: template grammars
OPENERS, STEMS, ENDINGS = ["まず", "正直", "やはり"], ["その件は", "担当者は", "問題は"], ["かもしれない", "だけだ", "だった", "と言った", "らしい", "決まっている"]
FRAMES = [(f"{b}-{i}", b, e, r) for b in ("雑談倉庫", "料理帳", "技術相談", "記録保管") for i, (e, r) in enumerate((("だけだ", "problem"), ("かかった", "result"), ("存在しない句", "setting")))]


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(q(str(x)) for x in r) + ")" for r in rows) + ")"


def _endings(s, d) -> DataFrame:
    t = s.createDataFrame([(e, e) for e in ENDINGS], "template string, evidence string")
    return G.evidenced(t, table(s, d, "posts").filter("content is not null").select("content").distinct(), "content")


_EVID = f"ev AS (SELECT t.ending, count(p.content) AS support FROM {_values([(e,) for e in ENDINGS])} t(ending) LEFT JOIN (SELECT DISTINCT content FROM posts WHERE content IS NOT NULL) p ON contains(p.content, t.ending) GROUP BY 1)"


@query(f"WITH {_EVID}, b AS (SELECT DISTINCT board FROM posts WHERE board IS NOT NULL), o AS (SELECT board, op || st || ending AS text FROM b, {_values([(x,) for x in OPENERS])} a(op), {_values([(x,) for x in STEMS])} c(st), ev WHERE support > 0) SELECT board, text, turn::INTEGER AS turn FROM (SELECT *, row_number() OVER (PARTITION BY board ORDER BY sha256('variation|' || board || '|' || text), text) AS turn FROM o) WHERE turn <= 4")
def variation_draws(s, d):
    """Openers, stems and endings that the corpus holds; four per board in hash order. The tables are written by hand and small."""
    ends = _endings(s, d).filter("support > 0").select(F.col("template").alias("e"))
    head = F.explode(F.array(*[F.lit(a + b) for a in OPENERS for b in STEMS]))
    boards = table(s, d, "posts").filter("board is not null").select("board").distinct()
    o = ends.select("e", head.alias("h")).select(F.concat("h", "e").alias("text"))
    return G.drawn(boards.join(F.broadcast(o)), ["board"], ["text"], 4, "variation").select("board", "text", "turn")


@query(f"WITH f AS (SELECT * FROM {_values(FRAMES)} t(template, board, evidence, role)), p AS (SELECT DISTINCT board, content FROM posts WHERE content IS NOT NULL AND board IS NOT NULL), c AS (SELECT template, count(*) AS n FROM f JOIN p ON p.board = f.board AND contains(p.content, f.evidence) GROUP BY 1) SELECT template, role, coalesce(n, 0)::BIGINT AS support, n IS NOT NULL AS enabled FROM f LEFT JOIN c USING (template)")
def frame_evidence(s, d):
    """Frames of each board with the posts of the same board that hold their evidence; without any a frame is disabled."""
    f = s.createDataFrame(FRAMES, "template string, board string, evidence string, role string")
    e = G.evidenced(f, table(s, d, "posts").filter("content is not null and board is not null").select("board", "content").distinct(), "content", "board")
    return e.select("template", "role", "support", (F.col("support") > 0).alias("enabled"))


@query(f"WITH f AS (SELECT * FROM {_values(FRAMES)} t(template, board, evidence, role)), {_ORDER}, b AS (SELECT id, min(board) AS board FROM posts WHERE board IS NOT NULL GROUP BY 1), o AS (SELECT DISTINCT v.id, f.template FROM v JOIN b USING (id) JOIN f ON f.board = b.board AND f.role = v.role) SELECT id, template, turn::INTEGER AS turn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sha256('frames|' || id || '|' || template), template) AS turn FROM o) WHERE turn <= 36")
def frame_candidates(s, d):
    """Frames whose role some line of a post of the same board plays: at most 36 per post, without replacement, in hash order."""
    f = F.broadcast(s.createDataFrame(FRAMES, "template string, board string, evidence string, role string"))
    b = table(s, d, "posts").filter("board is not null").groupBy("id").agg(F.min("board").alias("board"))
    v = ranked(s, d).withColumn("role", P.surface_role(F.col("line"), F.col("k") - 1)).select("id", "role").distinct()
    return G.drawn(v.join(b, "id").join(f, ["board", "role"]).select("id", "template").distinct(), ["id"], ["template"], 36, "frames").select("id", "template", "turn")
