"""Composite scores and ledgers over texts: evidence, fluency, semantics, frames, plans and their proofs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from lexispark.operators.evaluate import literal_set, retention
from lexispark.operators.skew import running
from lexispark.session import materialize

# Frames with the lexemes they need, all of which a text must hold to support the frame.
FRAMES = [("wait", "待"), ("wait", "分"), ("count", "本"), ("count", "鍵"), ("move", "moved"), ("move", "boxes"), ("none", "☃☃")]
# Patterns whose presence is a signature, in Java's and RE2's common dialect.
SIGNATURES = [("range", "[0-9]+[〜~-][0-9]+"), ("link", "https?://"), ("aside", "（[^（）]+）"), ("speech", "「[^「」]+」"), ("laugh", "[wｗ]{2,}|（笑）"), ("version", "[Vv]er\\.[0-9.]+"), ("mail", "[a-z0-9]+@[a-z0-9.-]+")]
NEGATION, IDIOM, DONE = "ない|なかった|never|nicht|not", "かもしれない|if not|not only", "した|だった|closed|moved|left"
# Penalties of fluency.
PENALTIES = [("。。", 0.2), ("[！!]{2,}", 0.1), ("  ", 0.05), ("[、，,]{2,}", 0.2), ("\\n{3,}", 0.1), ("[？?][！!]", 0.05), ("…{3,}", 0.1)]


def frame_ledger(texts: DataFrame, key: str, column: str, frames: list[tuple[str, str]] = FRAMES) -> DataFrame:
    """(frame, support, linked): how many texts hold each frame's lexemes, and whether every lexeme is held by some text.

    The frames are a small fixed table, folded into one projection; texts are scanned once.
    """
    lex = sorted({l for _, l in frames})
    seen = texts.select(key, *[F.contains(F.coalesce(F.col(column), F.lit("")), F.lit(l)).alias(f"l{i}") for i, l in enumerate(lex)])
    names = sorted({f for f, _ in frames})
    need = {f: [lex.index(l) for g, l in frames if g == f] for f in names}
    aggs = []
    for f in names:
        both = F.lit(True)
        for i in need[f]:
            both = both & F.col(f"l{i}")
        aggs += [F.count_if(both).alias(f"s_{f}")]
    aggs += [F.bool_or(F.col(f"l{i}")).alias(f"a{i}") for i in range(len(lex))]
    one = seen.agg(*aggs)
    rows = []
    for f in names:
        ok = F.lit(True)
        for i in need[f]:
            ok = ok & F.coalesce(F.col(f"a{i}"), F.lit(False))
        rows.append(F.struct(F.lit(f).alias("frame"), F.col(f"s_{f}").alias("support"), ok.alias("linked")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def signatures(c: Column) -> Column:
    """Names of the registered patterns that occur."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(n)) for n, p in SIGNATURES]))


def negations(c: Column) -> Column:
    """Negations that are no idiom."""
    return F.greatest(F.regexp_count(c, F.lit(NEGATION)) - F.regexp_count(c, F.lit(IDIOM)), F.lit(0)).cast("bigint")


def completions(c: Column) -> Column:
    """Distinct completion words asserted outside negated clauses, sorted."""
    bare = F.regexp_replace(c, r"[^。．.\n]*(?:" + NEGATION + r")[^。．.\n]*", "")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(bare, F.lit(DONE), F.lit(0))))


def fluency(c: Column) -> Column:
    """1 minus the penalties of the patterns that occur, 0 at least; null for null."""
    total = F.lit(1.0)
    for p, w in PENALTIES:
        total = total - F.when(c.rlike(p), F.lit(w)).otherwise(F.lit(0.0))
    return F.when(c.isNotNull(), F.greatest(total, F.lit(0.0)))


def semantic_score(a: Column, b: Column) -> Column:
    """0.68 n-gram retention + 0.22 equal polarity + 0.1 literals kept, less a penalty for growth beyond half; null if unknown."""
    polarity = F.when(negations(a) % 2 == negations(b) % 2, 1.0).otherwise(0.0)
    la, lb = literal_set(a), literal_set(b)
    kept = F.when(F.size(la) == 0, 1.0).otherwise(F.size(F.array_intersect(la, lb)) / F.size(la))
    growth = F.greatest(F.length(b) / F.greatest(F.length(a), F.lit(1)) - 1.5, F.lit(0.0))
    return 0.68 * retention(a, b) + 0.22 * polarity + 0.1 * kept - 0.2 * growth


def event_frame(c: Column) -> Column:
    """First frame of a fixed priority list that the text's features allow."""
    has = lambda p: c.rlike(p)
    return (
        F.when(c.isNull(), "unknown").when(has("[？?]") & has(NEGATION), "doubt").when(has("断られた|negated|verschoben"), "setback")
        .when(has("直した|fixed|solved"), "repair").when(has("待|waited|wartete"), "waiting").when(has("見落とした|lost|verloren"), "loss").when(has("[0-9]"), "count").otherwise("other")
    )


def sample_evidence(df: DataFrame, lemma: str, series: str, ident: str, k: int = 2) -> DataFrame:
    """(lemma, id): at most k pieces of evidence overall and k per series, the least ids; distinct. By top-k windows, so that
    a frequent lemma is never gathered.
    """

    def least(*group: str) -> DataFrame:
        ids = df.groupBy(*group, ident).agg(F.lit(1).alias("__one"))
        w = Window.partitionBy(*group).orderBy(ident)
        return ids.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= k).select(lemma, ident)

    return least(lemma).unionAll(least(lemma, series)).distinct()


def fronts(df: DataFrame, x: str, y: str, levels: int = 3) -> DataFrame:
    """df with front (1 is the skyline, 2 the skyline of the rest, ...), rows beyond the levels left out. Works on distinct
    (x, largest y) steps, so each level is one running maximum over distinct x.
    """
    rest = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = None
    for n in range(1, levels + 1):
        per = materialize(rest.groupBy(x).agg(F.max(y).alias("__y")), "steps")
        edge = running(per, [], [F.desc(x)], "__y", "__a", "max", before=True).filter(F.col("__a").isNull() | (F.col("__y") > F.col("__a"))).select(x, F.col("__y").alias(y))
        part = rest.join(edge, [x, y], "left_semi").withColumn("front", F.lit(n))
        out = part if out is None else out.unionByName(part)
        rest = rest.join(edge, [x, y], "left_anti")
    return out


def bootstrap_mean(df: DataFrame, value: str, key: str, rounds: int = 200) -> DataFrame:
    """(mean, lo, hi): 2.5 and 97.5 percent limits of the mean by a Poisson bootstrap; weights are hashes, so they repeat.

    Each row meets each round once, with map-side sums: what is shuffled has one row per round and partition.
    """
    u = (F.pmod(F.xxhash64(F.col(key), F.col("r")), F.lit(1_000_003)) + 0.5) / 1_000_003.0
    cut, term, w = 0.0, 0.36787944117144233, F.lit(0)
    for k in range(8):
        cut += term
        w = w + F.when(u > cut, 1).otherwise(0)
        term /= k + 1
    x = df.filter(F.col(value).isNotNull()).select(key, value).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("w", w)
    m = x.groupBy("r").agg(F.try_divide(F.sum(F.col("w") * F.col(value)), F.sum("w")).alias("m"))
    return m.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))


def diversity_text(c: Column) -> Column:
    """Pronoun classes as tags, without punctuation."""
    c = F.regexp_replace(c, "私|僕|俺|\\bI\\b|\\bich\\b", "<SELF>")
    c = F.regexp_replace(c, "あなた|君|\\byou\\b|\\bdu\\b", "<YOU>")
    return F.regexp_replace(c, r"[\p{P}&&[^<>]]", "")


def fold_kana(c: Column) -> Column:
    """Katakana as hiragana."""
    kata = "".join(chr(x) for x in range(0x30A1, 0x30F7))
    return F.translate(c, kata, "".join(chr(ord(x) - 0x60) for x in kata))


def grapheme_map(text: str) -> tuple[str, list[tuple[int, int]]]:
    """NFKC of a text by grapheme, and for each character the source span [start, end) that it comes from."""
    import unicodedata

    import regex

    out, spans = [], []
    for m in regex.finditer(r"\X", text):
        n = unicodedata.normalize("NFKC", m[0])
        out.append(n)
        spans += [(m.start(), m.end())] * len(n)
    return "".join(out), spans


