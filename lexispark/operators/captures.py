"""Document structure from captured analyses: tokens, sentences, dependency trees, propositions and facts.

Relational steps are DataFrame plans. The steps that follow a dependency tree to a fixpoint run per document in
applyInPandas; a document's tokens are bounded by its analysis.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cases(captures: DataFrame) -> DataFrame:
    """One row (case_id, source, analysis) per case: the earliest capture."""
    return captures.groupBy("case_id").agg(F.min_by(F.struct("source", "analysis"), "capturedat").alias("r")).select("case_id", "r.source", "r.analysis")


def tokens(cases_: DataFrame) -> DataFrame:
    """(case_id, id, text, lemma, pos, tag, dep, head, start, end, morphology), one row per token."""
    t = cases_.select("case_id", F.explode("analysis.tokens").alias("t"))
    return t.select("case_id", "t.id", "t.text", "t.lemma", "t.pos", "t.tag", "t.dep", "t.head", F.col("t.span.start").alias("start"), F.col("t.span.end").alias("end"), "t.morphology")


def sentences(cases_: DataFrame) -> DataFrame:
    """(case_id, start, end) of the recorded sentences."""
    return cases_.select("case_id", F.explode("analysis.sentences").alias("s")).select("case_id", "s.start", "s.end")


def simple_analyser():
    """An analyser for analyse(): runs of letters and digits are words, other characters marks; every token heads itself."""
    rx = re.compile(r"[^\W_]+|\S")

    def run(text: str) -> list[dict]:
        return [{"id": i, "text": m[0], "pos": "WORD" if m[0].isalnum() else "MARK", "head": i, "start": m.start(), "end": m.end()} for i, m in enumerate(rx.finditer(text))]

    return run


def analyse(texts: DataFrame, key: str, column: str, load=simple_analyser) -> DataFrame:
    """(key, id, text, pos, head, start, end): the tokens that an analyser gives for each text. ``load`` makes the analyser, a function from
    a text to token records; it is called once per task, so a language model is loaded once. Null texts have no tokens.
    """
    kind = dict(texts.dtypes)[key]
    names = [key, "id", "text", "pos", "head", "start", "end"]

    def run(batches):
        analyser = load()
        for b in batches:
            rows = [(k, *[t[n] for n in names[1:]]) for k, text in zip(b[key], b[column]) for t in analyser(text)]
            yield pd.DataFrame(rows, columns=names)

    return texts.filter(F.col(column).isNotNull()).select(key, column).mapInPandas(run, f"{key} {kind}, id int, text string, pos string, head int, start int, end int")


def relations(facts_: DataFrame, toks: DataFrame) -> DataFrame:
    """(case_id, type, from, to) between propositions (case_id, predicate, parent, conditional, reported) and their parents, by the tokens
    that depend on the predicate: reported_by, conditional_on, explicit_cause and contrast. Nearness alone makes no relation.
    """
    marks = toks.filter("dep in ('mark', 'fixed', 'aux')").groupBy("case_id", F.col("head").alias("predicate")).agg(F.collect_set("text").alias("marks"))
    p = facts_.filter("parent is not null").select("case_id", "predicate", "parent", "conditional", "reported").join(marks, ["case_id", "predicate"], "left")
    has = lambda *w: F.coalesce(F.arrays_overlap("marks", F.array(*[F.lit(x) for x in w])), F.lit(False))
    kind = F.when(F.col("reported"), "reported_by").when(F.col("conditional"), "conditional_on").when(has("ので", "から"), "explicit_cause").when(has("が", "けれど", "けど", "のに"), "contrast")
    r = p.withColumn("type", kind).filter("type is not null")
    back = F.col("type") == "conditional_on"
    return r.select("case_id", "type", F.when(back, F.col("parent")).otherwise(F.col("predicate")).alias("from"), F.when(back, F.col("predicate")).otherwise(F.col("parent")).alias("to"))


def assertive(scopes: DataFrame, toks: DataFrame) -> DataFrame:
    """(case_id, id, scopes, assertive): of each token how many propositions own it, by membership and not by extent, and whether it is
    in exactly one that is asserted: not negated by a condition, report or doubt.
    """
    own = scopes.select("case_id", F.explode("tokens").alias("id"), (~(F.col("conditional") | F.col("speculative") | F.col("reported") | F.col("under_condition"))).alias("free"))
    n = own.groupBy("case_id", "id").agg(F.count(F.lit(1)).alias("scopes"), F.bool_and("free").alias("free"))
    return toks.select("case_id", "id").join(n, ["case_id", "id"], "left").select("case_id", "id", F.coalesce("scopes", F.lit(0)).alias("scopes"), F.coalesce((F.col("scopes") == 1) & F.col("free"), F.lit(False)).alias("assertive"))


def focus_spans(cases_: DataFrame) -> DataFrame:
    """(case_id, kind, start, end): the first recorded sentence is adopted, what lies before and after it is omitted; a case without sentences
    is omitted whole.
    """
    first = F.array_min(F.transform("analysis.sentences", lambda z: F.struct(z["start"].alias("start"), z["end"].alias("end"))))
    x = cases_.select("case_id", F.length("source").alias("n"), first.alias("f"))
    span = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("start"), b.cast("int").alias("end"))
    parts = F.when(F.col("f").isNull(), F.array(span("omitted", F.lit(0), F.col("n")))).otherwise(
        F.array(span("adopted", F.col("f.start"), F.col("f.end")), span("omitted", F.lit(0), F.col("f.start")), span("omitted", F.col("f.end"), F.col("n"))))
    return x.select("case_id", F.explode(parts).alias("p")).select("case_id", "p.*").filter("start < end")


def validate(cases_: DataFrame) -> DataFrame:
    """(case_id, tokens, misplaced, bad_heads): how many offsets do not slice back to the token, how many heads are out of range."""
    t = cases_.select("case_id", "source", F.size("analysis.tokens").alias("n"), F.explode("analysis.tokens").alias("t"))
    sliced = F.substring("source", F.col("t.span.start") + 1, F.col("t.span.end") - F.col("t.span.start"))
    return t.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("tokens"), F.count_if(sliced != F.col("t.text")).alias("misplaced"), F.count_if((F.col("t.head") < 0) | (F.col("t.head") >= F.col("n"))).alias("bad_heads")
    )


def as_of(probes: DataFrame, toks: DataFrame) -> DataFrame:
    """(case_id, at, token_end): the last token that ends at or before each offset, null without one. By one ordered pass
    over probes and tokens together, not by comparing them.
    """
    both = probes.select("case_id", "at", F.lit(1).alias("probe"), F.lit(None).cast("int").alias("e")).unionAll(toks.select("case_id", F.col("end").alias("at"), F.lit(0).alias("probe"), F.col("end").alias("e")))
    w = Window.partitionBy("case_id").orderBy("at", "probe").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("token_end", F.last("e", ignorenulls=True).over(w)).filter("probe = 1").select("case_id", "at", "token_end")


def _depth_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    head = dict(zip(pdf["id"], pdf["head"]))
    out = []
    for i in pdf["id"]:
        seen, n = {i}, i
        while n in head and head[n] != n and head[n] in head and head[n] not in seen:
            n = head[n]
            seen.add(n)
        out.append((pdf["case_id"].iloc[0], i, len(seen) - 1))
    return pd.DataFrame(out, columns=["case_id", "id", "depth"])


def depths(toks: DataFrame) -> DataFrame:
    """(case_id, id, depth): steps from each token up to the root; a cycle or a missing head ends the walk."""
    return toks.select("case_id", "id", "head").groupBy("case_id").applyInPandas(_depth_rows, "case_id bigint, id int, depth bigint")


# Parts of speech and relations that make, extend or frame a predicate.
PREDICATE_POS = {"VERB", "ADJ"}
CLAUSE_DEPS = {"ROOT", "advcl", "acl", "ccomp", "conj", "csubj", "parataxis"}
CHAIN_DEPS = {"aux", "mark", "cop", "fixed"}
NEGATIVE = {"ない", "ぬ", "ず", "ません", "まい"}
SPECULATIVE = {"だろう", "でしょう", "かも", "らしい", "よう", "みたい"}
CONDITIONAL = {"ば", "たら", "なら", "と"}
PAST = {"た", "だ"}


def _scopes(pdf: pd.DataFrame) -> list[dict]:
    """Propositions of one document: predicates, the tokens they own by closure over heads, and flags of their chains."""
    rows = pdf.sort_values("id").to_dict("records")
    by_id = {r["id"]: r for r in rows}
    preds = [r["id"] for r in rows if r["pos"] in PREDICATE_POS or (r["dep"] in CLAUSE_DEPS and r["pos"] in {"NOUN", "PROPN"} and r["head"] == r["id"])]
    owner = {p: p for p in preds}

    def owned(i: int) -> int | None:
        path = []
        while i in by_id and i not in owner and i not in path:
            path.append(i)
            i = by_id[i]["head"]
        top = owner.get(i)
        for p in path:
            owner[p] = top
        return top

    for r in rows:
        owned(r["id"])
    out = []
    for p in preds:
        mine = [r for r in rows if owner.get(r["id"]) == p]
        chain = [r for r in mine if r["head"] == p and r["dep"] in CHAIN_DEPS]
        lemmas, texts = {r["lemma"] for r in chain}, {r["text"] for r in chain}
        up = by_id[p]["head"]
        out.append({
            "predicate": p, "parent": owned(up) if up != p else None, "tokens": [r["id"] for r in mine],
            "start": min(r["start"] for r in mine), "end": max(r["end"] for r in mine), "negative": bool((lemmas | texts) & NEGATIVE),
            "speculative": bool((lemmas | texts) & SPECULATIVE), "conditional": bool(texts & CONDITIONAL), "past": bool(texts & PAST),
            "reported": any(r["text"] == "と" and by_id.get(r["head"], r)["lemma"] in {"言う", "叫ぶ", "曰く"} for r in chain),
        })
    # a condition holds for the clause that it depends on
    flags = {s["predicate"]: s["conditional"] for s in out}
    for s in out:
        s["under_condition"] = any(flags[c["predicate"]] for c in out if c["parent"] == s["predicate"])
    return out


SCOPES = "case_id bigint, predicate int, parent int, tokens array<int>, start int, end int, negative boolean, speculative boolean, conditional boolean, past boolean, reported boolean, under_condition boolean"


def propositions(toks: DataFrame) -> DataFrame:
    """One row per predicate of each document. Documents without predicates give none."""
    names = [x.split()[0] for x in SCOPES.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"case_id": pdf["case_id"].iloc[0], **s} for s in _scopes(pdf)], columns=names)

    return toks.select("case_id", "id", "text", "lemma", "pos", "dep", "head", "start", "end").groupBy("case_id").applyInPandas(run, SCOPES)


# Argument roles by relation.
ROLES = {"nsubj": "agent", "obj": "theme", "iobj": "recipient", "obl": "oblique", "nmod": "modifier", "advmod": "manner"}


def facts(toks: DataFrame) -> DataFrame:
    """(case_id, predicate, lemma, polarity, tense, realization, role, argument): one row per argument, one with a null role
    for a predicate without arguments. Arguments are the tokens that depend on the predicate by a relation of ROLES.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        by_id = {r["id"]: r for r in pdf.to_dict("records")}
        out = []
        for s in _scopes(pdf):
            base = (pdf["case_id"].iloc[0], s["predicate"], by_id[s["predicate"]]["lemma"], "negative" if s["negative"] else "positive", "past" if s["past"] else "nonpast",
                    "conditional" if s["conditional"] or s["under_condition"] else "speculative" if s["speculative"] else "reported" if s["reported"] else "asserted")
            args = [(ROLES[r["dep"]], r["text"]) for r in by_id.values() if r["head"] == s["predicate"] and r["id"] != s["predicate"] and r["dep"] in ROLES]
            out += [(*base, *a) for a in args] or [(*base, None, None)]
        return pd.DataFrame(out, columns=["case_id", "predicate", "lemma", "polarity", "tense", "realization", "role", "argument"])

    schema = "case_id bigint, predicate int, lemma string, polarity string, tense string, realization string, role string, argument string"
    return toks.select("case_id", "id", "text", "lemma", "pos", "dep", "head", "start", "end").groupBy("case_id").applyInPandas(run, schema)


def compare_facts(a: DataFrame, b: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Positional full outer comparison of two fact tables within groups of equal key: (key..., status).

    Groups of unequal sizes are unknown; else the i-th rows are compared on the fields: pass if all agree, fail if not.
    """
    w = Window.partitionBy(*key).orderBy(*fields)
    x = a.withColumn("i", F.row_number().over(w)).select(*key, "i", F.struct(*fields).alias("x"))
    y = b.withColumn("i", F.row_number().over(w)).select(*key, "i", F.struct(*fields).alias("y"))
    j = x.join(y, [*key, "i"], "full")
    return j.groupBy(*key).agg(F.when(F.count("x") != F.count("y"), "unknown").when(F.bool_and(F.col("x") == F.col("y")), "pass").otherwise("fail").alias("status"))


def compare_analyses(a: DataFrame, b: DataFrame, key: str, checks: list[str]) -> DataFrame:
    """(key, code, status): for each key of both tables and each check, pass if the two values are equal, fail if not, unknown if one is null."""
    x, y = a.select(key, F.struct(*checks).alias("x")), b.select(key, F.struct(*checks).alias("y"))
    status = lambda k: F.when(F.col("x")[k].isNull() | F.col("y")[k].isNull(), "unknown").when(F.col("x")[k] == F.col("y")[k], "pass").otherwise("fail")
    rows = F.array(*[F.struct(F.lit(k).alias("code"), status(k).alias("status")) for k in checks])
    return x.join(y, key).select(key, F.explode(rows).alias("r")).select(key, "r.*")


def line_ledger(sections: DataFrame) -> DataFrame:
    """(line, category, post, gap): every line once, with the last known post and the distance to the line before that has text.

    The fill runs over the whole log in line order without gathering it: lines are cut into at most 10,000 blocks,
    the last known values of each block are carried over the blocks (one row each), and windows run inside blocks.
    """
    one = sections.groupBy("line").agg(F.min_by(F.struct("category", "post_id", "text"), F.struct(*[x for c in ("category", "post_id", "text") for x in (F.col(c).isNull(), F.col(c))])).alias("r")).select("line", "r.*")
    lo, hi = sections.agg(F.min("line"), F.max("line")).first()
    width = max(1000, -(-((hi or 0) - (lo or 0) + 1) // 10_000))
    x = one.withColumn("block", F.floor((F.col("line") - F.lit(lo or 0)) / width)).withColumn("solid", F.when(F.regexp_replace("text", r"[\s　]", "") != "", F.col("line")))
    per = x.groupBy("block").agg(F.max_by("post_id", F.when(F.col("post_id").isNotNull(), F.col("line"))).alias("lp"), F.max("solid").alias("ls"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select("block", F.last("lp", ignorenulls=True).over(before).alias("cp"), F.last("ls", ignorenulls=True).over(before).alias("cs"))
    w = Window.partitionBy("block").orderBy("line")
    y = x.join(carry, "block").withColumn("p", F.last("post_id", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    y = y.withColumn("s", F.last("solid", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return y.select("line", F.coalesce("category", F.lit("unknown")).alias("category"), F.coalesce("p", "cp").alias("post"), (F.col("line") - F.coalesce("s", "cs")).alias("gap"))
