"""Surface features, classifiers and literal extraction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mark classes counted by the surface features.
MARKS = {
    "question": "[？?]", "exclamation": "[！!]", "ellipsis": "…|\\.\\.\\.", "comma": "[、，,]", "quote": "[「『“«„]", "digit": "[0-9]",
    "latin": "[A-Za-z]", "url": "https?://", "laugh": "[wｗ]{2,}|orz|（笑）", "bracket": "[（(]", "newline": "\\n",
}
# Named intents, each a pattern that Java and RE2 read alike. Parameter data: pass other tables for other corpora.
INTENTS = {
    "question": "[？?]", "link": "https?://", "number": "[0-9]", "quote": "[「“«„]", "mail": "[A-Za-z0-9.]+@[A-Za-z0-9.-]+",
    "laugh": "[wｗ]{2,}|（笑）", "version": "[Vv]er\\.|[Ee]dition", "price": "price|Preis|prix|価格|円", "place": "倉庫|廊下|屋上|archive|corridor|rooftop",
    "time": "時|分|p\\.m\\.|Uhr|点", "anchor": ">>[0-9]+",
}
# Speech acts in order of precedence.
ACTS = [("reply", "^>>[0-9]+"), ("ask", "[？?]"), ("quote", "[「“«„『]"), ("shout", "[！!]"), ("point", "https?://"), ("laugh", "[wｗ]{2,}|（笑）"), ("count", "[0-9]"), ("state", "[。．.]")]


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("bigint")


def mark_counts(c: Column) -> dict[str, Column]:
    return {f"n_{k}": count_of(c, p) for k, p in MARKS.items()}


def rates(c: Column) -> dict[str, Column]:
    """Marks per non-blank character, 6 digits; null for null, 0 for a text without characters."""
    solid = F.greatest(F.length(F.regexp_replace(c, r"[\s　]", "")), F.lit(1))
    return {f"r_{k}": F.round(count_of(c, p) / solid, 6) for k, p in MARKS.items()}


def multi_label(c: Column, table: dict[str, str], default: str = "general") -> Column:
    """Names of all patterns that occur, in the order of the table; the default if none does. Null gives the default."""
    hits = F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(k)) for k, p in table.items()]))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(default)))


def first_label(c: Column, table: list[tuple[str, str]], default: str = "other") -> Column:
    """Name of the first pattern that occurs."""
    return F.coalesce(*[F.when(c.rlike(p), F.lit(k)) for k, p in table], F.lit(default))


# Literal kinds in order of precedence.
LITERALS = [
    ("url", r"https?://[A-Za-z0-9./?=&_%-]+"), ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"), ("anchor", r">>[0-9]+"),
    ("identifier", r"[A-Z][A-Za-z]*[.-][0-9]+(?:\.[0-9]+)*"), ("number", r"[0-9]+(?:\.[0-9]+)?"),
]


def _tagged(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("raw")))


def literals(c: Column) -> Column:
    """array<struct<kind, raw>>: literals of each kind; a kind does not look inside the literals of the kinds before it."""
    parts, rest = [], c
    for kind, p in LITERALS:
        found = F.coalesce(F.regexp_extract_all(rest, F.lit(p), F.lit(0)), F.array().cast("array<string>"))
        parts.append(_tagged(found, kind))
        rest = F.regexp_replace(rest, p, " ")
    return F.flatten(F.array(*parts))


QUANTITY = r"(約|approx\.|about|±)?\s?([-+−]?)([0-9]+(?:\.[0-9]+)?)\s?(km|メートル|度|円|枚|回|分|日|人|番|本|歩|hours|days|pages|percent|％|%)(以上|以下|未満)?"


def quantities(c: Column) -> Column:
    """array<string> of whole quantities; take them apart with quantity_parts."""
    return F.regexp_extract_all(c, F.lit(QUANTITY), F.lit(0))


def quantity_parts(q: Column) -> Column:
    """struct: sign, decimal (text, never a float), unit, comparator (eq, ge, le, lt, approx)."""
    g = lambda i: F.regexp_extract(q, QUANTITY, i)
    comparator = F.when(g(5) == "以上", "ge").when(g(5) == "以下", "le").when(g(5) == "未満", "lt").when(g(1) != "", "approx").otherwise("eq")
    return F.struct(F.when(g(2).isin("-", "−"), "-").otherwise("+").alias("sign"), g(3).alias("decimal"), g(4).alias("unit"), comparator.alias("comparator"))


def request_errors(doc: Column, max_chars: int = 5000) -> Column:
    """Error codes of a request text: missing, blank, too_long, control_character; an empty array for a valid one."""
    return F.array_compact(F.array(
        F.when(doc.isNull(), F.lit("missing")),
        F.when(doc.isNotNull() & (F.trim(F.regexp_replace(doc, r"[\s　]", "")) == ""), F.lit("blank")),
        F.when(F.length(doc) > max_chars, F.lit("too_long")),
        F.when(doc.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"), F.lit("control_character")),
    ))


def bigram_bucket(a: Column, b: Column, buckets: int = 32) -> Column:
    """(31 * first code point + second) modulo buckets."""
    return F.pmod(F.ascii(a) * 31 + F.ascii(b), F.lit(buckets)).cast("int")


def anchor_placement(c: Column) -> Column:
    """Where a text's reply anchors stand: standalone, prefix, suffix, inline or none; null for null."""
    return (
        F.when(c.isNull(), F.lit(None).cast("string")).when(c.rlike(r"^\s*>>[0-9]+\s*$"), "standalone").when(c.rlike(r"^\s*>>[0-9]+"), "prefix")
        .when(c.rlike(r">>[0-9]+\s*$"), "suffix").when(c.rlike(r">>[0-9]+"), "inline").otherwise("none")
    )


# What an anchored reply does, in order of precedence.
ANCHOR_USE = [("gratitude", "ありがと|thanks|merci|danke"), ("question", "[？?]"), ("evidence", "https?://"), ("evaluation", "正直|honest|wichtig"), ("agreement", "その件|agree|同意"), ("vocative", "さん|君|Mr")]


def anchor_use(c: Column) -> Column:
    """What the text does to the post that it answers; unknown if no pattern tells, null without an anchor."""
    return F.when(c.rlike(">>[0-9]+"), first_label(F.regexp_replace(c, ">>[0-9]+", " "), ANCHOR_USE, "unknown"))


OPENING, CLOSING = "[「『（(【《〈\\[{«“]", "[」』）)】》〉\\]}»”]"


def inside_brackets(c: Column, offset: Column) -> Column:
    """Whether more brackets open than close before a code-point offset."""
    head = F.substring(c, F.lit(1), offset)
    return F.regexp_count(head, F.lit(OPENING)) > F.regexp_count(head, F.lit(CLOSING))


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """1 minus the edit distance over the longer length; 1 for two empty texts, null for null."""
    return F.when(a.isNotNull() & b.isNotNull(), 1 - F.coalesce(F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))), F.lit(0.0)))


# Words and the concept each stands for.
CONCEPTS = [("倉庫", "storage"), ("storage", "storage"), ("archive", "storage"), ("仓库", "storage"), ("廊下", "corridor"), ("corridor", "corridor"), ("flur", "corridor"), ("走廊", "corridor"), ("鍵", "key"), ("key", "key"), ("schlüssel", "key"), ("钥匙", "key")]


def concepts(c: Column, table: list[tuple[str, str]] = CONCEPTS) -> Column:
    """The distinct concepts whose words a text holds, sorted; the table is small and folded into the expression."""
    low = F.lower(c)
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(k)) for w, k in table]))))


def expand_query(c: Column, table: list[tuple[str, str]] = CONCEPTS) -> Column:
    """All words of the concepts that a text holds, sorted."""
    found = concepts(c, table)
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.array_contains(found, k), F.lit(w)) for w, k in table]))))
