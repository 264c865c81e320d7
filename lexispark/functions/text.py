"""Normalisation and string projections as column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Blanks beyond the ASCII ones, brackets, and terminal marks.
SPACE = r"[\s 　]+"
BRACKETS = "「」『』（）()［］【】\\[\\]"
TERMINAL = "。、．，！？!?.,…"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC; Spark has no built-in for it. Null stays null."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def search_form(c: Column) -> Column:
    """Lower case, without reply anchors, blanks collapsed and trimmed. JVM only, for text that is NFKC already."""
    bare = F.regexp_replace(F.lower(c), r">>\s*(?:\d+(?:-\d+)?|[\p{L}\p{N}_]+)", " ")
    return F.trim(F.regexp_replace(bare, SPACE, " "))


def normalize_for_search(c: Column) -> Column:
    return search_form(nfkc(c))


def presence_form(c: Column) -> Column:
    """search_form without blanks, brackets and terminal punctuation: the key of containment joins."""
    return F.regexp_replace(search_form(c), f"[\\s{BRACKETS}{TERMINAL}]", "")


def variant_key(c: Column) -> Column:
    """search_form without blanks, and without punctuation except between two digits."""
    tight = F.regexp_replace(search_form(c), r"\s", "")
    return F.regexp_replace(tight, r"(?<!\d)[\p{P}]|[\p{P}](?!\d)", "")


def scalar_slice(c: Column, start: Column, end: Column) -> Column:
    """Code points [start, end)."""
    return F.substring(c, start + 1, F.greatest(end - start, F.lit(0)))


def strip_anchor_lines(c: Column) -> Column:
    """Without lines that are only a reply anchor; three and more line breaks become two."""
    return F.regexp_replace(F.regexp_replace(c, r"(?m)^[ \t]*>>\d+[ \t]*(?:\n|$)", ""), r"\n{3,}", "\n\n")


def outside_quotes(c: Column) -> Column:
    """Quoted text blanked, length kept; for quotes that are not nested."""
    parts = F.split(c, r"(?<=[」』”])|(?=[「『“])")
    return F.concat_ws("", F.transform(parts, lambda p: F.when(p.rlike("^[「『“]"), F.regexp_replace(p, r"[^\n]", " ")).otherwise(p)))


def utterances(c: Column) -> Column:
    """Quoted utterances of two characters and more."""
    return F.regexp_extract_all(c, F.lit(r"[「『“]([^「」『』“”]{2,})[」』”]"), F.lit(1))


def quote_coverage(c: Column) -> Column:
    """Share of the characters that stand in quotes; null for null, 0 for empty."""
    inside = F.aggregate(F.regexp_extract_all(c, F.lit(r"[「『“]([^「」『』“”]+)[」』”]"), F.lit(1)), F.lit(0), lambda a, x: a + F.length(x))
    return F.when(c.isNotNull(), inside / F.greatest(F.length(c), F.lit(1)))


def script_mask(c: Column) -> Column:
    """Each character by its class: h hiragana, k katakana, q Han, D digit, A letter; others stay."""
    letters = r"[\p{L}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]]"  # first, so that no class letter is taken for text
    for pattern, to in ((letters, "A"), (r"\p{IsHiragana}", "h"), (r"\p{IsKatakana}|ー", "k"), (r"\p{IsHan}", "q"), (r"\p{Nd}", "D")):
        c = F.regexp_replace(c, pattern, to)
    return c


def structure_mask(c: Column) -> Column:
    """Digit runs as <NUM>, Han and katakana runs as <TERM>, repeats of a mask as one."""
    c = F.regexp_replace(c, r"[0-9]+(?:[.,][0-9]+)*", "<NUM>")
    c = F.regexp_replace(c, r"[\p{IsHan}\p{IsKatakana}ー]+", "<TERM>")
    return F.regexp_replace(F.regexp_replace(c, r"(<NUM>)+", "<NUM>"), r"(<TERM>)+", "<TERM>")


def vector_view(c: Column, phrases: list[str] | None = None, scripts: bool = False) -> Column:
    """URLs, mails and anchors, given phrases, and Han/katakana runs each as one box."""
    c = F.regexp_replace(c, r"https?://[^\s]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|>>\d+", "□")
    for p in sorted(phrases or [], key=len, reverse=True):
        c = F.regexp_replace(c, "\\Q" + p + "\\E", "□")
    return F.regexp_replace(c, r"[\p{IsHan}\p{IsKatakana}ー]+", "□") if scripts else c


def compact_example(c: Column, limit: int = 80) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, SPACE, " ")), 1, limit)


def expand_year(c: Column) -> Column:
    """Two-digit years with the pivot 70; other years stay. Null and text without digits give null."""
    y = F.try_to_number(c.cast("string"), F.lit("9999")).cast("int")
    return F.when(y < 70, y + 2000).when(y < 100, y + 1900).otherwise(y)


def hash_bucket(c: Column, buckets: int = 10) -> Column:
    """The first 8 hex digits of the SHA-256, modulo buckets."""
    return (F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def char_ngrams(c: Column, n: int) -> Column:
    """All n-grams of code points in order; a shorter text and null give none. One pass, linear in the length of the text."""
    grams = F.regexp_extract_all(c, F.lit("(?s)(?=(.{%d}))." % n), F.lit(1))
    return F.coalesce(grams, F.array().cast("array<string>"))


def gram_set(c: Column, n: int = 3) -> Column:
    """The set of n-grams; a shorter text is its own only gram, an empty text has none."""
    return F.when(F.length(c) >= n, F.array_distinct(char_ngrams(c, n))).when(F.length(c) > 0, F.array(c)).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """2|A∩B| / max(1, |A|+|B|) of two sets."""
    return 2 * F.size(F.array_intersect(a, b)) / F.greatest(F.size(a) + F.size(b), F.lit(1))


def words(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
