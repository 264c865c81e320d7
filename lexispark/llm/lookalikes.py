"""One consistent form for text that looks the same: script-aware repair against the corpus vocabulary.

Two steps. The base form undoes what is invisible whatever the script: invisible characters, kinds and widths of blanks,
full and half width, composition, presentation forms. The repair then handles look-alike letters: the dominant script of
each token (and of its text) is determined, and a mixed-script token is replaced by the spelling of the same shape that the
corpus vocabulary holds and that mixes scripts least. Tokens of one script stay as they are in the repaired form.

Texts are compared by a key, for which tokens of one script are respelt in the same way where another spelling of their
shape is more usual (the katakana and the Han character of one shape, a word wholly in letters of another alphabet), since
nobody can see the difference. Case, small kana, voicing marks, and raised or circled figures are visible and stay.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.text import normalize_for_search
from lexispark.session import materialize

# Letters that share a shape across scripts; the first of each line stands for the shape.
SHAPES = """
a а α ɑ
c с ϲ
d ԁ
e е
g ɡ
h һ
i і ι
j ј ϳ
k κ к
n ո
o о ο օ
p р ρ
q ԛ
s ѕ
u υ ս
v ν ѵ
w ѡ ԝ
x х
y у γ ү
A А Α
B В Β
C С Ϲ
E Е Ε
F Ϝ
G Ԍ
H Н Η
I І Ι Ӏ
J Ј Ϳ
K К Κ
M М Μ Ϻ
N Ν
O О Ο
P Р Ρ
Q Ԛ
S Ѕ
T Т Τ
V Ѵ
W Ԝ
X Х Χ
Y Υ Ү
Z Ζ
エ 工
カ 力
タ 夕
ト 卜
ニ 二
ハ 八
ロ 口
ー 一
へ ヘ
べ ベ
ぺ ペ
り リ
- ‐ ‑ ‒ − ⁃ ﹣
・ ‧ · ⋅ ∙ •
~ 〜 ∼ ˜
' ’ ʼ ′ ＇
— ― ─
"""
SHAPE = {c: line.split()[0] for line in SHAPES.split("\n") if line for c in line.split()}
LETTERS = frozenset(c for c in SHAPE if unicodedata.category(c)[0] == "L")
SIGNS = {c: s for c, s in SHAPE.items() if c not in LETTERS}
# Further characters without a glyph, beside the format characters and variation selectors.
UNSEEN = frozenset("͏ᅟᅠ឴឵ㅤﾠ")
KEPT_COMPAT = frozenset("ſϐϑϒϕϖϰϱϵ")  # their compatibility forms look different
TOKEN = regex.compile(r"[\p{L}\p{M}]+")


class _Base(dict):
    """Code point → its base form, worked out when first met."""

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        cat, parts = unicodedata.category(c), unicodedata.decomposition(c).split()
        kind = parts[0] if parts and parts[0][0] == "<" else ""
        to = "".join(chr(int(x, 16)) for x in parts[1:]) if kind else c
        if c in "\n\x0b\x0c\x85  ":
            out = "\n"
        elif c == "\t" or cat == "Zs" or c == "⠀":
            out = " "
        elif cat in ("Cf", "Cc") or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or 0x180B <= cp <= 0x180F or c in UNSEEN:
            out = ""
        elif kind in ("<wide>", "<narrow>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>"):
            out = to.translate(self) if to != c else to
        elif kind == "<compat>" and c not in KEPT_COMPAT and (len(to) == 1 or 0xFB00 <= cp <= 0xFB17 or 0x2160 <= cp <= 0x217F):
            out = to
        else:
            out = c
        self[cp] = out = "".join(SIGNS.get(x, x) for x in out)
        return out


_BASE = _Base()
_RUNS, _EDGES = regex.compile(" {2,}"), regex.compile(" *\n *")


def base(text: str) -> str:
    """The form without look-alike letters repaired. Runs of blanks become one; blanks at line ends go."""
    t = text.replace("\r\n", "\n").replace("\r", "\n").translate(_BASE)
    if not t.isascii():
        t = unicodedata.normalize("NFC", t)
    return _EDGES.sub("\n", _RUNS.sub(" ", t)).strip(" \n")


_SHAPED = str.maketrans({c: SHAPE[c] for c in LETTERS})


@lru_cache(maxsize=65536)
def script(c: str) -> str:
    name = unicodedata.name(c, "?")
    if name.startswith("CJK"):
        return "Han"
    return name.split(" ", 1)[0] if name.split(" ", 1)[0] in ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "HIRAGANA", "KATAKANA") else "-"


ALPHABETS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN")


def mixing(token: str) -> int:
    """How often the script changes within a token."""
    s = [x for x in map(script, token) if x != "-"]
    return sum(a != b for a, b in zip(s, s[1:]))


def suspects(text: str) -> tuple[list[str], list[str], str]:
    """The distinct tokens that hold a look-alike letter; those of them whose scripts are mixed or out of place in text;
    the dominant alphabet of the text.

    The dominant alphabet is taken from letters that have no look-alike, else from all.
    """
    with_any = [t for t in set(TOKEN.findall(text)) if not LETTERS.isdisjoint(t)]
    if not with_any or text.isascii():
        return with_any, [], ""
    sure = dict.fromkeys(ALPHABETS, 0)
    rest = dict(sure)
    odd = []
    for c in text:
        s = script(c) if c.isalpha() else "-"
        if s in sure:
            (rest if c in LETTERS else sure)[s] += 1
    count = sure if any(sure.values()) else rest
    main = max(ALPHABETS, key=lambda s: count[s]) if any(count.values()) else ""
    for t in with_any:
        own = {script(c) for c in t} - {"-"}
        if len(own) > 1 or (own & set(ALPHABETS) and own != {main}) or own & {"Han", "KATAKANA", "HIRAGANA"}:
            odd.append(t)
    return with_any, odd, main


def home(token: str) -> str:
    """The alphabet of a token of a single one, CJK for tokens with kana or Han, else nothing."""
    own = {script(c) for c in token} - {"-"}
    if own & {"Han", "KATAKANA", "HIRAGANA"}:
        return "CJK"
    return next(iter(own)) if len(own) == 1 else ""


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        forms = [base(t) for t in b["content"]]
        found = [suspects(f) for f in forms]
        odd = [
            [{"old": t, "want": "CJK" if home(t) == "CJK" else m, "mixed": home(t) == "", "shape": t.translate(_SHAPED), "changes": mixing(t)} for t in x]
            for _, x, m in found
        ]
        yield pd.DataFrame({"ch": b["ch"], "base": forms, "tokens": [x for x, _, _ in found], "odd": odd})


def _shape(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        t = b["token"]
        yield pd.DataFrame({"token": t, "n": b["n"], "shape": [x.translate(_SHAPED) for x in t], "mixing": [mixing(x) for x in t], "home": [home(x) for x in t]})


def _rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        forms, keys = [], []
        for text, fixes in zip(b["base"], b["fixes"]):
            every = {f["old"]: f["new"] for f in fixes}
            sure = {f["old"]: f["new"] for f in fixes if f["sure"]}
            keys.append(TOKEN.sub(lambda m: every.get(m[0], m[0]), text))
            forms.append(TOKEN.sub(lambda m: sure.get(m[0], m[0]), text) if sure else text)
        yield pd.DataFrame({"ch": b["ch"], "form": forms, "key": keys})


def unify(texts: DataFrame) -> DataFrame:
    """(ch, form, key) for the distinct rows (ch, content), where ch names a content and content is not null.

    In ``form`` only tokens that mix scripts are repaired, where the vocabulary holds a spelling of the same shape that mixes
    them less; texts that look the same have the same ``key``. Vocabulary, shapes and spellings are counted over all rows. A
    token without a better spelling in the vocabulary stays as it is; equal choices go to the more frequent, then the lesser
    spelling. An empty text has an empty form.
    """
    schema = "ch string, base string, tokens array<string>, odd array<struct<old: string, want: string, mixed: boolean, shape: string, changes: int>>"
    scanned = materialize(texts.select("ch", "content").mapInPandas(_scan, schema), "scanned")
    counts = scanned.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    vocab = counts.mapInPandas(_shape, "token string, n bigint, shape string, mixing int, home string").filter("home <> ''")
    # the best spelling of a shape in an alphabet by an aggregate, so that no shape is gathered in one place
    spelling = F.min(F.struct(F.col("mixing").alias("m"), (-F.col("n")).alias("n"), F.col("token").alias("t")))
    best = vocab.groupBy("shape", F.col("home").alias("want")).agg(spelling.alias("near"))
    anywhere = vocab.filter("home <> 'CJK'").groupBy("shape").agg(spelling.alias("far"))
    # a mixed token that the dominant alphabet can't spell takes the best spelling of another
    odd = scanned.select("ch", F.explode("odd").alias("o")).select("ch", "o.*").join(best, ["shape", "want"], "left").join(anywhere, "shape", "left")
    odd = odd.withColumn("new", F.coalesce("near", F.when(F.col("mixed"), F.col("far")))).filter("old <> new.t")
    fix = F.struct("old", F.col("new.t").alias("new"), (F.col("new.m") < F.col("changes")).alias("sure"))
    fixes = odd.groupBy("ch").agg(F.collect_list(fix).alias("fixes"))
    mended = scanned.select("ch", "base").join(fixes, "ch").mapInPandas(_rewrite, "ch string, form string, key string")
    plain = scanned.select("ch", F.col("base").alias("form"), F.col("base").alias("key")).join(fixes.select("ch"), "ch", "left_anti")
    return materialize(plain.unionByName(mended), "forms")


def _contents(posts: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return posts.filter(F.trim(F.regexp_replace(c, r"(?U)\s", "")) != "").select("id", c.alias("content"), F.sha2(c, 256).alias("ch"))


def normal_forms(posts: DataFrame) -> DataFrame:
    """(id, form, key, stale) of each distinct post with a non-blank content: the repaired text, what it is compared by, and
    whether its ``normalized`` is missing, or brought to one form in the same way is not what search normalisation makes of
    its content.
    """
    a = _contents(posts, "content")
    b = _contents(posts, "normalized")
    both = a.select("ch", "content").unionByName(b.select("ch", "content")).dropDuplicates(["ch"])
    forms = unify(both)
    own = a.select("id", "ch").distinct().join(forms, "ch").select("id", "form", "key", normalize_for_search(F.col("key")).alias("own"))
    given = b.select("id", "ch").distinct().join(forms, "ch").select("id", normalize_for_search(F.col("key")).alias("said"))
    return own.join(given, "id", "left").groupBy("id", "form", "key").agg(F.coalesce(F.bool_and(~F.col("own").eqNullSafe(F.col("said"))), F.lit(True)).alias("stale"))


def classes(posts: DataFrame) -> DataFrame:
    """(id, class_id, spellings): each distinct post with a non-blank content, the least id of the posts that look like it,
    and how many different contents these have. Linear in the posts, however many look alike.
    """
    rows = materialize(_contents(posts, "content").select("id", "ch", "content").distinct(), "contents")
    keyed = unify(rows.select("ch", "content").dropDuplicates(["ch"])).select("ch", F.sha2("key", 256).alias("k"))
    ids = rows.select("id", "ch").distinct().join(keyed, "ch")
    heads = ids.groupBy("k").agg(F.min("id").alias("class_id")).join(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("spellings")), "k")
    return ids.join(heads, "k").select("id", "class_id", "spellings").distinct()


def same_looking(posts: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: posts of one key whose stored contents differ; ``classes`` says the same without pairs.

    Pairs are formed between distinct contents of a key and then between their posts, so that nothing larger than the
    result arises, however often one content is copied. Null and blank contents have no partners.
    """
    rows = materialize(_contents(posts, "content").select("id", "ch", "content").distinct(), "contents")
    forms = unify(rows.select("ch", "content").dropDuplicates(["ch"])).select("ch", F.sha2("key", 256).alias("f"))
    several = forms.groupBy("f").agg(F.min("ch").alias("lo"), F.max("ch").alias("hi")).filter("lo < hi").select("f")
    close = materialize(forms.join(several, "f"), "close")
    pairs = close.select("f", F.col("ch").alias("c1")).join(close.select("f", F.col("ch").alias("c2")), "f").filter("c1 <> c2")
    ids = rows.select("id", "ch").distinct()
    return (
        pairs.join(ids.select(F.col("id").alias("id_a"), F.col("ch").alias("c1")), "c1")
        .join(ids.select(F.col("id").alias("id_b"), F.col("ch").alias("c2")), "c2")
        .filter("id_a < id_b").select("id_a", "id_b").distinct()
    )
