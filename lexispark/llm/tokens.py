"""Encoding of a corpus with a public byte-level BPE tokenizer through a distinct-word table.

Byte-level BPE never merges across the words that its pattern cuts, so a text's ids are the ids of its words one after
another. Words are cut by Spark, each distinct word is encoded once, and ids come back by a join on the word.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.operators.skew import hot_rows
from lexispark.session import materialize

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pre-tokenisation pattern of the byte-level BPE vocabulary, in Java's dialect ((?U): Unicode blanks).
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A word is hot if it makes up 1/HOT of all words or more.
HOT = 2000


def words(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key..., pos, word): the words of each text in order. Null and empty texts give none."""
    return docs.select(*key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))).alias("pos", "word"))


def _encode(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        for b in batches:
            ids = [e.ids for e in t.encode_batch(b["word"].tolist(), add_special_tokens=False)]
            yield pd.DataFrame({"word": b["word"], "n": b["n"], "ids": ids})

    return run


def dictionary(occurrences: DataFrame, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """(word, n, ids): every distinct word, how often it occurs, and its ids; written once."""
    counts = occurrences.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return materialize(counts.mapInPandas(_encode(tokenizer), "word string, n bigint, ids array<int>"), "words")


def _joined(occurrences: DataFrame, lookup: DataFrame, keep: list) -> DataFrame:
    """occurrences ⋈ lookup on word; hot words, at most HOT by construction, come by broadcast and are not shuffled."""
    hot = hot_rows(lookup, "n", HOT)
    if hot is None:
        return occurrences.join(lookup, "word").select(*keep)
    names = F.broadcast(hot.select("word"))
    cold = occurrences.join(names, "word", "left_anti").join(lookup.join(names, "word", "left_anti"), "word")
    return occurrences.join(F.broadcast(hot), "word").select(*keep).unionByName(cold.select(*keep))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """(key, ids array<int>) of each distinct (key, text), without special tokens; null and empty texts have no ids.

    Rows that repeat a key and text count once; rows of one key with different texts stay apart, and so do rows of a
    null key. Whole texts are encoded, of any length.
    """
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull()).alias("fp"), F.col(text).alias("t"))
    occ = words(rows, ["k", "fp"], "t")
    lookup = dictionary(occ, tokenizer)
    parts = _joined(occ, lookup, ["k", "fp", "pos", "ids"])
    # a set: a row that came twice gives each position twice
    full = parts.groupBy("k", "fp").agg(F.array_sort(F.collect_set(F.struct("pos", "ids"))).alias("w"))
    full = full.select(F.col("k").alias(key), F.flatten(F.col("w.ids")).alias("ids"))
    empty = rows.filter("t is null or t = ''").select("k", "fp").distinct().select(F.col("k").alias(key), F.array().cast("array<int>").alias("ids"))
    return full.unionByName(empty)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """(key, tokens bigint) for each key that occurs once; 0 for null and empty texts. Sums before it shuffles by key."""
    occ = docs.select(F.col(key).alias("k"), F.explode(F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))).alias("word"))
    lookup = dictionary(occ, tokenizer).select("word", "n", F.size("ids").alias("len"))
    sums = _joined(occ, lookup, ["k", "len"]).groupBy("k").agg(F.sum("len").alias("tokens"))
    return docs.select(F.col(key).alias("k")).distinct().join(sums, "k", "left").select(F.col("k").alias(key), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))


def pieces(spark, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """(id, piece binary) of the vocabulary, a fixed table of about 50,000 rows."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on, in order
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    rows = [(i, bytes(back[c] for c in p) if all(c in back for c in p) else p.encode()) for p, i in t.get_vocab().items()]
    return spark.createDataFrame(rows, "id int, piece binary")


def decode(encoded: DataFrame, key: str = "doc_id", tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """(key, text) of each distinct (key, ids) by a join with the pieces. No ids, or null, give the empty text; unknown ids
    raise nothing and give nothing. Rows of one key with different ids, and rows of a null key, stay apart.
    """
    vocab = F.broadcast(pieces(encoded.sparkSession, tokenizer))  # its size is fixed by the vocabulary
    rows = encoded.select(F.col(key), F.xxhash64(F.coalesce("ids", F.array().cast("array<int>"))).alias("__fp"), "ids")
    flat = rows.select(key, "__fp", F.posexplode_outer("ids").alias("pos", "id")).join(vocab, "id", "left")
    # a set: a row that came twice gives each position twice
    hexes = flat.groupBy(key, "__fp").agg(F.array_sort(F.collect_set(F.struct("pos", F.hex("piece").alias("h")))).alias("p"))
    joined = F.concat_ws("", F.transform("p", lambda x: F.coalesce(x["h"], F.lit(""))))
    return hexes.select(key, F.decode(F.unhex(joined), "UTF-8").alias("text"))
