"""Linking records: containment joins, near-duplicates, canonical versions, leakage-safe exclusion."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexispark.functions import text as T
from lexispark.operators.graph import connected_components, union_all
from lexispark.operators.skew import lookup_join
from lexispark.session import discard, materialize, releasing

#: Words of a shingle text: characters of scripts without blanks, else runs of letters and digits.
WORD = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー\p{IsThai}]|[\p{L}\p{M}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー\p{IsThai}]]+"


def containment(needles: DataFrame, hay: DataFrame, needle_id: str, hay_id: str, gram: int = 6) -> DataFrame:
    """(needle_id, hay_id) where hay.text contains needle.text; both tables are (id, text) with normalised texts.

    Exact for needles of at least ``gram`` characters; shorter ones match nothing. Instead of comparing all pairs, a
    needle meets the texts that hold its rarest gram; grams are counted over the texts first. Postings of other grams are
    never shuffled.
    """
    n = needles.filter(F.length("text") >= gram).select(F.col(needle_id), F.col("text").alias("needle"))
    grams = n.select(needle_id, "needle", F.explode(F.array_distinct(T.char_ngrams(F.col("needle"), gram))).alias("gram"))
    postings = hay.select(hay_id, F.explode(F.array_distinct(T.char_ngrams(F.col("text"), gram))).alias("gram"))
    df = materialize(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).join(grams.select("gram").distinct(), "gram"), "grams")
    # a gram that no text holds proves that the needle is in none
    rarest = grams.join(df, "gram", "left").groupBy(needle_id, "needle").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("r")).filter("r.df > 0")
    rarest = materialize(rarest.select(needle_id, "needle", F.col("r.gram").alias("gram"), F.col("r.df").alias("df")), "needles")
    # only texts that hold some needle's rarest gram are kept, and grams held by many texts are not gathered in one task
    held = lookup_join(postings, rarest.select("gram", "df").distinct(), "gram", "df")
    pairs = rarest.drop("df").join(held, "gram")
    return pairs.join(hay.select(hay_id, "text"), hay_id).filter(F.contains("text", "needle")).select(needle_id, hay_id).distinct()


def unique_best(links: DataFrame, key: str, score: str = "score") -> DataFrame:
    """Links of the highest score per key, only where that link is the only one of its score."""
    best = links.groupBy(key).agg(F.max(score).alias("__m"))
    top = links.join(best, (links[key] == best[key]) & (links[score] == best["__m"])).drop(best[key]).drop("__m")
    single = top.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter("__n = 1").select(key)
    return top.join(single, key, "left_semi")


def shingles(docs: DataFrame, key: str, column: str, words: int = 5) -> DataFrame:
    """(key, sh array<string>): the distinct shingles of ``words`` words; a shorter text is its own shingle, an empty one has none."""
    w = F.regexp_extract_all(F.lower(F.col(column)), F.lit(WORD), F.lit(0))
    n = F.size("w")
    grams = F.when(n >= words, F.array_distinct(F.transform(F.sequence(F.lit(1), n - words + 1), lambda i: F.array_join(F.slice("w", i, words), " "))))
    # exploded from an array of one: the optimizer must not put the cutting of a text into each use of its words
    return docs.select(key, F.explode(F.array(w)).alias("w")).select(key, grams.when(n > 0, F.array(F.array_join("w", " "))).otherwise(F.array().cast("array<string>")).alias("sh"))


#: Counters of shingles by hash; two that share one only come later in the order.
BUCKETS = 1 << 21
#: Bytes of a sketch: how many shingles of a set fall on each of so many places.
SKETCH = 64
#: Prefixes meet in so many rounds, each of a part of the hashes, so that only that part is shuffled at a time.
ROUNDS = 8
#: Places of the hashes of prefixes, by which those that only one prefix holds are told before they are shuffled.
PLACES = 1 << 27
#: Up to so many classes the texts of candidates are found by broadcasting their keys.
FEW = 200_000


def _scanned(docs: DataFrame, key: str, column: str, words: int) -> DataFrame:
    """(key, fp, tag, slice, n): every document's set, and in 32 rows of each task how many hashes fall on each of BUCKETS counters."""
    step = BUCKETS // 32

    def run(batches):
        n = np.zeros(BUCKETS, np.int32)
        for b in batches:
            np.add.at(n, b.column("hs").flatten().to_numpy(zero_copy_only=False) & (BUCKETS - 1), 1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (key, "fp", "tag")), pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())], [key, "fp", "tag", "slice", "n"])
        # by planes of bytes, as most of the higher ones are 0
        planes = [zlib.compress(n[i * step : (i + 1) * step].view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for i in range(32)]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(32, t) for t in types), pa.array(range(32), pa.int32()), pa.array(planes, pa.binary())], [key, "fp", "tag", "slice", "n"])

    sets = _sets(docs, key, column, words)
    kind = dict(sets.dtypes)[key]
    types = [to_arrow_type(sets.schema[key].dataType), pa.binary(), pa.int64()]
    parts = sets.coalesce(4 * docs.sparkSession.sparkContext.defaultParallelism)
    return parts.mapInArrow(run, f"`{key}` {kind}, fp binary, tag bigint, slice int, n binary")


def _sets(docs: DataFrame, key: str, column: str, words: int, fp: bool = True) -> DataFrame:
    """(key, fp, tag, hs) of the shingles of each document: the hash of the set, one of the text and those of the shingles."""
    hs = F.transform("sh", lambda x: F.xxhash64(x))
    found = shingles(docs, key, column, words).select(key, *[_fingerprint(key).alias("fp")] * fp, F.explode(F.array(hs)).alias("hs"))
    return found.select(key, *["fp"] * fp, F.xxhash64("hs").alias("tag"), "hs")


def _fingerprint(key: str):
    """1 and the first half of the SHA-256 of a set; 0 and the key where there is none."""
    return F.when(F.size("sh") > 0, F.concat(F.lit(b"\1"), F.unhex(F.substring(F.sha2(F.array_join(F.array_sort("sh"), "\n"), 256), 1, 32)))).otherwise(F.concat(F.lit(b"\0"), F.col(key).cast("string").cast("binary")))


def _bucket_counts(scanned: DataFrame) -> np.ndarray:
    """The counters of all tasks of _scanned, summed."""

    def total(p: pd.DataFrame) -> pd.DataFrame:
        n = sum(np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1).T.copy().view(np.int32)[:, 0].astype(np.int64) for x in p["n"])
        return pd.DataFrame({"slice": p["slice"].iloc[:1], "n": [np.minimum(n, 2**31 - 1).astype(np.int32).tobytes()]})

    rows = scanned.filter("slice is not null").select("slice", "n").groupBy("slice").applyInPandas(total, "slice int, n binary").collect()
    return np.concatenate([np.frombuffer(r["n"], np.int32) for r in sorted(rows)]) if rows else np.zeros(BUCKETS, np.int32)


#: Bytes of a hash in a prefix; equal ones of different shingles only add candidates.
WIDTH = 5


def _prefixes(shared, key: str, similarity: float, rows: int = 2000):
    """(key, tag, n, head, sketch): of each row the first n - ceil(similarity n) + 1 hashes, from rare to frequent, WIDTH bytes
    each, all 0 for those that are there once. Rows that have no others are left out.
    """

    def run(batches):
        counts = shared.value
        for big in batches:
            for b in (big.slice(i, rows) for i in range(0, big.num_rows, rows)):
                size = b.column("hs").value_lengths().to_numpy(zero_copy_only=False)
                g = b.column("hs").flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(size)), size)
                often = counts[g & (BUCKETS - 1)]
                order = np.lexsort((g, often, row))
                g, often = g[order], often[order]
                at = np.arange(len(g)) - np.repeat(np.cumsum(size) - size, size) + 1
                n = size[row]
                first = at <= n - np.ceil(similarity * n - 1e-9) + 1
                met = first & (often > 1)
                some = np.unique(row[met])
                first &= np.isin(row, some)
                short = np.where(often > 1, np.maximum(g & (1 << 8 * WIDTH) - 1, 1), 0)[first].astype("<i8")
                raw = np.ascontiguousarray(short.view(np.uint8).reshape(-1, 8)[:, :WIDTH])
                ends = np.cumsum(np.bincount(row[first], minlength=len(size))[some]) * WIDTH
                head = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(raw)])
                sketch = np.minimum(np.bincount(row * SKETCH + (g >> 32 & SKETCH - 1), minlength=len(size) * SKETCH), 255).astype(np.uint8).reshape(-1, SKETCH)
                take = lambda c: b.column(c).take(pa.array(some))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([take(key), take("tag"), pa.array(size[some], pa.int32()), head, pa.array([x.tobytes() for x in sketch[some]], pa.binary())], [key, "tag", "n", "head", "sketch"])

    return run


def _hashes(head: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many hashes each head has, and all of them."""
    size = pc.binary_length(head).to_numpy(zero_copy_only=False).astype(np.int64) // WIDTH
    raw = np.frombuffer(b"".join(head.to_pylist()), np.uint8).reshape(-1, WIDTH)
    g = np.zeros((len(raw), 8), np.uint8)
    g[:, :WIDTH] = raw
    return size, g.view("<i8")[:, 0]


def _bits(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit of each hash in a map of PLACES bits, of which each round has a part."""
    own = PLACES // ROUNDS
    at = g % ROUNDS * own + (g.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % own
    return at >> 3, np.left_shift(1, at & 7).astype(np.uint8)


def _repeated(heads: DataFrame) -> list[list[bytes]]:
    """Per round a map, in compressed slices, of the places of hashes that are there more than once in the heads; others may
    share a place with them.
    """
    each = 4
    step = PLACES // 8 // ROUNDS // each

    def run(batches):
        once, more = np.zeros(PLACES // 8, np.uint8), np.zeros(PLACES // 8, np.uint8)
        for b in batches:
            g, n = np.unique(_hashes(b.column("head"))[1], return_counts=True)
            at, bit = _bits(g)
            again = (n > 1) | (once[at] & bit > 0)
            np.bitwise_or.at(more, at[again], bit[again])
            np.bitwise_or.at(once, at, bit)
        for i in range(ROUNDS * each):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([zlib.compress(x[i * step : (i + 1) * step].tobytes(), 1)], pa.binary()) for x in (once, more))], ["slice", "once", "more"])

    def total(p: pd.DataFrame) -> pd.DataFrame:
        once, more = np.zeros(step, np.uint8), np.zeros(step, np.uint8)
        for x, y in zip(p["once"], p["more"]):
            x = np.frombuffer(zlib.decompress(x), np.uint8)
            more |= np.frombuffer(zlib.decompress(y), np.uint8) | once & x
            once |= x
        return pd.DataFrame({"slice": p["slice"].iloc[:1], "more": [zlib.compress(more.tobytes(), 1)]})

    parts = heads.select("head").coalesce(4 * heads.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "slice int, once binary, more binary")
    rows = parts.groupBy("slice").applyInPandas(total, "slice int, more binary").collect()
    by = {r["slice"]: bytes(r["more"]) for r in rows}
    return [[by.get(k * each + i, zlib.compress(bytes(step))) for i in range(each)] for k in range(ROUNDS)]


def _postings(part: int, repeated: list[bytes]):
    """(class_key, n, at, g) of the hashes of one round, from the heads, without those that no other head holds (see _repeated); at
    counts from 1.
    """
    before = part * PLACES // 8 // ROUNDS

    def run(batches):
        more = np.frombuffer(b"".join(map(zlib.decompress, repeated)), np.uint8)
        for b in batches:
            size, g = _hashes(b.column("head"))
            row = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(g)) - np.repeat(np.cumsum(size) - size, size) + 1
            kept = np.flatnonzero((g > 0) & (g % ROUNDS == part))
            place, bit = _bits(g[kept])
            kept = kept[more[place - before] & bit > 0]
            own = pa.array(row[kept])
            yield pa.RecordBatch.from_arrays([b.column("class_key").take(own), b.column("n").take(own), pa.array(at[kept], pa.int32()), pa.array(g[kept], pa.int64())], ["class_key", "n", "at", "g"])

    return run


def _possible(similarity: float):
    """Pairs (a, b) whose sketches leave room for the similarity: sets share no more than the sum of the lesser counts."""

    def run(batches):
        for x in batches:
            a, b = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("sa", "sb"))
            n = (x.column("na").to_numpy() + x.column("nb").to_numpy()).astype(np.float64)
            # a count of 255 stands for any larger one
            more = (a == 255).any(axis=1) | (b == 255).any(axis=1)
            kept = more | (np.minimum(a, b).sum(axis=1) >= similarity / (1 + similarity) * n - 1e-6)
            yield x.select(["a", "b"]).filter(pa.array(kept))

    return run


@releasing
def similar_classes(docs: DataFrame, key: str, column: str, similarity: float = 0.8, words: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, fp) of every document, (fp, class_key) of the classes of equal shingle sets, named by their least key, and the pairs
    (a, b, jaccard) of classes whose sets are similar, exactly and without comparing all pairs.

    Classes of equal sets are formed first, so that copies make no pairs. Two sets of similarity t share a shingle among
    the first n - ceil(t n) + 1 of each when shingles are ordered from rare to frequent over the whole corpus; only those
    are joined, and sets of too different sizes or with too little left behind the shared one are skipped. Any order does: shingles go
    by hash, and by counters of a fixed number, so that only the first ones are ever shuffled. Hot shingles come last. Equal hashes of
    different shingles only add candidates, as similarities are taken from the texts, of those pairs that a sketch does not rule out.
    """
    spark = docs.sparkSession
    docs = docs.select(key, column)
    ids = materialize(_scanned(docs, key, column, words), "ids")
    shared = spark.sparkContext.broadcast(_bucket_counts(ids))
    ids = ids.filter("slice is null").select(key, "fp", "tag")
    least = materialize(ids.groupBy("fp").agg(F.min(F.struct(F.col(key).alias("class_key"), "tag")).alias("m")).select("fp", "m.class_key", "m.tag"), "classes")
    # where a key stands for several texts, the least set is its class's own
    firsts = least.filter(F.substring("fp", 1, 1) == F.lit(b"\1")).groupBy("class_key").agg(F.min(F.struct("fp", F.col("tag").alias("own_tag"))).alias("m")).select("class_key", "m.*")
    kind = dict(least.dtypes)["class_key"]
    heads = _sets(docs.withColumnRenamed(key, "class_key"), "class_key", column, words, False).mapInArrow(_prefixes(shared, "class_key", similarity), f"class_key {kind}, tag bigint, n int, head binary, sketch binary")
    # classes meet heads, not texts: those are never shuffled; nor are heads where the classes, or the texts that are no class's own, are few
    chosen = materialize(firsts.select("class_key", F.col("own_tag").alias("tag")), "own")
    full = ids.filter(F.substring("fp", 1, 1) == F.lit(b"\1")).select(F.col(key).alias("class_key"), "tag")
    classes = chosen.count()
    if FEW < classes and full.count() - classes <= FEW:
        heads = heads.join(F.broadcast(materialize(full.join(chosen, ["class_key", "tag"], "left_anti"), "copies")), ["class_key", "tag"], "left_anti")
    else:
        heads = heads.join(F.broadcast(chosen) if classes <= FEW else chosen, ["class_key", "tag"], "left_semi")
    heads = materialize(heads.filter("class_key is not null").select("class_key", "n", "head", "sketch"), "heads")
    shared.destroy()
    discard(chosen)
    repeated = _repeated(heads)
    close = F.col("b.n") >= F.col("a.n") * similarity
    left = 1 + F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) >= similarity / (1 + similarity) * (F.col("a.n") + F.col("b.n")) - 1e-6
    met = []
    for k in range(ROUNDS):
        part = heads.select("class_key", "n", "head").mapInArrow(_postings(k, repeated[k]), f"class_key {kind}, n int, at int, g bigint")
        a, b = part.alias("a"), part.alias("b")
        pair = a.join(b, (F.col("a.g") == F.col("b.g")) & ((F.col("a.n") > F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.class_key") < F.col("b.class_key")))) & close & left)
        met.append(materialize(pair.select(F.least("a.class_key", "b.class_key").alias("a"), F.greatest("a.class_key", "b.class_key").alias("b")).distinct(), "met"))
    sketch = lambda x: heads.select(F.col("class_key").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    cand = union_all(met).distinct().join(sketch("a"), "a").join(sketch("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    cand = materialize(cand.mapInArrow(_possible(similarity), f"a {kind}, b {kind}").distinct(), "candidates")
    for t in (heads, *met):
        discard(t)
    wanted = cand.select("a").unionAll(cand.select("b")).distinct().withColumnRenamed("a", "class_key").join(firsts.select("class_key", F.col("fp").alias("first")), "class_key")
    wanted = materialize(wanted.withColumnRenamed("class_key", key), "wanted")
    few = wanted.count() <= FEW
    held = docs.join(F.broadcast(wanted) if few else wanted, key).withColumn("__id", F.struct(F.col(key).alias("class_key"), column, "first"))
    reps = shingles(held, "__id", column, words).withColumn(key, F.lit(None)).select("__id", F.explode(F.array(_fingerprint(key))).alias("fp")).filter(F.col("fp") == F.col("__id.first"))
    reps = materialize(reps.select("__id.class_key", f"__id.{column}").dropDuplicates(["class_key"]), "reps")
    pa_, pb = reps.select(F.col("class_key").alias("a"), F.col(column).alias("ta")), reps.select(F.col("class_key").alias("b"), F.col(column).alias("tb"))
    met = cand.join(pa_, "a").join(pb, "b").withColumn("__p", F.struct("a", "b", "tb"))
    met = shingles(met, "__p", "ta", words).select("__p", F.col("sh").alias("sa")).withColumn("tb", F.col("__p.tb")).withColumn("__p", F.struct("__p.a", "__p.b", "sa"))
    met = shingles(met, "__p", "tb", words).select("__p.a", "__p.b", "__p.sa", F.col("sh").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    pairs = met.withColumn("jaccard", both / (F.size("sa") + F.size("sb") - both)).filter(F.col("jaccard") >= similarity - 1e-9).select("a", "b", "jaccard")
    pairs = materialize(pairs, "pairs")
    for t in (reps, wanted, cand):
        discard(t)
    return ids.select(key, "fp"), least.select("fp", "class_key"), pairs


def near_duplicates(docs: DataFrame, key: str, column: str, similarity: float = 0.8, words: int = 5) -> tuple[DataFrame, DataFrame]:
    """Near-duplicates by Jaccard similarity of word shingles; see similar_classes.

    Members: (key, class_key, class_id, links): every document, the class of equal shingle sets it belongs to (its least
    key), the component of similar classes, and to how many classes its class is linked. Pairs: (a, b, jaccard) between
    class keys. Documents without shingles (null, empty, only marks) are classes of their own and have no links.
    """
    ids, classes, pairs = similar_classes(docs, key, column, similarity, words)
    comps = connected_components(pairs.select("a", "b"))
    links = pairs.select("a").unionAll(pairs.select("b")).groupBy(F.col("a").alias("class_key")).agg(F.count(F.lit(1)).alias("links"))
    members = (
        ids.join(classes, "fp").drop("fp")
        .join(comps.select(F.col("node").alias("class_key"), "component"), "class_key", "left").join(links, "class_key", "left")
        .select(key, "class_key", F.coalesce("component", "class_key").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    return members, pairs


def split_of(group, seed: str = ""):
    """train, validation or test (70/20/10) by the SHA-256 of a group."""
    b = T.hash_bucket(F.concat(F.lit(seed), group.cast("string")))
    return F.when(b < 7, "train").when(b < 9, "validation").otherwise("test")


def canonical(docs: DataFrame, group: str, order: list) -> DataFrame:
    """One row per group, the first in order, with the number of rows it stands for."""
    w = Window.partitionBy(group).orderBy(*order)
    return docs.withColumn("__r", F.row_number().over(w)).withColumn("variants", F.count(F.lit(1)).over(Window.partitionBy(group))).filter("__r = 1").drop("__r")


def length_matched(probes: DataFrame, pool: DataFrame, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """(probe_id, pool_id): the pool row of nearest length within [low * n, high * n]; ties go to the lesser id. Never itself.

    The pool is reduced to the least two ids of each length, so the range join sees lengths, not rows.
    """
    per = pool.groupBy("n").agg(F.array_sort(F.collect_set("pool_id")).alias("all")).select(F.col("n").alias("m"), F.slice("all", 1, 2).alias("ids"))
    near = probes.join(per, (F.col("m") >= F.col("n") * low) & (F.col("m") <= F.col("n") * high))
    one = near.select("probe_id", "n", "m", F.explode("ids").alias("pool_id")).filter("probe_id <> pool_id")
    return one.groupBy("probe_id").agg(F.min_by("pool_id", F.struct(F.abs(F.col("m") - F.col("n")), F.col("pool_id"))).alias("pool_id"))


def quote_status(forms: DataFrame, hay: DataFrame, short: int = 5) -> DataFrame:
    """(line, candidates, selected, status, id) of each quote, from its normal forms (line, post_id, text) and posts (id, text).

    Candidates are posts that hold a form. If the recorded post is among them it alone is selected, else all are. A quote is matched if one post is selected
    and, where some form has fewer than ``short`` characters, that is the recorded one; else ambiguous, or unmatched without
    candidates. id is the post of a matched quote. Forms of any length are found: long ones by grams of six characters, shorter ones by shorter grams.
    """
    needles = forms.select("line", "text").distinct().withColumn("quote", F.concat_ws("|", F.col("line").cast("string"), F.sha2("text", 256)))
    found = None
    for low, high in ((6, None), (2, 6), (1, 2)):
        some = needles.filter((F.length("text") >= low) & (F.lit(True) if high is None else F.length("text") < high))
        hits = containment(some.select("quote", "text"), hay, "quote", "id", low)
        found = hits if found is None else found.unionByName(hits)
    recorded = forms.groupBy("line").agg(F.collect_set("post_id").alias("posts"), F.bool_or(F.length("text") < short).alias("short"))
    c = found.join(needles.select("quote", "line"), "quote").select("line", "id").distinct().join(recorded, "line").withColumn("near", F.array_contains("posts", F.col("id")))
    per = c.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.count_if("near").alias("c"), F.min(F.when(F.col("near"), F.col("id"))).alias("ni"), F.min("id").alias("ai"))
    j = recorded.join(per, "line", "left").withColumn("selected", F.when(F.col("c") > 0, F.col("c")).otherwise(F.coalesce("n", F.lit(0))))
    sure = F.coalesce((F.col("selected") == 1) & (~F.col("short") | (F.col("c") > 0)), F.lit(False))
    status = F.when(F.col("n").isNull(), "unmatched").when(sure, "matched").otherwise("ambiguous")
    return j.select("line", F.coalesce("n", F.lit(0)).alias("candidates"), "selected", status.alias("status"), F.when(sure, F.coalesce("ni", "ai")).alias("id"))
