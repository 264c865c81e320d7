"""Subject areas of documents: subject-specific interpolated n-gram language models against a background model.

A sentence's evidence for a subject is the difference of its cross-entropies under the background and the subject model,
summed over its tokens, each drawn in by its sampling error so that chance differences count nothing; tokens are characters
in scripts without blanks and words elsewhere, all languages together. The models start from the labelled documents and
are fitted again, some rounds, on all documents of the corpus in which they find exactly one subject beyond doubt, which
spreads subjects to terms and languages that no label covers. A document deals with a subject if at least two of its
sentences do; so the score of a (document, subject) is its second best sentence, accepted from the evidence at which
acceptance agrees with the labels best. That is found for each subject on labelled documents that the models judging them
were not fitted on.

Texts are cut into sentences and tokens once; a table of token hashes serves all passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import sentences as S
from lexispark.llm.charlm import pack, unpack
from lexispark.session import materialize

BITS = (17, 19, 19)
AT = (0, 1 << 17, (1 << 17) + (1 << 19))
SLOTS = AT[2] + (1 << 19)
MU = (300.0, 10.0, 5.0)  # pseudo-counts of the shorter model in the model of 1, 2, 3 tokens
MIX = (0.2, 0.3, 0.5)  # weights of the models of 1, 2, 3 tokens
ERRORS = 1.0  # standard errors by which the evidence of a token is drawn towards nothing
STRICT = 1.5  # a document trains the next round if its one subject has this many times the evidence needed
ROUNDS = 3
NEEDED = 2  # sentences of a subject that make it a subject of the document
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_POS = (np.arange(1, 65, dtype=np.uint64) * _K2) | np.uint64(1)


def _kind_table() -> np.ndarray:
    """Per code point: 0 nothing, 1 letter or mark of a script with blanks, 2 a token of its own."""
    import unicodedata

    t = np.zeros(0x110000, dtype=np.int8)
    for cp in range(0x30000):
        c = unicodedata.category(chr(cp))
        if c[0] in "LM" or cp == 48:
            alone = 0x0E00 <= cp < 0x0E80 or 0x3040 <= cp < 0x3100 or 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4 or 0xF900 <= cp < 0xFB00 or cp >= 0x20000
            t[cp] = 2 if alone or cp == 48 else 1
    return t


_KINDS: list = []


def cut(texts: list[str], model: S.Model) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per text the hashes of its tokens, 32 bits each, and how many tokens each sentence has."""
    if not _KINDS:
        _KINDS.append(_kind_table())
    starts = S.segment(texts, model)
    many = np.array([len(s) for s in starts], dtype=np.int64)
    base = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    begin = np.concatenate([np.asarray(s, dtype=np.int64) + b for s, b in zip(starts, base)] or [np.zeros(0, np.int64)])
    whole = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    folded = S.fold()[whole]
    at = np.flatnonzero(folded)
    a = folded[at]
    kind = _KINDS[0][a]
    head = (kind == 2) | ((kind == 1) & np.concatenate(([True], kind[:-1] != 1)))
    first = np.flatnonzero(head)
    if not len(first) or not len(begin):
        return [np.zeros(0, np.int32)] * len(texts), [np.zeros(n, np.int32) for n in many]
    run = np.arange(len(a)) - np.maximum.accumulate(np.where(head, np.arange(len(a)), 0))
    part = np.where(kind > 0, (a.astype(np.uint64) + np.uint64(1)) * _POS[run % 64], np.uint64(0))
    tok = ((np.add.reduceat(part, first) * _K1) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    sentence = np.maximum(np.searchsorted(begin, at[first], side="right") - 1, 0)
    sizes = np.bincount(sentence, minlength=len(begin)).astype(np.int32)
    ends = np.cumsum(many)[:-1]
    return np.split(tok, np.searchsorted(sentence, ends)), np.split(sizes, ends)


class Tokens:
    """Token slots of many texts, with the sentence of each token and the text of each sentence."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray, sentences: np.ndarray):
        """Of all texts in a row: token hashes, tokens of each sentence, and sentences of each text."""
        self.owner = np.repeat(np.arange(len(sentences)), sentences)
        self.sentence = np.repeat(np.arange(len(sizes)), sizes)
        tok = hashes.view(np.uint32).astype(np.uint64)
        if not len(tok):
            self.one = self.two = self.three = self.ctx1 = self.ctx2 = self.whole = np.zeros(0, np.int64)
            return
        fresh = np.concatenate(([True], self.sentence[1:] != self.sentence[:-1]))
        prev = np.where(fresh, np.uint64(5), np.concatenate((tok[:1], tok[:-1])))
        before = np.where(fresh, np.uint64(9), np.concatenate((prev[:1], prev[:-1])))
        self.one = _slot(tok, 0)
        self.ctx1 = _slot(prev, 0)
        self.two = _slot((prev * _K2) ^ tok, 1)
        self.ctx2 = _slot((before * _K2) ^ prev, 1)
        self.whole = ((before * _K1) ^ prev) * _K2 ^ tok  # names the token with its context
        self.three = _slot(self.whole, 2)

    def at(self, i: np.ndarray) -> "Tokens":
        """The tokens at some places, for their slots only."""
        t = object.__new__(Tokens)
        for name in ("one", "two", "three", "ctx1", "ctx2"):
            setattr(t, name, getattr(self, name)[i])
        return t

    def slots(self, keep: np.ndarray | None = None) -> np.ndarray:
        parts = [x if keep is None else x[keep] for x in (self.one, self.two, self.three)]
        return np.concatenate([p + o for p, o in zip(parts, AT)])


def _slot(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _K1
    return ((h >> np.uint64(30)) & np.uint64((1 << BITS[k]) - 1)).astype(np.int64)


class Models:
    """Row 0 of the counts is the background, the others are the subjects."""

    def __init__(self, counts: np.ndarray):
        c = counts.astype(np.float32, copy=False)
        self.c1, self.c2, self.c3 = c[:, : AT[1]], c[:, AT[1] : AT[2]], c[:, AT[2] :]
        self.n = self.c1.sum(axis=1)

    def _ground(self, t: Tokens, k: int) -> list[np.ndarray]:
        """Probabilities of each token by background models of 1, 2 and 3 tokens; each stands in for the next. The background
        of a subject is the corpus without what the subject's own model was fitted on, so a common subject stands out too.
        """
        rest = lambda c, i: np.maximum(c[0][i] - c[k][i], 0.0)
        one = (rest(self.c1, t.one) + 1.0) / (max(self.n[0] - self.n[k], 0.0) + (1 << BITS[0]))
        two = (rest(self.c2, t.two) + 2.0 * one) / (rest(self.c1, t.ctx1) + 2.0)
        return [one, two, (rest(self.c3, t.three) + 2.0 * two) / (rest(self.c2, t.ctx2) + 2.0)]

    def _mixed(self, k: int, t: Tokens, ground: list[np.ndarray]) -> np.ndarray:
        """Interpolated probability under subject k; what the subject has not seen it takes from the background."""
        one = (self.c1[k][t.one] + MU[0] * ground[0]) / (self.n[k] + MU[0])
        two = (self.c2[k][t.two] + MU[1] * ground[1]) / (self.c1[k][t.ctx1] + MU[1])
        three = (self.c3[k][t.three] + MU[2] * ground[2]) / (self.c2[k][t.ctx2] + MU[2])
        return MIX[0] * one + MIX[1] * two + MIX[2] * three

    def evidence(self, t: Tokens, total: int) -> np.ndarray:
        """(sentences, subjects): how far the cross-entropy under the subject, summed over the sentence's tokens, lies below
        that under the background; the difference of each token is drawn in by its sampling error.
        """
        out = np.zeros((total, len(self.n) - 1), dtype=np.float32)
        if not len(t.one):
            return out
        # a token in its context is judged once, however often it occurs
        _, first, again = np.unique(t.whole, return_index=True, return_inverse=True)
        sentence, t = t.sentence, t.at(first)
        for k in range(1, len(self.n)):
            ground = self._ground(t, k)
            base = sum(w * p for w, p in zip(MIX, ground))
            r = np.log(self._mixed(k, t, ground) / base)
            two, one = self.c2[k][t.ctx2], self.c1[k][t.ctx1]
            # occurrences, found or expected, in the longest context that the subject has seen
            seen = np.where(two > 0, np.maximum(self.c3[k][t.three], two * ground[2]),
                            np.where(one > 0, np.maximum(self.c2[k][t.two], one * ground[1]), np.maximum(self.c1[k][t.one], self.n[k] * ground[0])))
            r = np.sign(r) * np.maximum(np.abs(r) - ERRORS / np.sqrt(seen + 0.5), 0)
            out[:, k - 1] = np.bincount(sentence, weights=r[again], minlength=total)
        return out

    def second(self, t: Tokens, docs: int) -> np.ndarray:
        """(documents, subjects): the evidence of the document's NEEDED-th best sentence among those whose best subject it is."""
        e = self.evidence(t, len(t.owner))
        out = np.full((docs, e.shape[1]), -1e9)
        if len(e):
            best, top = e.argmax(axis=1), e.max(axis=1)
            order = np.lexsort((-top, best, t.owner))
            o, s, v = t.owner[order], best[order], top[order]
            start = np.concatenate(([True], (o[1:] != o[:-1]) | (s[1:] != s[:-1])))
            rank = np.arange(len(o)) - np.maximum.accumulate(np.where(start, np.arange(len(o)), 0))
            nth = rank == NEEDED - 1
            out[o[nth], s[nth]] = v[nth]
        return out


COUNTS = "model int, slots array<int>, counts array<bigint>"
_COUNTS = pa.schema([("model", pa.int32()), ("slots", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])


def _packed(rows: DataFrame) -> dict[int, tuple]:
    """Counts of (model, slots, counts) summed up and packed, by model. Sums and packing are done by executors, a model, of at
    most SLOTS counts, at a time; only compressed tables reach the driver.
    """
    z = rows.select("model", F.explode(F.arrays_zip("slots", "counts")).alias("z"))
    sums = z.groupBy("model", F.col("z.slots").alias("slot")).agg(F.sum("z.counts").alias("n"))

    def one(p: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros(SLOTS, dtype=np.float32)
        table[p["slot"].to_numpy(dtype=np.int64)] = p["n"].to_numpy(dtype=np.float32)
        _, gaps, values = pack(table)
        return pd.DataFrame({"model": p["model"].iloc[:1], "gaps": [gaps], "counts": [values]})

    done = sums.groupBy("model").applyInPandas(one, "model int, gaps binary, counts binary").collect()
    return {r["model"]: ((SLOTS,), bytes(r["gaps"]), bytes(r["counts"])) for r in done}


def _unpacked(tables: list[tuple | None]) -> np.ndarray:
    out = np.zeros((len(tables), SLOTS), dtype=np.float32)
    for k, t in enumerate(tables):
        if t is not None:
            out[k] = unpack(t)
    return out


def _emit(tables: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k, row in enumerate(tables):
        s = np.flatnonzero(row)
        if len(s):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), pa.array(s.astype(np.int32))),
                 pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), pa.array(row[s].astype(np.int64)))], schema=_COUNTS)


ONCE = 1_000_000  # tokens handled at once


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    """Parts of the token table of at most ONCE tokens, or of one text, as they lie in memory."""
    for b in batches:
        tok, size = b.column("tok"), b.column("size")
        bounds = tok.offsets.to_numpy() - tok.offsets[0].as_py()
        at = 0
        while at < len(b):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + ONCE, side="right")) - 1)
            some = b.slice(at, to - at)
            t, n = tok.slice(at, to - at), size.slice(at, to - at)
            yield some, Tokens(t.flatten().to_numpy(zero_copy_only=False), n.flatten().to_numpy(zero_copy_only=False), np.diff(n.offsets.to_numpy()))
            at = to


TOKENS = "doc_id bigint, want array<int>, tok array<int>, size array<int>"


def _cutter(fitted):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = S.load(fitted.value)
        for b in batches:
            texts = b["text"].tolist()
            for i, j in S._chunks(texts):
                tok, size = cut(texts[i:j], model)
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[i:j], "want": b["want"].iloc[i:j], "tok": tok, "size": size})

    return run


def label_sets(labels: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, want array<int>) of the labelled documents: the 1-based subjects; none for those labelled with none."""
    code = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i + 1))])
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(F.collect_set(code[F.col("subject")]).alias("want"))


def classify(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, subject, second): each subject that at least two sentences of the document deal with; distinct.

    Null, empty and blank texts have no subject; neither has any document if there are no labels. Rows of ``labels``
    with a null subject say that the document has none; their doc_id need not exist. Subjects that no label names are
    never given. ``second`` is the evidence, in nats, of the document's second best sentence for the subject. Equal
    evidence of a sentence for several subjects counts for the first by name.
    """
    spark = docs.sparkSession
    names = sorted(r[0] for r in areas.filter("subject <> ''").select("subject").distinct().limit(MOST_SUBJECTS + 1).collect())
    if len(names) > MOST_SUBJECTS:
        raise ValueError(f"at most {MOST_SUBJECTS} subjects are possible")
    text = docs.filter("text is not null and text <> ''").select("doc_id", "text")
    want = materialize(label_sets(labels, names), "wants")
    if not names or want.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, subject string, second double")
    k = len(names) + 1
    all_ = materialize(text.join(want, "doc_id", "left").mapInPandas(_cutter(S.fit(text)), TOKENS), "tokens")
    known = all_.filter("want is not null").withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))

    def background(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((1, SLOTS), dtype=np.int64)
        for _, t in _each(batches):
            out[0] += np.bincount(t.slots(), minlength=SLOTS)
        yield from _emit(out)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Subject s of the documents of half h as model h * k + s, of all as model 2 * k + s."""
        out = np.zeros((3 * k, SLOTS), dtype=np.int32)
        for b, t in _each(batches):
            _add(out, t, [[m * k + s for s in w for m in (h, 2)] for h, w in zip(b.column("half").to_pylist(), b.column("want").to_pylist())])
        yield from _emit(out)

    ground = _packed(all_.mapInArrow(background, COUNTS)).get(0)
    first = _packed(known.mapInArrow(labelled, COUNTS))
    by = [spark.sparkContext.broadcast([ground, *[first.get(h * k + s) for s in range(1, k)]]) for h in range(3)]
    # labelled documents are judged by the models of the other half
    judged = [known.filter(F.col("half") == h).mapInArrow(_scorer(by[1 - h]), SCORED) for h in (0, 1)]
    bars = _thresholds(judged[0].unionAll(judged[1]), k - 1)
    models = by[2]
    for _ in range(ROUNDS):
        # no labelled document trains the models that it is then used to judge
        fitted = _packed(all_.filter("want is null").mapInArrow(_refitter(models, STRICT * bars, k), COUNTS))
        models.unpersist()
        models = spark.sparkContext.broadcast([ground, *[fitted.get(s) for s in range(1, k)]])
        bars = _thresholds(known.mapInArrow(_scorer(models), SCORED), k - 1)
    flat = all_.mapInArrow(_scorer(models), SCORED).select("doc_id", F.posexplode("z").alias("s", "second"))
    code, bar = F.array(*[F.lit(n) for n in names]), F.array(*[F.lit(float(x)) for x in bars])
    took = flat.filter(F.col("second") >= F.element_at(bar, F.col("s") + 1))
    return took.groupBy("doc_id", F.element_at(code, F.col("s") + 1).alias("subject")).agg(F.max("second").alias("second"))


#: More subjects than this are refused: every task holds a table of SLOTS counts for each.
MOST_SUBJECTS = 200
SCORED = "doc_id bigint, want array<int>, z array<double>"


def _add(out: np.ndarray, t: Tokens, sets: list) -> None:
    """Count each text under the models of its set."""
    if not len(t.one):
        return
    doc = t.owner[t.sentence]
    for m in {m for x in sets for m in x}:
        out[m] += np.bincount(t.slots(np.array([m in x for x in sets], dtype=bool)[doc]), minlength=SLOTS).astype(np.int32)


def _scorer(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Models(_unpacked(models.value))
        for b, t in _each(batches):
            z = m.second(t, len(b))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("want"), rows], names=["doc_id", "want", "z"])

    return run


def _refitter(models, bars: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, out = Models(_unpacked(models.value)), np.zeros((k, SLOTS), dtype=np.int32)
        for b, t in _each(batches):
            sure = m.second(t, len(b)) >= bars
            _add(out, t, [[int(x.argmax()) + 1] if x.sum() == 1 else [] for x in sure])
        yield from _emit(out)

    return run


STEP, STEPS = 0.25, 40_000  # nats; of the histograms of evidence
LIKE_ALL = 100.0  # labels, spread as those of all subjects, that are added to those of each subject


def _thresholds(scored: DataFrame, subjects: int) -> np.ndarray:
    """Per subject the evidence at which acceptance agrees best (F1) with the labels, in steps of STEP; histograms are made in
    Spark. The labels of a subject are joined by LIKE_ALL of the average subject, so that few labels do not decide alone.
    """
    flat = scored.select(F.posexplode("z").alias("s", "v"), "want").filter(F.col("v") >= STEP)
    bins = flat.groupBy("s", F.least(F.floor(F.col("v") / STEP), F.lit(STEPS - 1)).cast("int").alias("g"), F.array_contains("want", F.col("s") + 1).alias("y"))
    hits, said, true = np.zeros((subjects, STEPS)), np.zeros((subjects, STEPS)), np.zeros(subjects)
    for r in bins.agg(F.count(F.lit(1)).alias("n")).collect():
        said[r["s"], r["g"]] += r["n"]
        hits[r["s"], r["g"]] += r["n"] if r["y"] else 0
    for r in scored.select(F.explode("want").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect():
        true[r["s"] - 1] = r["n"]
    hits, said = (np.cumsum(x[:, ::-1], axis=1)[:, ::-1] for x in (hits, said))
    share = LIKE_ALL / max(true.sum(), 1.0)
    f1 = 2 * (hits + share * hits.sum(axis=0)) / np.maximum(said + share * said.sum(axis=0) + (true + share * true.sum())[:, None], 1e-9)
    return np.maximum(np.argmax(np.round(f1, 9), axis=1), 1) * STEP


def composition(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(subject, documents, share): how many documents deal with each subject; null is for those with none."""
    total = docs.select("doc_id").distinct().count()
    by = docs.select("doc_id").distinct().join(found, "doc_id", "left").groupBy("subject").agg(F.count_distinct("doc_id").alias("documents"))
    return by.select("subject", "documents", (F.col("documents") / F.lit(max(total, 1))).alias("share"))
