"""Sentence boundaries across languages and scripts by semi-Markov dynamic programming.

A line break always ends a sentence, so the lines of the corpus teach how sentences open and close: for each possible
boundary inside a line, the share of line ends among the places with the same closing characters, and of line starts
among the places with the same opening characters, tell how likely a sentence ends and starts there. Whole spans are then
chosen so that openings, closings, lengths and balanced quotations together score best. No abbreviation list is used.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.charlm import pack, unpack
from lexispark.llm.lookalikes import LETTERS, SHAPE, _BASE

DEPTH = 8  # characters of an opening or closing that are looked at
BITS = 20
TABLES = 4  # closings at line ends, at other places; openings at line starts, at other places
LENGTHS = TABLES << BITS  # then: number, sum and sum of squares of log-lengths (times 1000) of lines of one sentence
SLOTS = LENGTHS + 3
BINS = 1 << 16  # of the histograms of shares, from which rho is read
BACKOFF = 2.0
ENOUGH = 4  # a context is heeded from so many other occurrences on
SURE = 9.0  # log-odds beyond which length cannot change the decision
UNBALANCED = 8.0
_K = np.uint64(0x9E3779B97F4A7C15)

# Terminal marks, closers, laughs and faces, as they are after folding (see _fold).
_TERM = "。.!?…‥।॥؟۔~"
_CLOSE = "」』】)\\]}”’\"'»›》〉"
_LAUGH = r"w{2,}(?![a-z])|orz|otl(?![a-z])|[☆★♪♡♥]+|\([笑爆泣汗]\)"
_FACE = r"[σς]?\([^()\n]{0,4}[´`∀゚дω∇^;_・>≧≦][^()\n]{0,6}\)[ノシ]*"
_CJK = "฀-๿぀-ヿ㐀-鿿"
# the look-ahead rejects most characters before the alternatives are tried
_FIRST = f"(?=[ {_TERM}wo☆★♪♡♥σς(・※■◆●▼•])"
CANDIDATE = re.compile(
    f"{_FIRST}(?:(?:(?:[{_TERM}]+|{_LAUGH}|{_FACE})(?:[{_TERM}{_CLOSE}]|{_LAUGH}|{_FACE})*) *(?=[^ \n])"
    f"|(?<=[^ \na-z0]) {{2,}}(?=[^ \n])|(?<=[{_CJK}]) (?=[^ \n])|(?<=[^ \n]) (?=[{_CJK}])|(?<=[^ \n])(?=[・※■◆●▼•]))"
)
ANCHOR = re.compile(r">>0+(?:-0+)? *$")
_LATIN = np.zeros(0x110000, bool)
_LATIN[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789=/&_-@%+#"]] = True
_STOPS = np.array([ord(c) for c in ".!?~"], dtype=np.uint32)


def _fold_table() -> np.ndarray:
    """Code point → one code point: width and look-alikes folded, lower case, digits as 0; 0 for what can't be seen."""
    t = np.arange(0x110000, dtype=np.uint32)
    for cp in [*range(0x10000), *range(0xE0100, 0xE01F0)]:
        if 0xD800 <= cp < 0xE000 or 0xAC00 <= cp < 0xD7A4 or 0x3400 <= cp < 0xA000:
            continue
        c = chr(cp)
        b = "\n" if c == "\r" else _BASE[cp]
        if not b:
            t[cp] = 0
            continue
        x = b[0]
        x = (SHAPE[x] if x in LETTERS else x).lower()[0]
        t[cp] = 48 if x.isdigit() else ord(x)
    return t


_TABLE: list = []


def fold() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_fold_table())
    return _TABLE[0]


_DEEP = {c: 1 for c in "「『（(【《〈[{«‹“„"} | {c: -1 for c in "」』）)】》〉]}»›”"}


class Lines:
    """Many texts as one array of folded characters, with their lines and the places where a sentence may start."""

    def __init__(self, texts: list[str], inner: bool = True):
        """Without ``inner``, only the lines' own ends and starts are found."""
        whole = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        folded = fold()[whole]
        self.pos = np.flatnonzero(folded)
        self.a = a = folded[self.pos]
        self.text_at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        self.ends = nl = np.flatnonzero(a == 10)
        low = np.flatnonzero(a == ord("„"))
        if len(low):  # in a line with a low opening quote the high one closes
            german = np.zeros(len(nl), bool)
            german[np.searchsorted(nl, low)] = True
            q = np.flatnonzero(a == ord("“"))
            a[q[german[np.searchsorted(nl, q)]]] = ord("”")
        s = a.tobytes().decode("utf-32-le", "surrogatepass")
        n = len(a)
        idx = np.arange(n)
        solid = (a != 32) & (a != 10)
        nxt = np.minimum.accumulate(np.where(solid, idx, n)[::-1])[::-1]
        self.prev = prev = np.maximum.accumulate(np.where(solid, idx, -1))
        begin = np.concatenate(([0], nl[:-1] + 1))
        self.first = nxt[begin]
        self.real = self.first < nl
        self.last = prev[nl]  # last solid character of the line, if the line is real
        at = self._starts(s) if inner else np.zeros(0, dtype=np.int64)
        self.cand = at
        line = np.searchsorted(nl, self.cand)
        keep = (self.cand < nl[np.minimum(line, len(nl) - 1)]) & (self.cand > self.first[np.minimum(line, len(nl) - 1)]) if len(at) else np.zeros(0, bool)
        self.cand, self.line = self.cand[keep], line[keep]
        self.close_at = prev[self.cand - 1] + 1 if len(self.cand) else self.cand
        self.s, self.begin = s, begin

    def _starts(self, s: str) -> np.ndarray:
        """Marks inside a number, address or abbreviation without blanks start nothing; nor does what follows an anchor."""
        spans = np.array([m.span() for m in CANDIDATE.finditer(s)], dtype=np.int64).reshape(-1, 2)
        i, j = spans[:, 0], spans[:, 1]
        before = self.a[j - 1]
        blank = (i == j) | (before == 32)
        no = ~blank & _LATIN[self.a[j]] & ((i == 0) | _LATIN[self.a[i - 1]]) & np.isin(before, _STOPS)
        if ">>" in s:
            for k in np.flatnonzero(blank).tolist():
                head = s[max(0, i[k] - 12) : j[k]]
                no[k] = ">>" in head and ANCHOR.search(head) is not None
        return j[~no]

    def depth(self) -> np.ndarray:
        """Open brackets and quotes before each character, within its line."""
        step = np.zeros(len(self.a) + 1, dtype=np.int32)
        for c, d in _DEEP.items():
            step[1:][self.a == ord(c)] = d
        run = np.cumsum(step)
        return run[:-1] - np.repeat(run[self.begin], np.diff(np.concatenate((self.begin, [len(self.a)]))))

    def _hashes(self, start: np.ndarray, step: int) -> Iterator[np.ndarray]:
        """Slots of the 1, 2, ... DEPTH characters from start on; characters beyond the line count as none."""
        a, n = self.a, len(self.a)
        h = np.zeros(len(start), dtype=np.uint64)
        alive = np.ones(len(start), bool)
        for k in range(DEPTH):
            i = start + k * step
            c = np.where((i >= 0) & (i < n), a[np.clip(i, 0, n - 1)], 10)
            alive &= c != 10
            h = np.where(alive, (h ^ (c.astype(np.uint64) + np.uint64(k + 1))) * _K, h * _K + np.uint64(7))
            yield ((h >> np.uint64(40)) & np.uint64((1 << BITS) - 1)).astype(np.int64)

    def closings(self, at: np.ndarray) -> Iterator[np.ndarray]:
        return self._hashes(at - 1, -1)

    def openings(self, at: np.ndarray) -> Iterator[np.ndarray]:
        return self._hashes(at, 1)

    def count(self, into: np.ndarray) -> None:
        real = self.real
        sets = (self.closings(self.last[real] + 1), self.closings(self.close_at), self.openings(self.first[real]), self.openings(self.cand))
        for k, hashes in enumerate(sets):
            for h in hashes:
                np.add.at(into[k << BITS : (k + 1) << BITS], h, 1)
        one = real.copy()
        one[self.line] = False
        logs = np.log(np.maximum(self.last[one] - self.first[one] + 1, 1.0))
        into[LENGTHS:] += np.array([len(logs), int((logs * 1000).sum()), int((logs * logs * 1000).sum())])


class Model:
    def __init__(self, table: np.ndarray, rho: tuple[float, float] | None = None):
        """rho: the shares that true boundaries, of ends and of starts, have (see _rho)."""
        t = table.astype(np.float32, copy=False)
        self.t = [t[k << BITS : (k + 1) << BITS] for k in range(TABLES)]
        # every line gives DEPTH slots
        self.lines, self.inner = max(float(self.t[0].sum()) / DEPTH, 1.0), max(float(self.t[1].sum()) / DEPTH, 1.0)
        self.base = self.lines / (self.lines + self.inner)
        n, s, q = (float(x) for x in table[LENGTHS:])
        self.mean = float(s / 1000 / n) if n else 3.3
        self.std = float(max(np.sqrt(max(q / 1000 / n - self.mean**2, 0.0)) if n else 0.8, 0.5))
        self.rho = rho or (self.base, self.base)

    def share(self, kind: int, hashes: Iterator[np.ndarray], own: int) -> np.ndarray:
        """The share of line ends (kind 0) or starts (kind 1) among other places with the same characters, backed off from
        long to short. own: 0 if the places asked about are line ends or starts themselves, else 1.
        """
        edge, other = self.t[2 * kind], self.t[2 * kind + 1]
        p = self.base
        for h in hashes:
            e = np.maximum(edge[h] - (own == 0), 0)
            n = e + np.maximum(other[h] - (own == 1), 0)
            p = np.where(n >= ENOUGH, (e + BACKOFF * p) / (n + BACKOFF), p)
        return p

    def edges(self, lines: Lines, into: np.ndarray) -> None:
        """Count the shares of the lines' own ends and starts into two histograms of BINS."""
        real = lines.real
        if real.any():
            sets = (lines.closings(lines.last[real] + 1), lines.openings(lines.first[real]))
            for kind, hashes in enumerate(sets):
                at = np.minimum(self.share(kind, hashes, 0) * BINS, BINS - 1).astype(np.int64)
                into[kind] += np.bincount(at, minlength=BINS)

    def log_odds(self, lines: Lines) -> np.ndarray:
        """Of each candidate: that a sentence ends before it and one starts at it."""
        out = np.zeros(len(lines.cand))
        if not len(out):
            return out
        rho = min(max((self.rho[0] + self.rho[1]) / 2, 0.05), 0.95)
        prior = min(max(self.lines * (1 - rho) / rho / self.inner, 0.05), 0.95)
        for kind, hashes in ((0, lines.closings(lines.close_at)), (1, lines.openings(lines.cand))):
            q = np.clip(self.share(kind, hashes, 1) / max(self.rho[kind], 0.02), 0.002, 0.998)
            out += np.log(q / (1 - q))
        return out - np.log(prior / (1 - prior))

    def length(self, n: float) -> float:
        z = (math.log(max(n, 1.0)) - self.mean) / self.std
        return -0.5 * z * z


def segment(texts: list[str], model: Model) -> list[list[int]]:
    """The start offsets, in characters of each stored text, of its sentences."""
    if not texts:
        return []
    lines = Lines(texts)
    score = model.log_odds(lines)
    depth = lines.depth()
    d = depth[lines.cand] if len(lines.cand) else np.zeros(0, int)
    yes = (score > SURE) & (d <= 0)
    open_ = ~yes & (score > -SURE)
    starts = [lines.first[lines.real], lines.cand[yes]]
    todo = np.unique(lines.line[open_])
    if len(todo):
        lo, hi = np.searchsorted(lines.line, todo), np.searchsorted(lines.line, todo, side="right")
        more: list[int] = []
        cand, sc = lines.cand.tolist(), score.tolist()
        dd, fixed, free = d.tolist(), yes.tolist(), open_.tolist()
        ends_depth = depth[lines.ends]
        for k, i, j in zip(todo.tolist(), lo.tolist(), hi.tolist()):
            # places between two sure boundaries are decided on their own
            part = [(int(lines.first[k]), 0.0, 0)]
            for c in range(i, j):
                if fixed[c]:
                    more += _best_spans([*part, (cand[c], 0.0, dd[c])], model)
                    part = [(cand[c], 0.0, dd[c])]
                elif free[c]:
                    part.append((cand[c], sc[c], dd[c]))
            more += _best_spans([*part, (int(lines.last[k]) + 1, 0.0, int(ends_depth[k]))], model)
        starts.append(np.array(more, dtype=np.int64))
    at = np.unique(np.concatenate(starts))
    whole = lines.pos[at]
    owner = np.searchsorted(lines.text_at, whole, side="right") - 1
    local = whole - lines.text_at[owner]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [local[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])]


def _best_spans(places: list[tuple[int, float, int]], model: Model) -> list[int]:
    """The inner places where sentences start, of places (offset, log-odds, depth) whose first and last are boundaries.

    Semi-Markov: best[j] is the best score of the spans up to place j; a span scores its length, its boundary's log-odds
    and whether quotations opened in it are closed in it.
    """
    n = len(places)
    if n == 2:
        return []
    best, back = [0.0] + [-1e18] * (n - 1), [0] * n
    top, usual = [0.0] * n, math.exp(model.mean)  # top[i]: the best of best[0] to best[i]
    for j in range(1, n):
        pj, sj, dj = places[j]
        for i in range(j - 1, -1, -1):
            pi, _, di = places[i]
            v = best[i] + sj + model.length(pj - pi) - (UNBALANCED if dj != di else 0.0)
            if v > best[j]:
                best[j], back[j] = v, i
            # beyond the usual length longer spans only score less, and no length scores above 0
            if i and top[i - 1] + sj + (model.length(pj - pi) if pj - pi >= max(usual, 1.0) else 0.0) <= best[j]:
                break
        top[j] = max(top[j - 1], best[j])
    out, j = [], back[n - 1]
    while j > 0:
        out.append(places[j][0])
        j = back[j]
    return out


CHUNK = 400_000  # characters handled at once


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size > CHUNK:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    table = np.zeros(SLOTS, dtype=np.int64)
    for b in batches:
        texts = b["text"].tolist()
        for i, j in _chunks(texts):
            Lines(texts[i:j]).count(table)
    slots = np.flatnonzero(table)
    if len(slots):
        yield pd.DataFrame({"slots": [slots.astype(np.int32)], "counts": [table[slots]]})


def train(texts: DataFrame) -> np.ndarray:
    """The table of counts over all rows of (text), of a fixed number of slots."""
    rows = texts.select("text").mapInPandas(_count, "slots array<int>, counts array<bigint>")
    return _sums(rows, SLOTS)


def _sums(rows: DataFrame, size: int) -> np.ndarray:
    """Counts of (slots, counts) summed up; at most size rows reach the driver."""
    sums = rows.select(F.explode(F.arrays_zip("slots", "counts")).alias("z")).groupBy(F.col("z.slots").alias("slot")).agg(F.sum("z.counts").alias("n"))
    got = sums.toPandas()
    table = np.zeros(size, dtype=np.int64)
    table[got["slot"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    return table


def _rho(texts: DataFrame, shared: Broadcast) -> tuple[float, float] | None:
    """The median shares of the ends and of the starts of all lines of (text), to 1 in BINS; None without lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, out = Model(unpack(shared.value)), np.zeros((2, BINS), dtype=np.int64)
        for b in batches:
            t = b["text"].tolist()
            for i, j in _chunks(t):
                model.edges(Lines(t[i:j], False), out)
        at = np.flatnonzero(out)
        if len(at):
            yield pd.DataFrame({"slots": [at.astype(np.int32)], "counts": [out.ravel()[at]]})

    table = _sums(texts.select("text").mapInPandas(run, "slots array<int>, counts array<bigint>"), 2 * BINS).reshape(2, BINS)
    if not table.any():
        return None
    middle = [np.searchsorted(np.cumsum(x), [(x.sum() + 1) // 2, x.sum() // 2 + 1]).mean() for x in table]
    return float((middle[0] + 0.5) / BINS), float((middle[1] + 0.5) / BINS)


def fit(texts: DataFrame) -> Broadcast:
    """What load makes a model of, from all rows of (text): the packed counts and rho, broadcast."""
    context = texts.sparkSession.sparkContext
    packed = pack(train(texts))
    counts = context.broadcast(packed)
    rho = _rho(texts, counts)
    counts.unpersist()
    return context.broadcast((packed, rho))


def load(fitted: tuple) -> Model:
    return Model(unpack(fitted[0]), fitted[1])


def split(texts: DataFrame) -> DataFrame:
    """(tbl, rec_id, start_at, end_at): one row per sentence of each row (tbl, rec_id, text).

    Offsets count Unicode characters of the stored text from 0; the end is after the sentence's last non-blank
    character. Null, empty and blank texts have no sentences. Repeated rows give repeated sentences. Texts of any
    length are split whole.
    """
    rows = texts.select("tbl", "rec_id", "text").filter("text is not null and text <> ''")
    shared = fit(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(shared.value)
        for b in batches:
            t = b["text"].tolist()
            starts: list[list[int]] = []
            for i, j in _chunks(t):
                starts += segment(t[i:j], model)
            ends = [[len(x[a:z].rstrip()) + a for a, z in zip(s, [*s[1:], len(x)])] for x, s in zip(t, starts)]
            yield pd.DataFrame({"tbl": b["tbl"], "rec_id": b["rec_id"], "starts": starts, "ends": ends})

    flat = rows.mapInPandas(run, "tbl string, rec_id string, starts array<int>, ends array<int>")
    return flat.select("tbl", "rec_id", F.explode(F.arrays_zip("starts", "ends")).alias("z")).select("tbl", "rec_id", F.col("z.starts").alias("start_at"), F.col("z.ends").alias("end_at"))


def corpus(posts: DataFrame, captures: DataFrame) -> DataFrame:
    """(tbl, rec_id, text) of all posts and captured sources."""
    a = posts.select(F.lit("posts").alias("tbl"), F.col("id").cast("string").alias("rec_id"), F.col("content").alias("text"))
    b = captures.select(F.lit("ginza_discourse_modesty").alias("tbl"), F.col("case_id").cast("string").alias("rec_id"), F.col("source").alias("text"))
    return a.unionAll(b).filter("text is not null and text <> ''")


