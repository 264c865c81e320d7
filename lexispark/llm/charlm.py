"""Smoothed character n-gram models in hashed tables of a fixed size.

Counts come from all texts: each Spark task adds up its own tables and emits the slots it met, a shuffle sums them, and
the tables, whose size does not depend on the corpus, are broadcast to the tasks that score.
"""

from __future__ import annotations

import zlib

import numpy as np

BITS = (16, 20, 21)  # slots of the tables of single characters, pairs and triples
OFFSET = (0, 1 << 16, (1 << 16) + (1 << 20))
SLOTS = OFFSET[2] + (1 << 21)
WEIGHTS = (0.001, 0.1, 0.3, 0.599)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pack(table: np.ndarray) -> tuple:
    """A sparse, compressed copy of a table of counts, to be broadcast."""
    flat = table.ravel()
    at = np.flatnonzero(flat)
    return table.shape, zlib.compress(np.diff(at, prepend=0).astype(np.uint32).tobytes(), 1), zlib.compress(flat[at].astype(np.float32).tobytes(), 1)


def unpack(packed: tuple) -> np.ndarray:
    shape, gaps, values = packed
    out = np.zeros(int(np.prod(shape)), dtype=np.float32)
    out[np.cumsum(np.frombuffer(zlib.decompress(gaps), dtype=np.uint32).astype(np.int64))] = np.frombuffer(zlib.decompress(values), dtype=np.float32)
    return out.reshape(shape)


def codes(text: str) -> np.ndarray:
    """Code points with every ASCII and full-width digit as 0."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    a[(a >= 48) & (a <= 57)] = 48
    return a


def _slots(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the single characters a[2:], the pairs that end there and the triples that end there."""
    x = a.astype(np.uint64)
    one = x & np.uint64(0xFFFF)
    two = ((x[:-1] * _K1) ^ (x[1:] * _K2)) >> np.uint64(20)
    three = ((((x[:-2] * _K2) ^ (x[1:-1] + np.uint64(77))) * _K1) ^ (x[2:] * _K2)) >> np.uint64(22)
    return one.astype(np.int64), (two & np.uint64((1 << 20) - 1)).astype(np.int64), (three & np.uint64((1 << 21) - 1)).astype(np.int64)


def count(texts: list[str], into: np.ndarray) -> None:
    """Add the n-grams of the texts to a table of SLOTS counts. Texts are framed by line breaks."""
    if not texts:
        return
    a = codes("\n\n" + "\n\n".join(texts) + "\n\n")
    one, two, three = _slots(a)
    into[: OFFSET[1]] += np.bincount(one, minlength=1 << 16)
    into[OFFSET[1] : OFFSET[2]] += np.bincount(two, minlength=1 << 20)
    into[OFFSET[2] :] += np.bincount(three, minlength=1 << 21)


class Model:
    """Interpolated trigram probabilities from a table of counts."""

    def __init__(self, table: np.ndarray):
        self.one, self.two, self.three = (table[a : a + (1 << b)].astype(np.float32, copy=False) for a, b in zip(OFFSET, BITS))
        self.total = max(float(self.one.sum()), 1.0)

    def char_scores(self, text: str) -> np.ndarray:
        """Natural log-probability of each character of text, given the two before it."""
        return self._of(codes("\n\n" + text))

    def point_scores(self, points: np.ndarray) -> np.ndarray:
        """char_scores of a text given as code points."""
        a = np.concatenate((np.array([10, 10], dtype=np.uint32), points.astype(np.uint32, copy=False)))
        a[(a >= 48) & (a <= 57)] = 48
        return self._of(a)

    def _of(self, a: np.ndarray) -> np.ndarray:
        one, two, three = _slots(a)
        w0, w1, w2, w3 = WEIGHTS
        p = w0 / 65536 + w1 * self.one[one[2:]] / self.total
        p += w2 * self.two[two[1:]] / np.maximum(self.one[one[1:-1]], 1)
        p += w3 * self.three[three] / np.maximum(self.two[two[:-1]], 1)
        return np.log(np.minimum(p, 1.0))

    def scores(self, texts: list[str]) -> list[np.ndarray]:
        """char_scores of many texts at once, each framed on its own."""
        if not texts:
            return []
        whole = self.char_scores("\n\n".join(texts))
        out, at = [], 0
        for t in texts:
            out.append(whole[at : at + len(t)])
            at += len(t) + 2
        return out

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability and length of each text."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        if not texts:
            return np.zeros(0), sizes
        run = np.concatenate(([0.0], np.cumsum(self.char_scores("\n\n".join(texts)), dtype=np.float64)))
        ends = np.cumsum(sizes + 2) - 2
        return run[ends] - run[ends - sizes], sizes
