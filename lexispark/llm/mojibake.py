"""Text that was decoded with a wrong character encoding: find it and restore it.

A smoothed character model is trained on clean records. For each suspicious record every chain "encode with the wrong
encoding, decode with the true one" that fits some stretch of the text is a candidate; the likeliest is taken if it gains
more than a margin validated on clean and on garbled held-out lines, and the search repeats on the result, which undoes
double damage and several damaged stretches.
"""

from __future__ import annotations

import codecs
import math
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import charlm
from lexispark.session import materialize

LOST = "�"
# Encodings that text was wrongly read with (one byte, more bytes) and that it was really in.
NARROW = ("cp1252", "mac_roman", "cp437", "cp850", "cp866", "cp1250", "cp1251", "cp1253", "cp1254", "cp1256", "koi8_r", "cp874")
WIDE = ("cp932", "gb18030", "big5", "cp949", "euc_jp")
TRUE_WIDE = ("cp932", "euc_jp", "gb18030", "cp949", "big5")
TRUE_NARROW = ("cp1252", "mac_roman", "cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5", "cp1256", "iso8859_6", "cp874", "cp1253", "cp1255", "cp1250", "cp437")
MARGIN, PLAUSIBLE = 8.0, -9.0
#: One in HELD clean records, by a hash of the text, is kept out of the model and validates the margin.
HELD = 50
STEP, STEPS = 0.25, 4000  # of the histograms of gains; the margin is looked for up to 1,000 nats
NEAR = 64  # steps that are looked at first, and alone where no margin beyond them can be better
SURELY = 0.001  # gains are rounded to this: what is beyond a bound by it is so when rounded too
#: What a chain between one-byte encodings, which fits any text, must gain beside the margin.
PRIOR = 3.0
#: A stretch is looked at more closely if its characters fall below UNLIKELY by SURPRISE in sum.
UNLIKELY, SURPRISE = -4.5, 4.0


def _table(name: str) -> str:
    """The 256 characters of a one-byte encoding; undefined bytes stand for themselves, as lenient decoders have it."""
    return "".join(bytes([b]).decode(name, "replace").replace(LOST, chr(b)) for b in range(256))


TABLES = {n: _table(n) for n in {*NARROW, *TRUE_NARROW}}
BYTE_OF = {n: {c: b for b, c in reversed(list(enumerate(t)))} | {chr(b): b for b in range(0x80, 0xA0) if chr(b) not in t[:128]} for n, t in TABLES.items()}
HIGH = {n: "".join(sorted(c for c, b in m.items() if b > 127)) for n, m in BYTE_OF.items()}
QUIET = "’‘“”„…—–«»·°±§£×½¿¡´ "  # common in clean text beside ASCII
_ANY_HIGH = "".join(sorted({c for n in NARROW for c in HIGH[n]} - set(QUIET)))
_BOTH = re.escape("".join(sorted(set(_ANY_HIGH) | set(QUIET))))
#: two high characters in a row, or alternating with ASCII letters: what a multi-byte text leaves in a one-byte reading
PAIRS = re.compile(f"[{re.escape(_ANY_HIGH)}][{_BOTH}]|[{_BOTH}][{re.escape(_ANY_HIGH)}]")
PAIRS_ANY = re.compile(f"[{re.escape(_ANY_HIGH)}]")
RUN = {n: re.compile(f"[\x00-\x09\x0b-\x7f{LOST}{re.escape(HIGH[n])}]+") for n in NARROW}
#: Characters that stand for the first byte of a UTF-8 sequence.
FIRST = {n: re.compile(f"[{re.escape(TABLES[n][0xC2:0xF5])}]") for n in NARROW}
_TAIL = rb"[\x80-\xbf]"
_SEQ = rb"(?:[\xc2-\xdf]" + _TAIL + rb"|\xe0[\xa0-\xbf]" + _TAIL + rb"|[\xe1-\xef]" + _TAIL + rb"{2}|\xf0[\x90-\xbf]" + _TAIL + rb"{2}|[\xf1-\xf4]" + _TAIL + rb"{3})"
_CUT = rb"(?:[\xe0-\xef]\x1a" + _TAIL + rb"?|[\xe0-\xef]" + _TAIL + rb"\x1a|[\xf0-\xf4]" + _TAIL + rb"{1,2}\x1a|[\xc2-\xdf]\x1a)"
SEQUENCE = re.compile(rb"[\xc2-\xf4][\x80-\xbf\x1a]")  # how every match of the next two begins
UTF8_NARROW = re.compile(rb"(?:" + _SEQ + rb"|" + _CUT + rb")+")
UTF8_WIDE = re.compile(rb"(?:" + _SEQ + rb"|" + _CUT + rb"|(?<=[\x80-\xbf\x1a])[\x00-\x7f](?=[\xc2-\xf4]))*" + rb"[\xe2-\xef]" + _TAIL + rb"{2}" + rb"(?:" + _SEQ + rb"|" + _CUT + rb"|[\x20-\x7e]+(?=[\xc2-\xf4][\x80-\xbf]))+")
UTF8_HINT = re.compile(rb"[\xe2-\xef]" + _TAIL + rb"{2}[\x00-\x7f]*[\xe2-\xef]" + _TAIL + rb"{2}")
ESCAPES = re.compile(r"\x1b?\$[B@](?:[!-~]{2})+?(?:\x1b?\(B|\x1b?\(J|(?=\s)|$)", re.M)
HZ = re.compile(r"~\{(?:[!-~]{2})+~\}")
UTF7 = re.compile(r"\+[A-Za-z0-9+/]{4,}-")
ASCII_FORMS = re.compile(r"\$[B@][!-~]{2}|~\{[!-~]{2}|\+[A-Z][A-Za-z0-9+/]{3,}-")
# sentences; ｡｣ ｡ｩ ｡ｪ are what full stop, ? and ! of one double-byte encoding are in another
PIECE = re.compile("(?:[^。！？\n｡]|｡(?![｣ｩｪ]))*(?:｡[｣ｩｪ]|[。！？]+|\n|$)")
_ASCII = bytes(range(128))
WORD = re.compile(r"\S*[^\x00-\x7f]\S*")
CERTAIN = re.compile("[\x80-\x84\x86-\x9f\ufffd\ue000-\uf8ff]")
LATIN = re.compile("[A-Za-z][㐀-鿿｡-ﾟ]|[㐀-鿿｡-ﾟ][A-Za-z]")
KANA, HANGUL, HAN, HALF = re.compile("[぀-ヿ]"), re.compile("[가-힣]"), re.compile("[㐀-鿿]"), re.compile("[｡-ﾟ]{2}")

_kept: list[str] = []


def _leads(name: str) -> re.Pattern:
    """Characters that stand for the first two bytes of a three-byte UTF-8 sequence in a wrong two-byte reading."""
    cs = {bytes([a, b]).decode(name, "ignore") for a in range(0xE2, 0xF0) for b in range(0x80, 0xC0)}
    return re.compile("[" + "".join(sorted(c for c in cs if len(c) == 1 and c > "\x7f")) + "]")


LEADS = {w: _leads(w) for w in WIDE}


def _keep_narrow(e: UnicodeError):
    """0x1A for what the encoding lacks; control characters stand for their bytes."""
    part = e.object[e.start : e.end]
    _kept.extend(c for c in part if not "\x80" <= c < "\xa0")
    return bytes(ord(c) if "\x80" <= c < "\xa0" else 0x1A for c in part), e.end


codecs.register_error("lexispark.keep_narrow", _keep_narrow)
_MAPS = {n: codecs.charmap_build(t) for n, t in TABLES.items()}


def to_bytes(text: str, name: str) -> tuple[bytes, list[str]]:
    """Bytes of text in an encoding; what it can't encode, and lost characters, become 0x1A and are returned in order."""
    _kept.clear()
    if name in BYTE_OF:
        b = codecs.charmap_encode(text, "lexispark.keep_narrow", _MAPS[name])[0]
        return b, [c for c, x in zip(text, b) if x == 0x1A] if "\x1a" in text else list(_kept)
    points = _points(text)
    has = _tables().can[points] & _BIT[name] > 0
    return _string(np.where(has, points, 0x1A)).encode(name), list(_string(points[~has]))


def _undo_utf8(text: str, name: str, short: bool = False, known: tuple[bytes, list[str]] | None = None) -> str | None:
    """text (known: its to_bytes) with every stretch of valid UTF-8 sequences, seen through the wrong encoding, decoded; None if there are none.

    In a multi-byte reading only stretches with two sequences of three bytes count, unless ``short``: there, sequences of
    two bytes, as accented and Cyrillic letters have, are common by chance.
    """
    wide = name not in BYTE_OF
    b, kept = known or to_bytes(text, name)
    if wide and not short and not UTF8_HINT.search(b):
        return None
    rx = UTF8_NARROW if short or not wide else UTF8_WIDE
    if wide and b"\x00" not in b:
        found = rx.findall(b)
        if not found:
            return None
        if not kept or not any(b"\x1a" in x for x in found):  # what is kept lies between the stretches
            made = b"\n".join(found).decode("utf-8", "replace").replace("\x1a", "").split("\n")
            rest = _refill(rx.sub(b"\x00", b).decode(name, "replace"), kept).split("\x00")
            if len(rest) == len(made) + 1:
                return rest[0] + "".join([y for x in zip(made, rest[1:]) for y in x])
    out, at, k, hit = [], 0, 0, False
    for m in rx.finditer(b):
        if wide:
            head = b[at : m.start()]
            n = head.count(b"\x1a")
            out.append(_refill(head.decode(name, "replace"), kept[k : k + n]))
            k += n + m[0].count(b"\x1a")
        else:  # a byte for each character
            out.append(text[at : m.start()])
        out.append(m[0].decode("utf-8", "replace").replace("\x1a", ""))
        at, hit = m.end(), True
    if not hit:
        return None
    return "".join(out) + (_refill(b[at:].decode(name, "replace"), kept[k:]) if wide else text[at:])


def _refill(text: str, kept: list[str]) -> str:
    if not kept:
        return text
    parts = text.split("\x1a")
    return "".join(x for pair in zip(parts, [*kept, *[""] * (len(parts) - len(kept))]) for x in pair) if len(parts) - 1 == len(kept) else text


def ascii_chains(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(chain, start, end, repaired) of encodings whose bytes are all ASCII."""
    for m in ESCAPES.finditer(text):
        raw = re.sub("\x1b?\\((?:B|J)$", "", m[0]).lstrip("\x1b")
        yield "ascii>iso2022_jp", m.start(), m.end(), (b"\x1b" + raw.encode("latin-1", "replace") + b"\x1b(B").decode("iso2022_jp", "replace")
    for rx, name in ((HZ, "hz"), (UTF7, "utf-7")):
        for m in rx.finditer(text):
            try:
                yield f"ascii>{name}", m.start(), m.end(), m[0].encode().decode(name)
            except UnicodeError:
                pass


ONE_BYTE = [(w, t) for w in NARROW for t in TRUE_NARROW if TABLES[w] != TABLES[t]]
_SWAP = {(w, t): {ord(c): TABLES[t][b] for c, b in BYTE_OF[w].items() if b > 127} for w, t in ONE_BYTE}
BY_WRONG: dict[str, list[str]] = {}
for _w, _t in ONE_BYTE:
    BY_WRONG.setdefault(_w, []).append(_t)


IMPLAUSIBLE = re.compile("[\x80-\x9f\u2500-\u259f\ue000-\uf8ff]")


#: Bits of _CAN: which encodings can encode a code point.
_BIT = {n: np.uint32(1 << i) for i, n in enumerate((*NARROW, *WIDE))}
_BREAK = "\n\n"  # between the parts of a joined text; no part holds it where parts are told apart by it


def _can_table() -> np.ndarray:
    """Code point → the encodings (_BIT) that have it, beside ASCII for the one-byte ones."""
    t = np.zeros(0x110000, dtype=np.uint32)
    for n in NARROW:
        t[[ord(c) for c in HIGH[n]]] |= _BIT[n]
    bmp = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    for n in WIDE:
        missing: list[int] = []

        def skip(e: UnicodeError) -> tuple[bytes, int]:
            missing.extend(range(e.start, e.end))
            return b"", e.end

        codecs.register_error("lexispark.skip", skip)
        bmp.encode(n, "lexispark.skip")
        have = np.ones(len(bmp), bool)
        have[missing] = False
        t[[ord(c) for c, h in zip(bmp, have) if h]] |= _BIT[n]
        if n == "gb18030":  # all planes
            t[0x10000:] |= _BIT[n]
            t[ord(LOST)] &= ~_BIT[n]
    return t


_CODES = {n: np.array([ord(c) for c in t], dtype=np.uint32) for n, t in TABLES.items()}
#: Per one-byte encoding: the bytes whose characters no text holds.
_NO_TEXT = {n: np.array([bool(IMPLAUSIBLE.match(c)) for c in t]) for n, t in TABLES.items()}


_TRUE = {n: np.uint16(1 << i) for i, n in enumerate(TRUE_NARROW)}
#: Byte → the encodings in which no text holds it; and per wrong encoding those that read it otherwise.
_BAD = sum((_NO_TEXT[n].astype(np.uint16) * m for n, m in _TRUE.items()), np.zeros(256, np.uint16))
_OTHER = {w: sum(((_CODES[n] != _CODES[w]).astype(np.uint16) * m for n, m in _TRUE.items()), np.zeros(256, np.uint16)) for w in NARROW}


class _Tables:
    """Tables over all code points, made when first needed."""

    can: np.ndarray
    pair: np.ndarray
    byte: dict[str, np.ndarray]
    #: Bit k: the encoding NARROW[k] has it as the first, the second byte of a UTF-8 sequence.
    lead: np.ndarray
    tail: np.ndarray
    dense: np.ndarray
    cjk: np.ndarray

    def __init__(self):
        self.can = _can_table()
        self.pair = np.zeros(0x110000, dtype=np.uint8)  # 1: as in _ANY_HIGH; 2: in QUIET
        self.pair[[ord(c) for c in QUIET]] = 2
        self.pair[[ord(c) for c in _ANY_HIGH]] = 1
        self.byte = {}
        for n in NARROW:
            b = np.zeros(0x10000, dtype=np.uint8)
            for c, v in BYTE_OF[n].items():
                if v > 127:
                    b[ord(c)] = v
            self.byte[n] = b
        self.lead, self.tail = (np.zeros(0x110000, dtype=np.uint16) for _ in range(2))
        for k, n in enumerate(NARROW):
            b = self.byte[n]
            self.lead[:0x10000] |= ((b >= 0xC2) & (b <= 0xF4)).astype(np.uint16) << np.uint16(k)
            self.tail[:0x10000] |= ((b >= 0x80) & (b <= 0xBF)).astype(np.uint16) << np.uint16(k)
        self.dense = np.zeros(0x110000, dtype=np.uint8)  # bit 0: blanks and digits (none beyond 0x20000), bit 1: Latin letters and signs above ASCII
        for lo, hi in ((0x80, 0x200), (0x2010, 0x2600)):
            self.dense[lo:hi] = 2
        gaps = [c for c in range(0x20000) if chr(c).isspace() or chr(c).isdigit()]
        self.dense[gaps] |= 1
        self.cjk = np.zeros(0x110000, bool)
        for lo, hi in ((0x3040, 0x3100), (0xAC00, 0xD7A4), (0x3400, 0xA000)):
            self.cjk[lo:hi] = True


@cache
def _tables() -> _Tables:
    return _Tables()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _string(points: np.ndarray) -> str:
    return points.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def _spans(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    step = np.diff(np.concatenate(([0], flag.astype(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _run(x: np.ndarray) -> np.ndarray:
    """Running sums, from 0 on; of doubles, so that the place of a text in the whole makes no difference."""
    return np.concatenate(([0], np.cumsum(x, dtype=np.float64 if x.dtype.kind == "f" else np.int64)))


class _Parts:
    """Parts of a text joined by breaks, as one array of code points or bytes; ``at`` and ``to`` are their bounds in it."""

    def __init__(self, whole: np.ndarray, sizes: np.ndarray):
        self.whole, self.to = whole, np.cumsum(sizes + len(_BREAK)) - len(_BREAK)
        self.at = self.to - sizes

    def sums(self, x: np.ndarray) -> np.ndarray:
        r = _run(x)
        return r[self.to] - r[self.at]

    def either(self, bits: np.ndarray) -> np.ndarray:
        """The bits that any character of each part has; breaks have none."""
        out = np.bitwise_or.reduceat(bits, np.minimum(self.at, max(len(bits) - 1, 0))) if len(bits) else np.zeros(len(self.at), bits.dtype)
        return np.where(self.to > self.at, out, 0)

    def text(self, i: int) -> str:
        return _string(self.whole[self.at[i] : self.to[i]])

    @classmethod
    def of(cls, parts: list[str]) -> "_Parts":
        return cls(_points(_BREAK.join(parts)), np.array([len(p) for p in parts], dtype=np.int64))

    def only(self, keep: np.ndarray) -> "_Parts":
        """Some of the parts (a mask), as parts of a smaller whole."""
        inside = np.repeat(keep, self.to - self.at + len(_BREAK))[: len(self.whole)]
        whole = self.whole[inside]
        return _Parts(whole[: len(whole) - (0 if not len(keep) or keep[-1] or not keep.any() else len(_BREAK))], (self.to - self.at)[keep])


def _rises(scores: list[np.ndarray]) -> list[float]:
    """How far the characters of each text fall below UNLIKELY, in sum."""
    sizes = np.array([len(s) for s in scores], dtype=np.int64)
    if not sizes.any():
        return [0.0] * len(scores)
    below = np.maximum(0.0, UNLIKELY - np.concatenate(scores))
    run = _run(below)
    ends = np.cumsum(sizes)
    out = run[ends] - run[ends - sizes]
    for i in np.flatnonzero(np.abs(out - SURPRISE) < 0.01).tolist():  # by itself, so that its place makes no difference
        out[i] = below[ends[i] - sizes[i] : ends[i]].sum()
    return out.tolist()


class _Search:
    """The candidates of many texts at once. Each family of chains goes through all texts in arrays; strings are made only of
    what gains something.
    """

    def __init__(self, model: charlm.Model, plausible: float, texts: list[str], enough: float = math.inf):
        """Texts of which some chain gains ``enough`` are searched no further."""
        self.model, self.plausible, self.tables, self.enough = model, plausible, _tables(), enough
        scores = model.scores(texts)
        rise = _rises(scores)
        self.open = [i for i, (t, r) in enumerate(zip(texts, rise)) if r >= SURPRISE or ASCII_FORMS.search(t)]
        self.texts = [texts[i] for i in self.open]
        self.gains: list[dict[str, list]] = [{} for _ in self.texts]
        self.done = np.zeros(len(self.texts), bool)
        if not self.texts:
            return
        self.whole = _points(_BREAK.join(self.texts))
        sizes = np.array([len(t) for t in self.texts])
        self.begin = np.cumsum(sizes + len(_BREAK)) - sizes - len(_BREAK)
        self.end = self.begin + sizes
        gap = np.zeros(len(_BREAK))
        own = np.concatenate([x for i in self.open for x in (scores[i], gap)])[: len(self.whole)]
        self.odd = _run(np.where(own < UNLIKELY, UNLIKELY - own, 0.0))
        self.lost = _run(self.whole == ord(LOST))
        self.high = _run(self.whole > 127)
        kind = self.tables.pair[self.whole]
        both = (kind[:-1] == 1) & (kind[1:] > 0) | (kind[:-1] > 0) & (kind[1:] == 1)
        self.pairs = np.concatenate((_run(both), [0]))  # pairs[e - 1] - pairs[s]: the pairs within s to e
        self.any_high = _run(kind == 1)
        self._ascii()
        self._narrow()
        self._wide()
        self._words()

    def _owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, at, side="right") - 1

    def _add(self, name: str, at: np.ndarray, to: np.ndarray, fixed: list[str] | _Parts, old: np.ndarray) -> None:
        """Enter what a chain makes of the stretches at to to (places in the whole) if it gains on their own sums."""
        if not len(at):
            return
        parts = _Parts.of(fixed) if isinstance(fixed, list) else fixed
        r = _run(self.model.point_scores(parts.whole))
        new = r[parts.to] - r[parts.at]
        gain = new - old
        better = np.flatnonzero((gain > 0) & (new > self.plausible * (parts.to - parts.at)))
        owner = self._owner(at[better])
        starts, ends = at[better] - self.begin[owner], to[better] - self.begin[owner]
        for j, i, s, e, g in zip(better.tolist(), owner.tolist(), starts.tolist(), ends.tolist(), gain[better].tolist()):
            made = parts.text(j)
            if made != self.texts[i][s:e]:
                mine = self.gains[i].setdefault(name, [])
                mine.append((g, s, e, made))
                if self.enough < math.inf:
                    self.done[i] |= sum(x for x, *_ in mine) > self.enough

    def _own(self, at: np.ndarray, to: np.ndarray) -> tuple[_Parts, np.ndarray]:
        """Stretches as parts, and their log-probabilities."""
        sizes = to - at
        parts = _Parts(np.full(max(int((sizes + len(_BREAK)).sum()) - len(_BREAK), 0), 10, dtype=np.uint32), sizes)
        inside = _spread(parts.at, sizes)
        parts.whole[inside] = self.whole[_spread(at, sizes)]
        return parts, parts.sums(self.model.point_scores(parts.whole))

    def _ascii(self) -> None:
        by: dict[str, list] = {}
        for i, t in enumerate(self.texts):
            if ASCII_FORMS.search(t):
                for name, s, e, fixed in ascii_chains(t):
                    by.setdefault(name, []).append((self.begin[i] + s, self.begin[i] + e, fixed))
        for name, found in by.items():
            at, to = np.array([x[0] for x in found]), np.array([x[1] for x in found])
            self._add(name, at, to, [x[2] for x in found], self._own(at, to)[1])

    def _narrow(self) -> None:
        """Chains from one-byte readings of texts in encodings of more bytes."""
        mixed = (self.pairs[np.maximum(self.end - 1, 0)] - self.pairs[self.begin] > 0) & (self.end - self.begin > 1) | (self.lost[self.end] > self.lost[self.begin])
        if not mixed.any():
            return
        inside = np.zeros(len(self.whole) + 1, dtype=np.int8)
        inside[self.begin[mixed]] = 1
        inside[self.end[mixed]] -= 1
        # only those texts, each with the break behind it
        texts = np.cumsum(inside)[:-1].astype(bool)
        at = np.flatnonzero(texts | np.concatenate(([False], texts[:-1])))
        whole = self.whole[at]
        inside = texts[at] & (whole != 10)
        can = self.tables.can[whole]
        plain = inside & ((whole < 128) | (whole == ord(LOST)))
        seen: set = set()
        for w in NARROW:
            s, e = _spans(plain | inside & (can & _BIT[w] > 0))
            s, e = at[s], at[e - 1] + 1
            keep = (self.odd[e] - self.odd[s] >= SURPRISE) & ((self.lost[e] - self.lost[s]) * 5 <= e - s) & (self.pairs[e - 1] - self.pairs[s] > 0)
            s, e = s[keep], e[keep]
            if self.done.any():
                keep = ~self.done[self._owner(s)]
                s, e = s[keep], e[keep]
            if not len(s):
                continue
            runs, old = self._own(s, e)
            b = np.where(runs.whole < 128, runs.whole, self.tables.byte[w][np.minimum(runs.whole, 0xFFFF)])
            b[runs.whole == ord(LOST)] = 0x1A
            raw = b.astype(np.uint8).tobytes()
            cut = [raw[x:y] for x, y in zip(runs.at.tolist(), runs.to.tolist())]
            new = np.array([(x, y) not in seen for x, y in zip(s.tolist(), cut)], bool)  # else as with an encoding before
            seen.update(zip(s.tolist(), cut))
            self._utf8(w, runs, runs.whole == ord(LOST), old, s, e, cut, new, twice=True)
            long = new & (runs.sums(b > 127) >= 4)
            if long.any():
                self._to_wide(w, [c for c, k in zip(cut, long) if k], s[long], e[long], old[long])

    def _utf8(self, w: str, parts: _Parts, missing: np.ndarray, old: np.ndarray, s: np.ndarray, e: np.ndarray, cut: list[bytes], ask: np.ndarray, twice: bool = False, mark: str = "") -> None:
        at, to, was, fixed = [], [], [], []
        again: tuple[list, ...] = ([], [], [], [])
        for j in np.flatnonzero(ask).tolist():
            if not SEQUENCE.search(cut[j]):
                continue
            text = parts.text(j)
            i = slice(parts.at[j], parts.to[j])
            new = _undo_utf8(text, w, True, (cut[j], list(_string(parts.whole[i][missing[i]])) if b"\x1a" in cut[j] else []))
            if new is None or new == text:
                continue
            for x, y in zip((at, to, was, fixed), (s[j], e[j], old[j], new)):
                x.append(y)
            more = _undo_utf8(new, w) if twice and FIRST[w].search(new) else None
            if more is not None:  # the step between may be no likelier than the start
                for x, y in zip(again, (s[j], e[j], old[j], more)):
                    x.append(y)
        self._add(f"{w}>utf-8{mark}", np.array(at, dtype=np.int64), np.array(to, dtype=np.int64), fixed, np.array(was))
        self._add(f"{w}>utf-8+{w}>utf-8", np.array(again[0], dtype=np.int64), np.array(again[1], dtype=np.int64), again[3], np.array(again[2]))

    def _to_wide(self, w: str, cut: list[bytes], s: np.ndarray, e: np.ndarray, old: np.ndarray) -> None:
        raw = _BREAK.encode().join(cut)
        for t in TRUE_WIDE:
            if t == w:
                continue
            points = _points(raw.decode(t, "replace"))
            breaks = np.flatnonzero(points == 10)[:: len(_BREAK)]
            if len(breaks) == len(cut) - 1:
                fixed = _Parts(points, np.diff(np.concatenate((breaks, [len(points)])), prepend=-len(_BREAK)) - len(_BREAK))
            else:
                fixed = _Parts.of([c.decode(t, "replace") for c in cut])
            # readable: no more than a sixth of what is not ASCII is lost
            ok = fixed.sums(fixed.whole == ord(LOST)) * 6 <= fixed.sums(fixed.whole > 127)
            if ok.any():
                some = fixed.only(ok)
                some.whole = np.where(some.whole == 0x1A, ord(LOST), some.whole)
                self._add(f"{w}>{t}", s[ok], e[ok], some, old[ok])

    def _wide(self) -> None:
        """Chains from readings in encodings of more bytes."""
        half = (self.whole >= 0xFF61) & (self.whole <= 0xFF9F)
        far = _run(self.tables.cjk[self.whole] | half & np.concatenate((half[1:], [False])))
        east = (far[self.end] > far[self.begin]) & ~self.done
        odd = np.flatnonzero(east & (self.odd[self.end] - self.odd[self.begin] >= SURPRISE)).tolist()
        for w in WIDE:
            for i in odd:
                t = self.texts[i]
                if LEADS[w].search(t) and UTF8_HINT.search(t.replace(LOST, "?").encode(w, "replace")):
                    fixed = _undo_utf8(t, w)
                    if fixed is not None:
                        at, to = self.begin[i : i + 1], self.end[i : i + 1]
                        self._add(f"{w}>utf-8", at, to, [fixed], self._own(at, to)[1])
        at, to = [], []
        for i in np.flatnonzero(east).tolist():
            b = int(self.begin[i])
            for m in PIECE.finditer(self.texts[i]):
                s, e = m.span()
                at.append(b + s)
                to.append(b + e - (e > s and m[0][-1] == "\n"))
        s, e = np.array(at, dtype=np.int64), np.array(to, dtype=np.int64)
        if not len(s):
            return
        keep = (self.odd[e] - self.odd[s] >= SURPRISE) & (self.high[e] > self.high[s]) & (e > s)
        s, e = s[keep], e[keep]
        if not len(s):
            return
        pieces, old = self._own(s, e)
        lost = pieces.sums(pieces.whole == ord(LOST))
        can = self.tables.can[pieces.whole]
        for w in WIDE:
            if self.done.any():
                left = ~self.done[self._owner(s)]
                pieces, s, e, old, lost = pieces.only(left), s[left], e[left], old[left], lost[left]
                can = self.tables.can[pieces.whole]
                if not len(s):
                    return
            # euc_jp reads most sequences of three bytes as lost
            ask = lost * 5 <= e - s if w == "euc_jp" else np.ones(len(s), bool)
            has = (can & _BIT[w] > 0) | (pieces.whole == 10)
            raw = _string(np.where(has, pieces.whole, 0x1A)).encode(w).split(_BREAK.encode())
            self._utf8(w, pieces, ~has, old, s, e, raw, ask, mark=":2")
        fair = (e - s >= 4) & (lost * 5 <= e - s)
        for w in WIDE:
            has = (can & _BIT[w] > 0) | (pieces.whole == 10)
            full = pieces.sums(~has & (pieces.whole != ord(LOST))) == 0
            take = fair & (full | (lost > 0))
            if not take.any():
                continue
            some = pieces.only(take)
            own = (self.tables.can[some.whole] & _BIT[w] > 0) | (some.whole == 10)
            raw = _string(np.where(own, some.whole, 0x1A)).encode(w)
            cut = raw.split(_BREAK.encode())
            self._to_wide(w, cut, s[take], e[take], old[take])
            # chains to one-byte encodings fit any bytes, so nothing but what is lost may be missing
            narrow = full[take]
            if not narrow.any():
                continue
            b = _Parts(np.frombuffer(raw, dtype=np.uint8), np.array([len(c) for c in cut], dtype=np.int64)).only(narrow)
            at_, to_, was = s[take][narrow], e[take][narrow], old[take][narrow]
            bad = b.either(_BAD[b.whole])
            for t in TRUE_NARROW:
                good = bad & _TRUE[t] == 0
                if good.any():
                    one = b.only(good)
                    points = _CODES[t][one.whole]
                    points[one.whole == 0x1A] = ord(LOST)
                    one.whole = points
                    self._add(f"{w}>{t}", at_[good], to_[good], one, was[good])

    def _words(self) -> None:
        """Chains between one-byte encodings; they fit any word, so likelihood alone decides.

        Words with letters that the wrong encoding lacks stay as they are: only a part of the text may be damaged. Results with
        control characters or box lines are no text.
        """
        asked = np.flatnonzero((self.any_high[self.end] > self.any_high[self.begin]) & ~self.done).tolist()
        known: dict[str, int] = {}
        which, start, stop, bound = [], [], [], [0]
        for i in asked:
            for m in WORD.finditer(self.texts[i]):
                which.append(known.setdefault(m[0], len(known)))
                start.append(m.start())
                stop.append(m.end())
            bound.append(len(which))
        if not known:
            return
        words = _Parts.of(list(known))
        r = _run(self.model.point_scores(words.whole))
        old = r[words.to] - r[words.at]
        can = self.tables.can[words.whole]
        loud = self.tables.pair[words.whole] != 2
        foreign = (words.whole > 127) & loud
        lacks = words.either(np.where(foreign, ~can, np.uint32(0)))  # the encodings that have not all of a word's letters
        some_foreign = words.sums(foreign) > 0
        index, limits = np.array(which), np.array(bound)
        likely, within = [], {}
        for w, true in BY_WRONG.items():
            fits = some_foreign & (lacks & _BIT[w] == 0)
            if not fits.any():
                continue
            some = words.only(fits)
            b = self.tables.byte[w][np.minimum(some.whole, 0xFFFF)]
            b = np.where(some.whole < 128, 0, b)
            mapped = b > 0
            other, none = some.either(np.where(mapped, _OTHER[w][b], 0)), some.either(np.where(mapped, _BAD[b], 0))
            for t in true:
                points = np.where(mapped, _CODES[t][b], some.whole)
                changed = other & _TRUE[t] > 0
                if not changed.any():
                    continue
                bad = np.zeros(len(known), bool)
                bad[fits] = none & _TRUE[t] > 0
                delta = np.zeros(len(known))
                q = _run(self.model.point_scores(points))
                delta[fits] = np.where(changed, (q[some.to] - q[some.at]) - old[fits], 0.0)
                if not (delta > 0).any():
                    continue
                rises = _run(np.maximum(delta[index], 0.0))
                spoilt = _run(bad[index])
                for k in np.flatnonzero((rises[limits[1:]] - rises[limits[:-1]] > PRIOR) & (spoilt[limits[1:]] == spoilt[limits[:-1]])).tolist():
                    lo_, hi_ = bound[k], bound[k + 1]
                    gain, lo, hi = _best_stretch(delta[index[lo_:hi_]].tolist())
                    inner = index[lo_ + lo : lo_ + hi]
                    if gain <= PRIOR or (old[inner] + delta[inner]).sum() <= self.plausible * (words.to - words.at)[inner].sum():
                        continue
                    i, s, e = asked[k], start[lo_ + lo], stop[lo_ + hi - 1]
                    text = self.texts[i]
                    fixed = text[s:e].translate(_SWAP[w, t])
                    # the words were judged by themselves; the stretch is judged between its neighbours
                    before, after = text[max(0, s - 2) : s], text[e : e + 2]
                    likely.append((i, f"{w}>{t}", s, e, fixed, *[within.setdefault(before + x + after, len(within)) for x in (text[s:e], fixed)]))
        sums, _ = self.model.totals(list(within))
        for i, name, s, e, fixed, old_, new in likely:
            gain = sums[new] - sums[old_]
            if gain > PRIOR:
                self.gains[i].setdefault(name, []).append((gain - PRIOR, s, e, fixed))


def _spread(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of the stretches that start at ``at``, one after another."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(at - (ends - sizes), sizes)


def suspicions(texts: list[str]) -> list[int]:
    """Of each text 0: no chain can fit. 1: some chain between alike alphabets fits any such text. 2: certain marks of damage,
    or a multi-byte chain whose result could hardly arise by chance.
    """
    out = [2 if ASCII_FORMS.search(t) else 0 if t.isascii() else 2 if CERTAIN.search(t) else 1 for t in texts]
    ask = [i for i, v in enumerate(out) if v == 1]
    if not ask:
        return out
    some = _Parts.of([texts[i] for i in ask])
    kind = _tables().pair[some.whole]
    both = np.append((kind[:-1] == 1) & (kind[1:] > 0) | (kind[:-1] > 0) & (kind[1:] == 1), False)
    high, paired = some.sums(kind == 1) > 0, some.sums(both) > 0
    # the encodings in which a text holds the first two bytes of a UTF-8 sequence
    lead, tail = _tables().lead[some.whole], _tables().tail[some.whole]
    begins = some.either(np.append(lead[:-1] & tail[1:], np.uint16(0)))
    for j, i in enumerate(ask):
        if paired[j] and _one_byte_damage(texts[i], [w for k, w in enumerate(NARROW) if begins[j] >> k & 1 or w in ("cp1252", "mac_roman")]):
            out[i] = 2
        else:
            out[i] = _wide_damage(texts[i], 1 if high[j] else 0)
    return out


def searched(text: str) -> bool:
    """Whether suspicions gives the text more than 0."""
    if text.isascii():
        return ASCII_FORMS.search(text) is not None
    return any(rx.search(text) for rx in (PAIRS_ANY, KANA, HAN, HANGUL, HALF, CERTAIN, ASCII_FORMS))


def _one_byte_damage(text: str, encodings: list[str]) -> bool:
    seen = set()
    for w in encodings:
        for m in RUN[w].finditer(text):
            if PAIRS.search(m[0]):
                b, _ = to_bytes(m[0], w)
                if b in seen:
                    continue
                seen.add(b)
                hits = sum(map(len, UTF8_NARROW.findall(b)))
                if hits >= 4 and hits * 5 >= 3 * len(b.translate(None, _ASCII)):
                    return True
                if w in ("cp1252", "mac_roman") and _dense(m[0]):
                    return True
    return False


def _wide_damage(text: str, level: int) -> int:
    if not (HAN.search(text) or HANGUL.search(text) or KANA.search(text) or HALF.search(text)):
        return level
    for w in WIDE:
        if LEADS[w].search(text) and UTF8_HINT.search(text.encode(w, "replace")):
            return 2
    if LATIN.search(text) or not KANA.search(text):
        for w in ("gb18030", "cp932", "cp949"):
            b = text.encode(w, "replace")
            hits = sum(map(len, UTF8_NARROW.findall(b)))
            if hits >= 4 and hits * 5 >= 3 * len(b.translate(None, _ASCII)):
                return 2
    return 1


def suspicion(text: str) -> int:
    return suspicions([text])[0]


def _dense(run: str) -> bool:
    """Mostly Latin letters and signs above ASCII, of which no language writes so many."""
    high = len(run) - len(run.encode("ascii", "ignore"))
    if high < 6:
        return False
    kind = _tables().dense[_points(run)]
    return high * 5 >= 2 * int((kind & 1 == 0).sum()) and int((kind > 1).sum()) * 5 >= 4 * high


class Restorer:
    def __init__(self, model: charlm.Model, margin: float = MARGIN, plausible: float = PLAUSIBLE):
        self.model, self.margin, self.plausible = model, margin, plausible

    def best(self, texts: list[str], enough: float = math.inf) -> list[tuple[float, str, str] | None]:
        """Per text the likeliest chain: (gain, chain, text repaired), or None if nothing gains more than the margin.

        Chains that fit certain stretches and chains between one-byte encodings, which fit any word, compete by their gain.
        """
        search, out = _Search(self.model, self.plausible, texts, enough), [None] * len(texts)
        for i, gains in zip(search.open, search.gains):
            out[i] = self._take(texts[i], gains)
        return out

    def _take(self, text: str, by: dict[str, list]) -> tuple[float, str, str] | None:
        """The chain of largest gain, of equal ones that listed first, and the text with its stretches replaced."""
        gain, _, name = max(((round(float(sum(g for g, *_ in v)), 3), -k, n) for k, (n, v) in enumerate(by.items())), default=(0.0, 0, ""))
        if gain <= self.margin:
            return None
        fixed, at = [], 0
        for _, s, e, new in sorted(by[name], key=lambda x: x[1]):
            fixed += [text[at:s], new]
            at = e
        return gain, name, "".join(fixed) + text[at:]

    def restore(self, texts: list[str]) -> list[tuple[str, str, float]]:
        """(text restored, chains in the order they were undone, joined by +, total gain); no chain: nothing accepted. Each
        round gains more than the margin and no text is likelier than certain, so the rounds end by themselves.
        """
        state = [(t, "", 0.0) for t in texts]
        open_ = list(range(len(texts)))
        while open_:
            found = self.best([state[i][0] for i in open_])
            still = []
            for i, f in zip(open_, found):
                if f is not None:
                    _, names, gain = state[i]
                    state[i] = (f[2], f"{names}+{f[1]}".lstrip("+"), gain + f[0])
                    still.append(i)
            open_ = still
        return state


def _best_stretch(delta: list[float], slack: float = 3.0) -> tuple[float, int, int]:
    """The contiguous stretch of largest sum, drawn out on both sides as far as that costs less than ``slack``: single words
    are judged without their context.
    """
    best, lo, hi, run, start = 0.0, 0, 0, 0.0, 0
    for j, d in enumerate(delta):
        if run <= 0:
            run, start = 0.0, j
        run += d
        if run > best:
            best, lo, hi = run, start, j + 1
    if best <= 0:
        return best, lo, hi
    left = right = 0.0
    i, j = lo, hi
    while i > 0 and left + delta[i - 1] > -slack:
        i -= 1
        left += delta[i]
    while j < len(delta) and right + delta[j] > -slack:
        right += delta[j]
        j += 1
    return best + left + right, i, j


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task: the suspicious records (kind r), the clean records held out (kind h), and one row with the n-gram counts of
    the other clean records (kind c).
    """
    table = np.zeros(charlm.SLOTS, dtype=np.int64)
    for b in batches:
        levels = suspicions(b["text"].tolist())
        held = [v < 2 and _pick(t) % HELD == 0 for t, v in zip(b["text"], levels)]
        charlm.count([t for t, v, h in zip(b["text"], levels, held) if v < 2 and not h], table)
        yield b[held].assign(kind="h", slots=None, counts=None)
        sel = [v > 0 for v in levels]
        yield b[sel].assign(kind="r", slots=None, counts=None)
    slots = np.flatnonzero(table)
    if len(slots):
        yield pd.DataFrame({"tbl": None, "rec_id": None, "text": None, "kind": "c", "slots": [slots.astype(np.int32)], "counts": [table[slots]]})


CHUNK = 400_000  # characters searched at once


def _chunks(texts: pd.Series, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of parts of at most so many characters, or of a single text."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


SCAN = "tbl string, rec_id string, text string, kind string, slots array<int>, counts array<bigint>"


def _texts(posts: DataFrame | None, sections: DataFrame | None) -> DataFrame:
    parts = []
    if posts is not None:
        parts.append(posts.select(F.lit("posts").alias("tbl"), F.col("id").cast("string").alias("rec_id"), F.col("content").alias("text")))
    if sections is not None:
        parts.append(sections.select(F.lit("sections").alias("tbl"), F.col("line").cast("string").alias("rec_id"), "text"))
    both = parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])
    return both.filter("text is not null and text <> ''")


def _pick(text: str, salt: str = "") -> int:
    """A hash of the text, equal in all tasks."""
    return zlib.crc32((salt + text).encode("utf-8", "surrogatepass")) * 0x9E3779B1 >> 16 & 0xFFFFFF


def _families() -> dict[str, dict[str, list[str]]]:
    """Per family of chains: true encoding → the encodings it is wrongly read with."""
    one_byte: dict[str, list[str]] = {}
    for w, t in ONE_BYTE:
        one_byte.setdefault(t, []).append(w)
    return {
        "narrow>utf-8": {"utf-8": [*NARROW]},
        "narrow>utf-8 twice": {"utf-8": [*NARROW]},
        "wide>utf-8": {"utf-8": [*WIDE]},
        "narrow>wide": {t: [*NARROW] for t in TRUE_WIDE},
        "wide>wide": {t: [w for w in WIDE if w != t] for t in TRUE_WIDE},
        "wide>narrow": {t: [*WIDE] for t in TRUE_NARROW},
        "narrow>narrow": one_byte,
        "ascii": {t: ["latin-1"] for t in ("iso2022_jp", "hz", "utf-7")},
    }


FAMILIES = _families()


_TO_BYTE = {n: {**{ord(c): b for c, b in BYTE_OF[n].items() if c > "\x7f"}, **{b: b for b in range(128)}} for n in TABLES}


def _misread(line: str, true: str, wrong: str) -> str:
    raw = line.encode(true) if true not in TABLES else codecs.charmap_encode(line, "strict", _TO_BYTE[true])[0]
    return codecs.charmap_decode(raw, "strict", TABLES[wrong])[0] if wrong in TABLES else raw.decode(wrong, "replace")


def hurt(line: str) -> Iterator[tuple[str, str]]:
    """(family, line damaged): by one chain of each family that changes the line, chosen by hash among those that fit it."""
    if line.isascii():
        return
    for family, by_true in FAMILIES.items():
        names, h = list(by_true), _pick(line, family)
        for k in range(len(names)):
            true = names[(h + k) % len(names)]
            wrong = by_true[true][h // len(names) % len(by_true[true])]
            try:
                bad = _misread(line, true, wrong)
                if family.endswith("twice"):
                    bad = _misread(bad, true, wrong)
            except (UnicodeError, KeyError):
                continue
            if bad != line:
                yield family, bad
                break


def _gains(judge: Restorer, lines: list[str], steps: int = STEPS) -> list[float]:
    """What the likeliest chain gains on each line; nothing where no chain is looked for."""
    at = [i for i, x in enumerate(lines) if searched(x)]
    out = [0.0] * len(lines)
    # what gains more than the last step counts alike, so no likelier chain is looked for
    for i, f in zip(at, judge.best([lines[i] for i in at], steps * STEP + SURELY)):
        out[i] = f[0] if f is not None else 0.0
    return out


def _told_apart(counts: np.ndarray) -> float:
    """The margin from MARGIN on that makes the fewest errors, of the histograms (clean, damaged) of gains: the share of
    clean lines above it plus the share of damaged lines not above it; of equal ones the least.
    """
    clean, bad = counts
    if not clean.sum() or not bad.sum():
        return MARGIN
    low = int(MARGIN / STEP)
    above = 1 - np.cumsum(clean) / clean.sum()
    below = np.cumsum(bad) / bad.sum()
    return float((low - 1 + int(np.argmin(np.round((above + below)[low - 1 :], 9))) + 1) * STEP)


def _settled(counts: np.ndarray, steps: int) -> bool:
    """Whether _told_apart gives the same for histograms in which all gains beyond so many steps are in the last one: a larger
    margin makes at least the errors of the damaged lines that are not above the last step.
    """
    clean, bad = counts
    if not clean.sum() or not bad.sum():
        return True
    below = np.cumsum(bad) / bad.sum()
    errors = np.round(1 - np.cumsum(clean) / clean.sum() + below, 9)
    return bool(errors[int(MARGIN / STEP) - 1 : steps].min() <= np.round(below[steps - 1], 9))


def _validated_margin(held: DataFrame, shared: Broadcast) -> float:
    """The margin at which all lines of the held-out records and the same lines, damaged by a chain of every family, are told
    apart best, MARGIN at least. Gains are counted in Spark in steps of STEP; beyond NEAR steps only if that can matter.
    """
    near = _counted(held, shared, NEAR)
    return _told_apart(near if _settled(near, NEAR) else _counted(held, shared, STEPS))


def _counted(held: DataFrame, shared: Broadcast, steps: int) -> np.ndarray:
    """The histograms (clean, damaged) of gains; those beyond so many steps are all in the last one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge, out = Restorer(charlm.Model(charlm.unpack(shared.value)), 0.0), np.zeros((2, STEPS), dtype=np.int64)
        for b in batches:
            for at, to in _chunks(b["text"], CHUNK // 16):  # damaged lines are many and grow
                clean = [x for t in b["text"].iloc[at:to] for x in t.split("\n") if x.strip()]
                for k, some in enumerate((clean, [y for x in clean for _, y in hurt(x)])):
                    # a gain of just the margin is not beyond it
                    slots = np.clip(np.ceil(np.array(_gains(judge, some, steps)) / STEP).astype(np.int64) - 1, 0, STEPS - 1)
                    slots[slots >= steps] = STEPS - 1
                    out[k] += np.bincount(slots, minlength=STEPS)
        side, slot = np.nonzero(out)
        if len(side):
            yield pd.DataFrame({"side": side.astype(np.int32), "slot": slot.astype(np.int32), "n": out[side, slot]})

    table = np.zeros((2, STEPS), dtype=np.int64)
    for r in held.select("text").mapInPandas(run, "side int, slot int, n bigint").groupBy("side", "slot").agg(F.sum("n").alias("n")).collect():
        table[r["side"], r["slot"]] = r["n"]
    return table


def _fitted(posts: DataFrame | None, sections: DataFrame | None) -> tuple[DataFrame, Broadcast, float]:
    """The suspicious records, the model of the clean ones and the margin."""
    rows = _texts(posts, sections)
    spark = rows.sparkSession
    scanned = materialize(rows.mapInPandas(_scan, SCAN), "scan")
    counts = scanned.filter("kind = 'c'").select(F.explode(F.arrays_zip("slots", "counts")).alias("z")).groupBy(F.col("z.slots").alias("slot")).agg(F.sum("z.counts").alias("n"))
    got = counts.toPandas()  # at most charlm.SLOTS rows
    table = np.zeros(charlm.SLOTS, dtype=np.int64)
    table[got["slot"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    shared = spark.sparkContext.broadcast(charlm.pack(table))
    margin = _validated_margin(scanned.filter("kind = 'h'"), shared)
    return scanned.filter("kind = 'r'").select("tbl", "rec_id", "text"), shared, margin


def cases(posts: DataFrame | None, sections: DataFrame | None) -> DataFrame:
    """(tbl, rec_id) of the records of restore, without restoring them: one that holds U+FFFD is a case whatever its chain, and
    others are as soon as some chain gains more than the margin.
    """
    suspicious, shared, margin = _fitted(posts, sections)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Restorer(charlm.Model(charlm.unpack(shared.value)), margin)
        for b in batches:
            lost = np.array([LOST in t for t in b["text"]], dtype=bool)
            yield b.loc[lost, ["tbl", "rec_id"]]
            b = b[~lost]
            for at, to in _chunks(b["text"], CHUNK):
                part = b.iloc[at:to]
                found = judge.best(part["text"].tolist(), margin + SURELY)
                yield part.loc[np.array([f is not None for f in found], dtype=bool), ["tbl", "rec_id"]]

    return suspicious.mapInPandas(run, "tbl string, rec_id string").distinct()


def restore(posts: DataFrame | None, sections: DataFrame | None) -> DataFrame:
    """(tbl, rec_id, text, restored, chain, gain) of each record with wrongly decoded characters; distinct.

    ``restored`` is the text with every damaged stretch undone that a chain explains; bytes that are gone stay U+FFFD.
    A record that holds U+FFFD but fits no chain has the chain ``lost`` and ``restored`` as it was. Null and empty texts
    are never cases. Records are scored whole, whatever their length. An empty input gives an empty result.
    """
    suspicious, shared, margin = _fitted(posts, sections)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Restorer(charlm.Model(charlm.unpack(shared.value)), margin)
        for b in batches:
            for at, to in _chunks(b["text"], CHUNK):
                part = b.iloc[at:to]
                done = judge.restore(part["text"].tolist())
                new = part.assign(restored=[x[0] for x in done], chain=[x[1] or ("lost" if LOST in t else "") for x, t in zip(done, part["text"])], gain=[x[2] for x in done])
                yield new[new["chain"] != ""]

    return suspicious.mapInPandas(run, "tbl string, rec_id string, text string, restored string, chain string, gain double").distinct()
