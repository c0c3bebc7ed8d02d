"""Garbled text from wrong character encoding.

Method: join garbled records with clean near-twins on text stripped of
non-ASCII characters, infer transformations by character alignment, and apply
learned mappings to remaining records.

Three passes over all paragraphs. The first counts code points over distinct texts. The second
picks garbled and clean paragraphs with the same ASCII skeleton, aligns the
stretches between the ASCII characters and votes for the transformations
(right encoding, wrong encoding) that turn the clean stretch into the garbled
one. The third undoes transformations wherever that makes a stretch of text
much likelier under the counted characters; one that twins have voted for needs
less evidence than one nothing is known of. A replacement character left by
decoding marks a paragraph as garbled and as not restorable.
"""

from __future__ import annotations

import re
from codecs import charmap_decode
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkwell.functions.arrow import arrow_schema, as_batch, map_rows
from inkwell.llm.points import TOP, points_of
from inkwell.session import cut

#: Encodings that texts are written in, and encodings they are wrongly read as.
RIGHT = ("utf-8", "gb18030", "big5", "cp1252")
WRONG_BYTES = ("cp1252", "mac-roman", "cp1251", "koi8-r", "cp437", "cp850", "cp866", "latin-1", "cp1250", "iso8859-15")
WRONG_WIDE = ("gb18030", "big5", "cp949", "cp932", "euc-jp")
#: Least gain in log likelihood, with votes of twins and without.
GAIN_KNOWN, GAIN_NEW = 6.0, 14.0
#: Least gain of a stretch of two characters of a two-byte encoding.
GAIN_SHORT = 10.0
#: Least mean log likelihood of restored characters.
PLAUSIBLE = -10.0
LOST = "�"

_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2})+")
#: In Chinese text misread as another two-byte encoding at least two letters in a row survive.
_UTF8_RUN = re.compile(rb"(?:[\xe2-\xef][\x80-\xbf]{2}){2}")
_DOUBLE = re.compile(rb"(?:[\x81-\xfe][\x40-\x7e\x80-\xfe])+")


@lru_cache(maxsize=None)
def _byte_table(codec: str) -> tuple[dict[int, int], list[str]]:
    """char -> byte and byte -> char of a one-byte encoding; bytes it leaves open stand for themselves."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            chars.append(chr(b))
    back = {ord(c): b for b, c in reversed(list(enumerate(chars))) if b >= 128}
    return back, chars


def misread(text: str, right: str, wrong: str) -> str | None:
    """What text written in `right` looks like when read as `wrong`; None if that is impossible."""
    try:
        return _misread_bytes(text.encode(right), wrong)
    except UnicodeEncodeError:
        return None


def _misread_bytes(data: bytes, wrong: str) -> str | None:
    if wrong in WRONG_BYTES:
        return charmap_decode(data, "strict", _byte_string(wrong))[0]
    try:
        return data.decode(wrong)
    except UnicodeDecodeError:
        return None


@lru_cache(maxsize=None)
def _byte_string(codec: str) -> str:
    return "".join(_byte_table(codec)[1])


class _Back(dict):
    """Code point -> the byte that a one-byte encoding reads as it, as a code point; 0 for what it cannot have produced."""

    def __init__(self, codec: str) -> None:
        super().__init__(_byte_table(codec)[0])

    def __missing__(self, c: int) -> int:
        self[c] = c if c < 128 else 0
        return self[c]


_back = lru_cache(maxsize=None)(_Back)


TRANSFORMS = [(r, w) for r in RIGHT for w in (*WRONG_BYTES, *WRONG_WIDE) if r != w and not (r == "cp1252" and w not in ("mac-roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866"))]


@dataclass
class Model:
    """What restoring needs: log likelihood by code point, and votes by transformation.

    logp is counted over distinct texts, of which one that stands n times weighs as much as log2(n)
    others more, so that a garbled line repeated often does not make its own characters likely.
    usual also knows every repeat (logp if left out): what is restored to the words of a clean
    line repeated often is plausible."""

    logp: np.ndarray
    votes: dict[tuple[str, str], int] = field(default_factory=dict)
    usual: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.usual = self.logp if self.usual is None else np.maximum(self.usual, self.logp)
        self.tables: dict[tuple[str, str], np.ndarray] = {}
        self.summed: tuple[str | None, np.ndarray] = (None, np.zeros(1))

    def __getstate__(self) -> dict:
        at = np.flatnonzero((self.logp > self.logp.min()) | (self.usual > self.usual.min()))
        low = float(self.logp.min()), float(self.usual.min())
        return {"at": at.astype(np.int32), "p": self.logp[at].astype(np.float32), "u": self.usual[at].astype(np.float32), "low": low, "votes": self.votes}

    def __setstate__(self, s: dict) -> None:
        self.logp, self.usual = (np.full(TOP, low, dtype=np.float32) for low in s["low"])
        self.logp[s["at"]], self.usual[s["at"]] = s["p"], s["u"]
        self.votes, self.tables, self.summed = s["votes"], {}, (None, np.zeros(1))

    def gains(self, right: str, wrong: str) -> np.ndarray:
        if (right, wrong) not in self.tables:
            self.tables[right, wrong] = _gains(self.logp, right, wrong)
        return self.tables[right, wrong]

    def learned(self, undone: str) -> bool:
        """Whether twins have shown all that restore() says it has undone."""
        return undone == "characters lost" or set(undone.split(", ")) - {"characters lost"} <= {f"{r} read as {w}" for r, w in self.votes}

    def score(self, text: str) -> float:
        return float(self.logp[_points(text)].sum())

    def part(self, text: str, start: int, stop: int) -> float:
        """The score of text[start:stop]; sums of the text last asked for are kept."""
        if self.summed[0] is not text:
            self.summed = (text, np.concatenate(([0.0], np.cumsum(self.logp[_points(text)], dtype=np.float64))))
        return float(self.summed[1][stop] - self.summed[1][start])

    def plausible(self, text: str) -> bool:
        return float(self.usual[_points(text)].sum()) / len(text) >= PLAUSIBLE


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def likelihoods(counts: np.ndarray) -> np.ndarray:
    total = max(1, int(counts.sum()))
    return np.log((counts + 0.5) / (total + 0.5 * 30_000)).astype(np.float32)


def _foreign() -> np.ndarray:
    """Code points outside ASCII, ideographs and the punctuation of Chinese and English print."""
    f = np.ones(TOP, dtype=bool)
    f[:0x80] = False
    f[0x2010:0x2030] = False
    f[0x3000:0x3030] = False
    f[0x4E00:0xA000] = False
    f[0xFF01:0xFF5F] = False
    for c in (0xA0, 0xAD, 0xB7, 0xFEFF, 0x2060):
        f[c] = False
    f[0x200B:0x2010] = False
    f[0x2F00:0x2FE0] = False
    f[0x1F000:0x1FB00] = False
    f[0xFB00:0xFB07] = False
    f[0xF900:0xFB00] = False
    return f


FOREIGN = _foreign()
#: Transformations between two-byte encodings, and of UTF-8 into one; what they leave need not hold a foreign code point.
WIDE = [t for t in TRANSFORMS if t[0] != "utf-8" and t[1] in WRONG_WIDE]
UTF8_WIDE = [("utf-8", w) for w in WRONG_WIDE]
ONE_BYTE = [t for t in TRANSFORMS if t[1] in WRONG_BYTES]
#: Least gain of a restored stretch; see _undo_wide.
_LEAST_STRETCH = 4.5


@lru_cache(maxsize=None)
def _unread(right: str, wrong: str) -> np.ndarray:
    """By code point below 0x10000 what it was before a misreading between two-byte encodings: itself for ASCII, -1 if there is none."""
    out = np.full(0x10001, -1, dtype=np.int32)
    out[:0x80] = np.arange(0x80)
    for c in range(0x80, 0x10000):
        if (x := _wide.__wrapped__(chr(c), right, wrong)) is not None:
            out[c] = ord(x)
    return out


@lru_cache(maxsize=None)
def _utf8_roles(wrong: str) -> np.ndarray:
    """By code point below 0x10000 which two bytes of UTF-8 it can stand for: 1 lead and trail, 2 trail and lead, 4 two trails, 8 any and lead, 16 trail and any."""
    out = np.zeros(0x10001, dtype=np.uint8)
    lead, trail = lambda b: 0xE2 <= b <= 0xEF, lambda b: 0x80 <= b <= 0xBF
    for c in range(0x80, 0x10000):
        try:
            b = chr(c).encode(wrong)
        except UnicodeEncodeError:
            continue
        first, last, two = b[0], b[-1], len(b) == 2
        out[c] = (two and lead(first) and trail(last)) | (two and trail(first) and lead(last)) << 1 | (two and trail(first) and trail(last)) << 2 | lead(last) << 3 | trail(first) << 4
    return out


def _gains(logp: np.ndarray, right: str, wrong: str) -> np.ndarray:
    """By code point below 0x10000 the gain of undoing it, as in _undo_wide."""
    back = _unread(right, wrong)
    own = np.append(logp[:0x10000], np.float32(0))
    return np.where(back < 0, np.float32(-4), np.where(back == np.arange(0x10001), np.float32(0), logp[np.maximum(back, 0)] - own)).astype(np.float32)


def candidates(p, model: Model) -> tuple[np.ndarray, list[tuple[str, str]]]:
    """Bits by text: 1 anything to look at, 2 a foreign code point, 4 and up the transformations of the list.

    A transformation is left out only where undo() can find nothing of it: a misreading by a
    one-byte encoding leaves a foreign code point; one of UTF-8 by a two-byte encoding leaves the
    bytes of two characters in a row; one between two-byte encodings needs a stretch of a gain."""
    listed = [*UTF8_WIDE, *WIDE]
    n = len(p.starts) - 1
    bits = np.zeros(n, dtype=np.int64)
    if not len(p.points):
        return bits, listed
    bits |= (p.counts(p.points == ord(LOST)) > 0) | (p.counts(FOREIGN[p.points]) > 0) * 3
    wide = np.flatnonzero(p.points > 0x7F)
    ends = np.searchsorted(wide, p.starts)  # text k's characters outside ASCII are wide[ends[k] : ends[k + 1]]
    at = np.minimum(p.points[wide], 0x10000)
    for k, (right, wrong) in enumerate(listed):
        if right == "utf-8":
            r = np.concatenate((np.zeros(2, dtype=np.uint8), _utf8_roles(wrong)[at], np.zeros(2, dtype=np.uint8)))
            first = np.flatnonzero(r & 1)
            run = (r[first + 1] & 2 > 0) & (r[np.minimum(first + 2, len(r) - 1)] & 4 > 0)
            run |= (r[first - 2] & 8 > 0) & (r[first - 1] & 4 > 0) & (r[first + 1] & 16 > 0)
            found = np.zeros(n, dtype=bool)
            found[np.searchsorted(ends, first[run] - 2, "right") - 1] = True
        else:
            found = _has_stretch(model.gains(right, wrong)[at], ends, GAIN_KNOWN)
        bits |= found * (1 | 4 << k)
    return bits, listed


def _has_stretch(g: np.ndarray, ends: np.ndarray, need: float) -> np.ndarray:
    """Which texts hold a stretch that gains _LEAST_STRETCH, and gains of `need` in all."""
    up = np.flatnonzero(g > 0)
    out = np.zeros(len(ends) - 1, dtype=bool)
    total = np.bincount(np.searchsorted(ends, up, "right") - 1, weights=g[up], minlength=len(out))
    for k in np.flatnonzero(total >= need):
        part = np.concatenate(([0.0], np.cumsum(g[ends[k] : ends[k + 1]], dtype=np.float64)))
        out[k] = (part - np.minimum.accumulate(part)).max() >= _LEAST_STRETCH
    return out


def suspects(p, model: Model) -> Iterator[tuple[int, set[tuple[str, str]]]]:
    """The texts that can be garbled, and the transformations to try on each."""
    bits, listed = candidates(p, model)
    for k in np.flatnonzero(bits):
        b = int(bits[k])
        yield int(k), {t for j, t in enumerate(listed) if b >> 2 + j & 1} | (set(ONE_BYTE) if b & 2 else set())


# ---- undoing ---------------------------------------------------------------------


def _to_bytes(text: str, wrong: str) -> tuple[bytes, Sequence[int]]:
    """The bytes that `wrong` was given, with 0x00 for what it cannot have produced, and the text position of each byte."""
    if wrong in WRONG_BYTES:
        return text.translate(_back(wrong)).encode("latin-1"), range(len(text))
    out, at = bytearray(), []
    for i, c in enumerate(text):
        try:
            b = c.encode(wrong)
        except UnicodeEncodeError:
            b = b"\0"
        out += b
        at += [i] * len(b)
    return bytes(out), at


@lru_cache(maxsize=None)
def _trace(right: str, wrong: str) -> re.Pattern:
    """What a misreading by a one-byte encoding always leaves; texts without it are passed over."""
    chars = _byte_table(wrong)[1]
    some = lambda a, z: "[" + "".join(re.escape(chars[b]) for b in range(a, z + 1)) + "]"
    if right == "utf-8":
        return re.compile(some(0xC2, 0xF4) + some(0x80, 0xBF))
    high = some(0x81, 0xFE)
    return re.compile(high + high)


def _deeper(plain: str, wrong: str) -> str:
    """Text misread several times over comes back in one go; every step leaves fewer characters, so there is a last one."""
    while True:
        data, _at = _to_bytes(plain, wrong)
        if not _UTF8.search(data) or any(c == 0 for c in data):
            return plain
        try:
            plain = data.decode("utf-8")
        except UnicodeDecodeError:
            return plain


def undo(text: str, right: str, wrong: str, model: Model, known: bool = False) -> list[tuple[int, int, str, float, bool]]:
    """Stretches [start, stop) of text that were written in `right` and read as `wrong`: restored form, gain, and whether it is plausible by itself.

    Of two-byte encodings shorter stretches are plausible if twins have voted for the transformation (known)."""
    if right == "cp1252":
        return _undo_marks(text, wrong, model)
    if wrong in WRONG_WIDE and right != "utf-8":
        return _undo_wide(text, right, wrong, model, 2 if known else 3)
    if wrong in WRONG_BYTES:
        if not _trace(right, wrong).search(text):
            return []
    elif not _UTF8_RUN.search(text.encode(wrong, "replace")):
        return []
    data, at = _to_bytes(text, wrong)
    out = []
    pattern = _UTF8 if right == "utf-8" else _DOUBLE
    for m in pattern.finditer(data):
        a, b = m.span()
        if wrong in WRONG_WIDE:  # begin and end between characters
            while a < b and a > 0 and at[a - 1] == at[a]:
                a += 3
            while b > a and b < len(at) and at[b - 1] == at[b]:
                b -= 3
            if b <= a:
                continue
        try:
            plain = data[a:b].decode(right)
        except UnicodeDecodeError as e:
            if right == "utf-8" or e.start == 0:
                continue
            b = a + e.start
            plain = data[a:b].decode(right)
        start, stop = at[a], at[b - 1] + 1
        if right == "utf-8" and wrong in WRONG_BYTES:
            plain = _deeper(plain, wrong)
        if not plain or plain.isascii():
            continue
        if LOST in plain:
            out.append((start, stop, plain, 1e3, True))
            continue
        gain = model.score(plain) - model.part(text, start, stop)
        out.append((start, stop, plain, gain, gain > 0 and (len(plain) >= (1 if known else 3) or right == "utf-8") and model.plausible(plain)))
    return out


@lru_cache(maxsize=200_000)
def _wide(c: str, right: str, wrong: str) -> str | None:
    try:
        x = c.encode(wrong).decode(right)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None
    return x if len(x) == 1 else None


def _undo_wide(text: str, right: str, wrong: str, model: Model, least: int) -> list[tuple[int, int, str, float, bool]]:
    """Both encodings use two bytes a character: the stretch with the greatest gain, again and again."""
    mapped = [_wide(c, right, wrong) if ord(c) > 127 else c for c in text]
    lp = model.logp
    gains = [-4.0 if m is None else 0.0 if m == c else float(lp[ord(m)] - lp[ord(c)]) for c, m in zip(text, mapped)]
    out, i, n = [], 0, len(text)
    while i < n:
        best, total, start, stop, j = 0.0, 0.0, i, i, i
        while j < n and total >= 0 and not (total < best - 14):
            total += gains[j]
            j += 1
            if total > best:
                best, stop = total, j
        if best > 0 and stop > start:
            piece = "".join(m or c for c, m in zip(text[start:stop], mapped[start:stop]))
            changed = [k for k in range(start, stop) if mapped[k] not in (None, text[k])]
            enough = len(changed) >= 3 or len(changed) >= least and best >= GAIN_SHORT and not any("\uf900" <= text[k] <= "\ufaff" for k in changed)  # those are look-alikes
            if enough and best >= 1.5 * len(changed) and model.plausible("".join(mapped[k] for k in changed)):
                out.append((start, stop, piece, best, True))
            i = stop
        else:
            i = j
    return out


# Marks of print that the Windows encoding has and older ones have not.
_MARKS = "‘’“”–—…•€™"


def _undo_marks(text: str, wrong: str, model: Model) -> list[tuple[int, int, str, float, bool]]:
    """English text read as another one-byte encoding: only marks of print are outside ASCII.

    All foreign characters of the text must turn into such marks or accented letters: one mark
    at least, or every one a capital behind a small letter that turns into a small one."""
    back, _ = _byte_table(wrong)
    spots, marks, capitals = [], 0, 0
    for i, c in enumerate(text):
        if ord(c) < 128:
            continue
        b = back.get(ord(c))
        if b is None:
            return []
        try:
            m = bytes([b]).decode("cp1252")
        except UnicodeDecodeError:
            return []
        marks += m in _MARKS and m != c
        capitals += c.isupper() and m.islower() and text[i - 1 : i].islower()
        if m not in _MARKS and not m.isalpha():
            return []
        spots.append((i, i + 1, m, float(model.logp[ord(m)] - model.logp[ord(c)]), True))
    return spots if (marks or capitals and capitals == len(spots)) and sum(s[3] for s in spots) > 0 else []


def restore(text: str, model: Model, among: set[tuple[str, str]] | None = None) -> tuple[str | None, str] | None:
    """None if the text is not garbled; else (restored text or None where something was lost, what was undone).

    among: the only transformations that can be found, if that is known."""
    if LOST in text:
        return None, "characters lost"
    best: tuple[float, str, str] | None = None
    for right, wrong in _ordered(model):
        if among is not None and (right, wrong) not in among:
            continue
        known = model.votes.get((right, wrong), 0) > 0
        spans = undo(text, right, wrong, model, known)
        if not spans:
            continue
        need = (2.0 if known else 4.0) if right == "cp1252" else GAIN_KNOWN if known or right == "utf-8" and wrong in WRONG_BYTES else GAIN_NEW
        gain = sum(s[3] for s in spans if s[4] and s[3] > 0)
        if gain < need or best is not None and gain <= best[0]:
            continue
        out, last = [], 0
        for a, b, plain, g, _ in spans:
            if g > 0 or right == "cp1252":
                out += [text[last:a], plain]
                last = b
        best = (gain, "".join(out) + text[last:], f"{right} read as {wrong}")
    if best is None:
        return None
    _, fixed, what = best
    if LOST in fixed:
        return None, what
    again = restore(fixed, model) if fixed != text else None
    return (again[0], f"{what}, {again[1]}") if again is not None else (fixed, what)


def _ordered(model: Model) -> list[tuple[str, str]]:
    return sorted(TRANSFORMS, key=lambda t: -model.votes.get(t, 0))


# ---- learning ---------------------------------------------------------------------


class _Skeletons:
    """(skeleton, text, garbled) of paragraphs that can have a twin: ASCII only, digit runs as one mark."""

    def __init__(self, model: Model) -> None:
        self.model, self.schema = model, arrow_schema("skeleton string, text string, odd boolean")

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip, digits = re.compile("[^!-~]+"), re.compile("[0-9]+")
        for b in batches:
            p = points_of(b.column(0))
            enough = p.counts((p.points > 32) & (p.points < 127)) >= 4
            some = p.counts(p.points > 127) > 0
            texts = p.texts.take(pa.array(np.flatnonzero(enough & some)))
            odd = candidates(points_of(texts), self.model)[0] > 0
            rows = [(digits.sub("0", strip.sub("", t)), t, bool(o)) for t, o in zip(texts.to_pylist(), odd)]
            for lo in range(0, len(rows), 20_000):
                yield as_batch(rows[lo : lo + 20_000], self.schema, 3)


_ASCII = re.compile("[\x00-\x7f]+")


def _stretches(cols: dict[str, list]) -> Iterator[tuple]:
    """What stands between the ASCII characters of a text, with how many there are and at which place."""
    for key, text in zip(cols["key"], cols["text"]):
        parts = _ASCII.split(text)
        for at, x in enumerate(parts):
            if x:
                yield key, len(parts), at, x


def _misread_forms(cols: dict[str, list]) -> Iterator[tuple]:
    """A clean stretch as every transformation would leave it, hashed with its place, where a garbled stretch of that length stands."""
    for key, size, at, x, lengths in zip(*(cols[c] for c in ("key", "size", "at", "x", "lengths"))):
        if len(x) <= 2:
            forms = _short_forms(x)
        else:
            forms = _forms(x, lengths)
        for k, g in forms:
            if len(g) in lengths:
                yield _place(key, size, at, g), k


_NUMBERED = {r: [(k, w) for k, (of, w) in enumerate(TRANSFORMS) if of == r] for r in RIGHT}


def _forms(x: str, lengths: list[int] | None) -> Iterator[tuple[int, str]]:
    """(transformation, misread form) of a stretch, of the lengths asked for."""
    for right, listed in _NUMBERED.items():
        try:
            data = x.encode(right)
        except UnicodeEncodeError:
            continue
        n = len(data)  # a character takes one byte, or up to four of an encoding of several
        one, wide = lengths is None or n in lengths, lengths is None or any(m <= n <= 4 * m for m in lengths)
        for k, wrong in listed:
            if (one if wrong in WRONG_BYTES else wide) and (g := _misread_bytes(data, wrong)) is not None and g != x:
                yield k, g


@lru_cache(maxsize=50_000)
def _short_forms(x: str) -> list[tuple[int, str]]:
    return list(_forms(x, None))


def _place(*parts: object) -> int:
    return int.from_bytes(blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _places(cols: dict[str, list]) -> Iterator[tuple]:
    for parts in zip(*(cols[c] for c in ("key", "size", "at", "x"))):
        yield (_place(*parts),)


class _Weighed:
    """Counts of code points over distinct texts, with their weights, and over all: the texts come with how often they stand."""

    def __init__(self) -> None:
        self.schema = arrow_schema("point int, once long, n long")

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, total = np.zeros(TOP, dtype=np.int64), np.zeros(TOP, dtype=np.int64)
        for b in batches:
            p, n = points_of(b.column(0)), b.column(1).to_numpy()
            if len(p.points):
                single = np.bincount(p.points, minlength=TOP)
                once += single
                total += single
                for k in np.flatnonzero(n > 1):
                    own = p.points[p.starts[k] : p.starts[k + 1]]
                    np.add.at(once, own, int(n[k]).bit_length() - 1)
                    np.add.at(total, own, n[k] - 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(once[at], pa.int64()), pa.array(total[at], pa.int64())], schema=self.schema)


def counted(df: DataFrame, list_col: str) -> Model:
    """The likelihoods of list_col's texts: weighed, and over all."""
    each = df.select(F.explode(list_col).alias("p")).where("p is not null").groupBy("p").agg(F.count("*").alias("n"))
    rows = each.mapInArrow(_Weighed(), "point int, once long, n long").groupBy("point").agg(F.sum("once").alias("once"), F.sum("n").alias("n"))
    once, total = np.zeros(TOP, dtype=np.int64), np.zeros(TOP, dtype=np.int64)
    for r in rows.toLocalIterator():
        once[r["point"]], total[r["point"]] = r["once"], r["n"]
    return Model(likelihoods(once), usual=likelihoods(total))


def learn(df: DataFrame, list_col: str = "paragraphs") -> Model:
    """The model of the paragraphs in list_col.

    A garbled text is aligned with all clean texts of its skeleton: a stretch of
    it meets the misread forms of the stretches that clean ones have at its place.
    Votes, counted by stretch, are evidence for a transformation and need no more.
    What reaches the driver: counts by code point, and votes by transformation."""
    model = counted(df, list_col)
    ddl = "skeleton string, text string, odd boolean"
    each = df.select(F.col(list_col).alias("p")).mapInArrow(_Skeletons(model), ddl).withColumn("key", F.xxhash64("skeleton"))
    each = cut(each.select("key", "text", "odd"))
    garbled = cut(each.where("odd").select("key", "text").distinct())
    keys = cut(garbled.select("key").distinct())
    clean = each.where("not odd").join(keys, "key", "left_semi")
    ddl = "key long, size int, at int, x string"
    spread = cut(map_rows(garbled, _stretches, ddl))
    lengths = spread.groupBy("key", "size", "at").agg(F.collect_set(F.length("x")).alias("lengths"))
    forms = map_rows(map_rows(clean, _stretches, ddl).distinct().join(lengths, ["key", "size", "at"]), _misread_forms, "place long, t int")
    votes = map_rows(spread, _places, "place long").join(forms, "place").groupBy("t").agg(F.count("*").alias("n"))
    return Model(model.logp, {TRANSFORMS[r["t"]]: r["n"] for r in votes.collect()}, model.usual)


class _Find:
    def __init__(self, model: Model, ddl: str) -> None:
        self.model, self.schema = model, arrow_schema(ddl)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            p = points_of(b.column(1))
            rows = []
            for k, among in suspects(p, self.model):
                text = p.texts[k].as_py()
                if (r := restore(text, self.model, among)) is not None:
                    rows.append((ids[p.row[k]], int(p.no[k]), text, *r, self.model.learned(r[1])))
            yield as_batch(rows, self.schema, 6)


def garbled_paragraphs(df: DataFrame, id_col: str = "chapter_id", list_col: str = "paragraphs", model: Model | None = None) -> DataFrame:
    """(id, para_no, text, restored, undone, learned) of every paragraph decoded wrongly, wholly or in part.

    restored is null where characters were lost. learned: twins have shown every
    transformation undone; else the likelihood alone speaks for one. Null lists
    and paragraphs are left out."""
    model = model or learn(df, list_col)
    ddl = "id long, para_no int, text string, restored string, undone string, learned boolean"
    return df.select(F.col(id_col).alias("id"), F.col(list_col).alias("p")).mapInArrow(_Find(model, ddl), ddl)
