"""Sentence alignment in bilingual documents.

Method: represent sentences by similarities to shared paired-document concepts;
perform sparse cosine joins in SQL, then select mutual best spans including
merged windows.

A concept is an entry with both sides. Every term is a vector over concepts
(where it occurs, centred), and a join of both sides' postings on the concept
gives the cosine of every pair of terms that ever meet; pairs below LEAST are
dropped. All distinct entries are concepts, and all entries are aligned. A
sentence pair's score is how much of the weight of each
sentence the other's terms explain by their best cosine. The best pair is
taken, what it explains is used up on both sides, and the rest is scored again:
so an element that holds several sentences finds all its partners, wherever
they stand, and one without counterpart finds none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkwell.functions.arrow import arrow_schema, as_batch, map_rows
from inkwell.functions.textform import consistent
from inkwell.session import cut

#: Least cosine of two terms.
LEAST = 0.15
#: A term in fewer concepts has no vector; one in more than this share tells nothing.
MIN_CONCEPTS, MAX_SHARE = 3, 0.85
#: Least score of a pair, weight of the better explained side, and the cosine from which a term counts as used up.
SCORE, BETTER, USED = 0.30, 0.75, 0.3

# Number words.
_ONES = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
_TENS = {w: 10 * (i + 2) for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split())}
_HAN_DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"两": 2, "〇": 0}

_WORDS = re.compile(r"[^\W\d_]+(?:['’][a-z]+)?|\d+")
_HAN_RUN = re.compile("[㐀-鿿]+|[A-Za-z]+|\\d+")
_HAN_NUMBER = re.compile("[零〇一二两三四五六七八九十百千]{1,9}")


def english_terms(text: str) -> list[str]:
    """Lower-case words; numbers, spelled out or not, as #n."""
    words = _WORDS.findall(consistent(text).lower())
    out, k = [], 0
    while k < len(words):
        w = words[k]
        if w.isdigit():
            out.append("#" + str(int(w)))
        elif w in _TENS:
            unit = _ONES.get(words[k + 1], 0) if k + 1 < len(words) else 0
            if 0 < unit < 10:
                k += 1
            out.append(f"#{_TENS[w] + (unit if unit < 10 else 0)}")
        elif w in _ONES and _ONES[w] > 1:
            out.append(f"#{_ONES[w]}")
        else:
            out.append(w)
        k += 1
    return out


def _han_value(s: str) -> int | None:
    total, digit = 0, None
    for c in s:
        if c in _HAN_DIGITS:
            digit = _HAN_DIGITS[c]
        else:
            total += (1 if digit is None else digit) * {"十": 10, "百": 100, "千": 1000}[c]
            digit = None
    return total + (digit or 0) if total or digit is not None and len(s) == 1 else None


def chinese_terms(text: str) -> list[str]:
    """Han characters and pairs of them; numbers as #n; Latin words in lower case."""
    text = consistent(text)
    out = [f"#{v}" for m in _HAN_NUMBER.finditer(text) if (v := _han_value(m.group())) is not None and v > 1]
    for run in _HAN_RUN.findall(text):
        if run[0].isdigit():
            out.append("#" + str(int(run)))
        elif run.isascii():
            out.append(run.lower())
        else:
            out += [*run, *map("".join, zip(run, run[1:]))]
    return out


def _terms(cols: dict[str, list]) -> Iterator[tuple]:
    for e, source, zh in zip(cols["entry"], cols["source"], cols["zh"]):
        for side, sentences, terms in (("s", source, english_terms), ("z", zh, chinese_terms)):
            for t in sorted({t for s in sentences or [] if s for t in terms(s)}):
                yield e, side, t


class _Frequencies:
    """In how many entries each known term occurs."""

    def __init__(self, known: set[str]) -> None:
        self.known, self.schema = known, arrow_schema("term string, n long")

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            cols = b.to_pydict()
            for source, zh in zip(cols["source"], cols["zh"]):
                n["all"] += 1
                n.update("s" + t for t in {t for s in source or [] if s for t in english_terms(s)} if "s" + t in self.known)
                n.update("z" + t for t in {t for s in zh or [] if s for t in chinese_terms(s)} if "z" + t in self.known)
        yield as_batch(list(n.items()), self.schema, 2)


class Lexicon:
    """Cosines of terms across the languages, and the weights of terms.

    pairs: term, partner and cosine as arrays. Kept by English term, as runs of numbered partners."""

    def __init__(self, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], weights: dict[str, float]) -> None:
        self.weights = weights
        self.chinese = {t[1:]: k for k, t in enumerate(sorted(x for x in weights if x[0] == "z"))}
        s, z, c = pairs
        order = np.argsort(s, kind="stable")
        s, z, c = s[order], z[order], c[order]
        begins = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, dtype=np.int64)
        self.runs = {str(s[a]): (int(a), int(e)) for a, e in zip(begins, [*begins[1:], len(s)])}
        self.partners = np.array([self.chinese.get(t, -1) for t in z], dtype=np.int32)
        self.cosines = c.astype(np.float32)

    def _known(self, elements: list[str | None], side: str, terms: Callable[[str], list[str]]) -> tuple[list[int], list[list[str]]]:
        """The elements that have known terms, and these."""
        found = [(k, x) for k, e in enumerate(elements) if e and (x := sorted({t for t in terms(e) if side + t in self.weights}))]
        return [k for k, _ in found], [x for _, x in found]

    def align(self, source: list[str | None], zh: list[str | None], least: float = SCORE) -> list[tuple[int, int, float]]:
        """(source_no, zh_no, score) of the elements that translate each other or a part of each other."""
        no_s, s = self._known(source, "s", english_terms)
        no_z, z = self._known(zh, "z", chinese_terms)
        if not s or not z:
            return []
        flat_s, flat_z = [t for x in s for t in x], [t for x in z for t in x]
        at_s, at_z = (np.cumsum([0, *map(len, x)]) for x in (s, z))
        ws, wz = np.array([self.weights["s" + t] for t in flat_s]), np.array([self.weights["z" + t] for t in flat_z])
        m = self._cosines(flat_s, flat_z)
        from_s, from_z = at_s[:-1], at_z[:-1]
        sum_s, sum_z = np.add.reduceat(ws, from_s), np.add.reduceat(wz, from_z)

        def score(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            return (BETTER * np.maximum(p, q) + (1 - BETTER) * np.minimum(p, q)).round(6)  # rounded, so that equal elements tie

        def one(i: int, j: int) -> float:
            rows, columns = slice(at_s[i], at_s[i + 1]), slice(at_z[j], at_z[j + 1])
            block = m[rows, columns]
            return float(score(np.dot(block.max(axis=1), ws[rows]) / sum_s[i], np.dot(block.max(axis=0), wz[columns]) / sum_z[j]))

        p = np.add.reduceat(np.maximum.reduceat(m, from_z, axis=1) * ws[:, None], from_s, axis=0) / sum_s[:, None]
        q = np.add.reduceat(np.maximum.reduceat(m, from_s, axis=0) * wz, from_z, axis=1) / sum_z
        scores = score(p, q)
        out = []
        while True:
            i, j = divmod(int(scores.argmax()), len(z))
            if scores[i, j] < least:
                return out
            out.append((no_s[i], no_z[j], float(scores[i, j])))
            rows, columns = slice(at_s[i], at_s[i + 1]), slice(at_z[j], at_z[j + 1])
            used_s, used_z = m[rows, columns].max(axis=1) >= USED, m[rows, columns].max(axis=0) >= USED
            m[rows][used_s] = 0
            m[:, columns][:, used_z] = 0
            scores[i, j] = -1
            for k in np.flatnonzero(scores[i] >= least):
                scores[i, k] = one(i, k)
            for k in np.flatnonzero(scores[:, j] >= least):
                scores[k, j] = one(k, j)

    def _cosines(self, flat_s: list[str], flat_z: list[str]) -> np.ndarray:
        """The cosines of two lists of terms, which may repeat."""
        distinct = {t: k for k, t in enumerate(dict.fromkeys(flat_z))}
        place = getattr(self, "_place", None)
        if place is None:
            place = self._place = np.full(len(self.chinese) + 1, -1, dtype=np.int32)
        numbers = [self.chinese[t] for t in distinct]
        place[numbers] = np.arange(len(numbers))
        rows = {t: k for k, t in enumerate(dict.fromkeys(flat_s))}
        runs = [self.runs.get(t, (0, 0)) for t in rows]
        k = place[np.concatenate([self.partners[a:e] for a, e in runs])]
        c = np.concatenate([self.cosines[a:e] for a, e in runs])
        row = np.repeat(np.arange(len(rows)), [e - a for a, e in runs])
        place[numbers] = -1
        met = np.zeros((len(rows), len(numbers)), dtype=np.float32)
        met[row[k >= 0], k[k >= 0]] = c[k >= 0]
        return met.take([rows[t] for t in flat_s], axis=0).take([distinct[t] for t in flat_z], axis=1)


def fit(df: DataFrame, id_col: str = "entry_id") -> Lexicon:
    """Term cosines and term weights over all entries. Equal entries make one concept.

    The driver gets every cosine of LEAST or more between two terms of MIN_CONCEPTS entries: their number grows with the vocabulary."""
    base = df.where(F.col(id_col).isNotNull()).select("source", "zh").where("size(source) > 0 and size(zh) > 0")
    concepts = base.distinct().select(F.xxhash64("source", "zh").alias("entry"), "source", "zh")
    terms = cut(map_rows(concepts, _terms, "entry long, side string, term string"))
    k = terms.select("entry").distinct().count()
    counts = cut(terms.groupBy("side", "term").agg(F.count("*").alias("n")).where((F.col("n") >= MIN_CONCEPTS) & (F.col("n") <= max(MIN_CONCEPTS, MAX_SHARE * k))))
    kept = terms.join(counts, ["side", "term"])
    s = kept.where("side = 's'").select("entry", F.xxhash64("term").alias("a"))
    z = kept.where("side = 'z'").select("entry", F.xxhash64("term").alias("b"))
    pairs = s.join(z, "entry").groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 2")  # numbers as keys: this is the largest join
    side = lambda x, key: counts.where(f"side = '{x}'").select(F.xxhash64("term").alias(key), F.col("term").alias(x), F.col("n").alias(f"n{x}"))
    met = pairs.join(side("s", "a"), "a").join(side("z", "b"), "b").drop("a", "b")
    cosine = (F.col("n") * k - F.col("ns") * F.col("nz")) / F.sqrt(F.col("ns") * (k - F.col("ns")).cast("double") * F.col("nz") * (k - F.col("nz")))
    near = met.withColumn("c", cosine).where(F.col("c") >= LEAST)
    got = near.select("s", "z", F.col("c").cast("float").alias("c")).toArrow()
    pairs = tuple(got.column(c).to_numpy() if got.num_rows else np.zeros(0, dtype=object) for c in ("s", "z", "c"))
    known = {r["side"] + r["term"] for r in counts.select("side", "term").toLocalIterator()}
    seen = df.select("source", "zh").mapInArrow(_Frequencies(known), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    n = {r["term"]: r["n"] for r in seen.toLocalIterator()}
    whole = n.pop("all", 0)
    return Lexicon(pairs, {t: 0.1 + math.log((whole + 1) / c) for t, c in n.items()})


class _Align:
    def __init__(self, lexicon: Lexicon, ddl: str) -> None:
        self.lexicon, self.schema = lexicon, arrow_schema(ddl)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for e, source, zh in zip(*(b.column(j).to_pylist() for j in range(3))):
                if source and zh:
                    rows += [(e, *r) for r in self.lexicon.align(source, zh)]
            yield as_batch(rows, self.schema, 4)


def aligned(df: DataFrame, id_col: str = "entry_id", lexicon: Lexicon | None = None) -> DataFrame:
    """(id, source_no, zh_no, score) of the pairs of elements of source and zh that translate each other, wholly or in part.

    Positions count null elements. Null and empty lists, and null, empty and
    termless elements, pair with nothing; equal elements pair one to one, in order."""
    ddl = "id long, source_no int, zh_no int, score double"
    return df.select(F.col(id_col).alias("id"), "source", "zh").mapInArrow(_Align(lexicon or fit(df, id_col), ddl), ddl)
