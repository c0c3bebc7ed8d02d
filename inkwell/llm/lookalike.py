"""Visually identical text with different characters.

Method: compute transitive look-alike classes by union-find over strings and
code points, choose frequency-based representatives, and rewrite greedily with
a multi-pattern automaton.

The code points of all text are counted first. Every counted code point is tied
to what it looks like (its half-width, composed, unified or spelled-out form,
the space, nothing at all, the Latin letter), and every base letter with a
combining accent to its single character, through all forms of the base.
The most frequent member of each class represents it; where the consistent
form, which is a given, has no such member, its most frequent member within the
form does. The longest variant wins at every place. Two automata are
built: one for all text, and one, with the look-alike letters, for words that
hold a Latin letter.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkwell.functions import textform as T
from inkwell.functions.arrow import arrow_schema, as_batch
from inkwell.llm.points import TOP, census, points_of


class Classes:
    """Union-find over strings; the members of a class look alike."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = defaultdict(list)
        for x in list(self.up):
            out[self.find(x)].append(x)
        return out


def _links(points: list[str], in_word: bool) -> Iterator[tuple[str, str]]:
    for c in points:
        if c in T.HALF_WIDTH:
            yield c, T.HALF_WIDTH[c]
        elif c in T.KANGXI:
            yield c, T.KANGXI[c]
        elif c in T.LIGATURES:
            yield c, T.LIGATURES[c]
        elif in_word and c in T.LOOKALIKES:
            yield c, T.LOOKALIKES[c]
        elif (n := unicodedata.normalize("NFC", c)) != c:
            yield c, n


def look_classes(counts: np.ndarray, in_word: bool, form: Callable[[str], str] | None = T.consistent) -> dict[str, str]:
    """variant -> representative, for the code points counted.

    form: what representatives must be left alone by; None lets frequency decide alone."""
    present = [chr(c) for c in np.flatnonzero(counts) if not 0xD800 <= c < 0xE000]
    uf = Classes()
    for a, b in _links(present, in_word):
        uf.union(a, b)
    marks = [c for c in present if unicodedata.combining(c)]
    forms: dict[str, set[str]] = defaultdict(set)
    for m in uf.members().values():
        for x in m:
            forms[x].update(m)
    bases = {c for c in present if unicodedata.category(c)[0] == "L" and not 0x3400 <= ord(c) < 0xA000} | {b for x in forms for b in forms[x] if len(b) == 1}
    queue = sorted(bases)
    seen = set(queue)
    while queue:  # a composed letter may be the base of the next accent
        after = []
        for b in queue:
            for m in marks:
                one = unicodedata.normalize("NFC", b + m)
                if len(one) != 1:
                    continue
                for v in forms.get(b, {b}) | {b}:
                    uf.union(v + m, one)
                    forms[one].add(v + m)
                forms[one].add(one)
                if one not in seen:
                    seen.add(one)
                    after.append(one)
        queue = after
    table: dict[str, str] = {}
    frequency = lambda s: min((int(counts[ord(c)]) for c in s), default=0)
    for members in uf.members().values():
        best = _representative(members, frequency, in_word, form)
        table.update((x, best) for x in members if x != best)
    if not in_word:
        for c in T.INVISIBLE:
            table[c] = ""
        for c in T.SPACES:
            table[c] = " "
    return table


def _representative(members: list[str], frequency: Callable[[str], int], in_word: bool, form: Callable[[str], str] | None) -> str:
    ranked = sorted(members, key=lambda x: (-frequency(x), len(x), x))
    if form is None:
        return ranked[0]
    within = [x for x in ranked if form(x) == x and not (in_word and any(c in T.LOOKALIKES for c in x))]
    return next((x for x in within if unicodedata.is_normalized("NFC", x)), (within or ranked)[0])


class Rewriter:
    """Greedy leftmost-longest rewriting; picklable, the automata are built where they are used."""

    def __init__(self, counts: np.ndarray) -> None:
        self.everywhere, self.in_word = look_classes(counts, False), look_classes(counts, True)
        self._built = None

    def __getstate__(self) -> dict:
        return {"everywhere": self.everywhere, "in_word": self.in_word, "_built": None}

    def _machines(self) -> tuple:
        if self._built is None:
            flags = np.zeros(TOP, dtype=bool)
            for c in {c for t in (self.everywhere, self.in_word) for k in t for c in k if not c.isascii()}:
                flags[ord(c)] = True
            flags[0x1161:0x1200] = True  # conjoining jamo compose by rule, not by table
            self._built = (_automaton(self.everywhere), _automaton(self.in_word), flags)
        return self._built

    def flags(self) -> np.ndarray:
        """Code points that some variant holds and ASCII does not."""
        return self._machines()[2]

    def __call__(self, text: str) -> str:
        everywhere, in_word, _ = self._machines()
        seen = set()
        while text not in seen:  # what one pass removes may have kept an accent from its letter
            seen.add(text)
            done = _rewrite(everywhere, text)
            if T._HAS_LOOKALIKE.search(done):
                done = T._WORD.sub(lambda m: _rewrite(in_word, m.group()) if T._HAS_LATIN.search(m.group()) else m.group(), done)
            if done == text:
                return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
            text = done
        raise ValueError(f"rewriting does not end: {text[:80]!r}")


def _automaton(table: dict[str, str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k, v in table.items():
        a.add_word(k, (len(k), v))
    if table:
        a.make_automaton()
    return a


def _rewrite(machine: ahocorasick.Automaton, text: str) -> str:
    if not len(machine):
        return text
    out, last = [], 0
    indent = len(text) - len(text.lstrip("　" + T.INVISIBLE))
    found: dict[int, tuple[int, str]] = {}
    for end, (n, v) in machine.iter(text):  # every match; of those that begin at one place the longest
        a = end + 1 - n
        if a not in found or n > found[a][0]:
            found[a] = (n, v)
    for a in sorted(found):
        n, v = found[a]
        if a < last:
            continue
        if n == 1 and (c := text[a]) in "　‍" and (c == "　" and a < indent or c == "‍" and not T._JOINER.match(text, a)):
            continue
        out += [text[last:a], v]
        last = a + n
    return "".join(out) + text[last:] if out else text


class _Variants:
    """Texts that are not in the consistent form, with it. Cases of the garbled model are left out."""

    def __init__(self, rewriter: Rewriter, garbled: object, ddl: str) -> None:
        self.rewriter, self.garbled, self.schema = rewriter, garbled, arrow_schema(ddl)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from inkwell.llm.encoding import restore, suspects

        flags = self.rewriter.flags()
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = []
            for j in range(1, b.num_columns):
                p = points_of(b.column(j))
                title = not pa.types.is_list(b.column(j).type)
                hit = flags[p.points]
                indent = (p.points == 0x3000) & hit
                if indent.any():  # an indent is no variant: U+3000 counts only behind something else
                    before = np.concatenate(([0x3000], p.points[:-1]))
                    first = np.zeros(len(p.points) + 1, dtype=bool)
                    first[p.starts[:-1]] = True
                    hit = hit & ~(indent & ((before == 0x3000) | first[:-1]))
                    late = indent & (before == 0x3000) & ~first[:-1]
                    if late.any():  # runs of U+3000 that do not begin the text
                        hit |= _late_runs(p, late, first[:-1])
                some = p.counts(hit) > 0
                odd = dict(suspects(p, self.garbled)) if self.garbled is not None and not title else {}
                for k in np.flatnonzero(some):
                    text = p.texts[int(k)].as_py()
                    form = self.rewriter(text)
                    if form == text:
                        continue
                    if k in odd and restore(text, self.garbled, odd[k]) is not None:
                        continue
                    rows.append((ids[p.row[k]], -1 if title else int(p.no[k]), text, form))
            for lo in range(0, len(rows), 5000):
                yield as_batch(rows[lo : lo + 5000], self.schema, 4)


def _late_runs(p, late: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of the U+3000 behind another one, those whose run does not begin the text."""
    ideographic = p.points == 0x3000
    starts = np.flatnonzero(ideographic & ~np.concatenate(([False], ideographic[:-1] & ~first[1:])))
    run = np.searchsorted(starts, np.flatnonzero(late), "right") - 1
    out = np.zeros(len(p.points), dtype=bool)
    out[np.flatnonzero(late)] = ~first[starts[run]]
    return out


def variants(df: DataFrame, id_col: str = "chapter_id", title_col: str = "title", list_col: str = "paragraphs", skip_garbled: bool = True) -> DataFrame:
    """(id, para_no, text, form) of every title (para_no -1) and paragraph that is not in the consistent form.

    skip_garbled leaves out paragraphs decoded with a wrong encoding. Null
    titles, lists and elements are in the form."""
    counts = census(df, [title_col, list_col])
    model = None
    if skip_garbled:
        from inkwell.llm.encoding import learn

        model = learn(df, list_col)
    ddl = "id long, para_no int, text string, form string"
    base = df.select(F.col(id_col).alias("id"), F.col(title_col).alias("t"), F.col(list_col).alias("p"))
    return base.mapInArrow(_Variants(Rewriter(counts), model, ddl), ddl)
