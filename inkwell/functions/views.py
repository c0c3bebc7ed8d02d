"""Views of a text that hide or keep content, and excerpts of it."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

from inkwell.functions.text import FUNCTION_CHARS
from inkwell.operators.features import MARKS, SPEECH, WORD_GROUP

_HAN = re.compile("[一-鿿]")
_STYLE = re.compile("|".join(sorted(map(re.escape, WORD_GROUP), key=lambda w: (-len(w), w))))
_PLACEHOLDER = re.compile("<[A-Z]+>")
_FUNCTION = set(FUNCTION_CHARS)
#: Verbs of speech that count as style next to a mark.
SPEAKS = "说道问答喊叫"


def skeleton(text: str) -> str:
    """Content as C, line ends as ¶, runs of either as one; marks, style words and verbs of speech next to marks stay."""
    out: list[str] = []
    k, n = 0, len(text)
    while k < n:
        c = text[k]
        m = _PLACEHOLDER.match(text, k) or (_STYLE.match(text, k) if "一" <= c <= "鿿" else None)
        if m:
            token, k = ("C" if m.group()[0] == "<" else m.group()), m.end()
        elif c == "\n":
            token, k = "¶", k + 1
        elif c in MARKS or c in SPEECH:
            token, k = c, k + 1
        elif c.isalnum():
            beside = text[k - 1 : k] + text[k + 1 : k + 2]
            token, k = (c if c in SPEAKS and any(x in MARKS for x in beside) else "C"), k + 1
        else:
            k += 1
            continue
        if not (out and token in "C¶" and out[-1] == token):
            out.append(token)
    return "".join(out)


def counterfactual(text: str) -> str:
    """Han that carries no style as 龘, letters and digits as X; style words, function characters and marks stay."""
    kept = {k for m in _STYLE.finditer(text) for k in range(*m.span())}
    return "".join(c if k in kept or c in _FUNCTION else "龘" if _HAN.match(c) else "X" if c.isalnum() else c for k, c in enumerate(text))


def topic_swapped(text: str, terms: list[str]) -> str:
    """Listed terms, longest first, as 龘 of the same length."""
    if not terms:
        return text
    return re.sub("|".join(sorted(map(re.escape, terms), key=lambda t: (-len(t), t))), lambda m: "龘" * len(m.group()), text)


def style_ablated(text: str) -> str:
    """Style words and marks removed, function characters as 龘."""
    text = _STYLE.sub("", text)
    return "".join("龘" if c in _FUNCTION else c for c in text if c not in MARKS and c not in SPEECH)


def dialogue_shape(text: str) -> str:
    """Only C, S inside speech, ¶ and marks."""
    out: list[str] = []
    depth = 0
    for c in text:
        if c in "“「『":
            depth += 1
        token = "¶" if c == "\n" else c if c in MARKS or c in SPEECH else "S" if c.isalnum() and depth else "C" if c.isalnum() else ""
        if c in "”」』":
            depth = max(0, depth - 1)
        if token and not (token in "CS¶" and out and out[-1] == token):
            out.append(token)
    return "".join(out)


def han_window(text: str, start: int, length: int) -> str:
    """From the start-th Han character on, as much as holds `length` of them, marks behind the last included."""
    at = [m.start() for m in _HAN.finditer(text)]
    if start >= len(at) or length <= 0:
        return ""
    end = at[start + length] if start + length < len(at) else len(text)
    return text[at[start] : end]


def excerpt_start(text: str, key: str, length: int) -> int:
    """A line start, chosen by the hash of key, from which `length` Han characters still follow; 0 where none does."""
    starts = [0, *(m.end() for m in re.finditer("\n+", text))]
    left = [len(_HAN.findall(text[s:])) for s in starts]
    fit = [s for s, n in zip(starts, left) if n >= length]
    return fit[int(hashlib.sha256(key.encode()).hexdigest(), 16) % len(fit)] if fit else 0


def number_loss(source: str, target: str) -> list[str]:
    """Numbers of the source, Arabic or Chinese with a unit, that the target lacks, as often as they are lacking."""
    find = lambda s: Counter(re.findall(r"\d+(?:[.,]\d+)*|[零〇一二两三四五六七八九十百千万]{1,9}(?=[个名年月日天次里文岁步点])", s))
    return sorted((find(source) - find(target)).elements())


def truncated(text: str, limit: int) -> str:
    """At most limit code points, with … for what was cut."""
    return text if len(text) <= limit else text[: max(0, limit - 1)] + "…"
