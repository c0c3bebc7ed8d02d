"""One consistent form for text that looks alike.

`consistent(text)` applies the rules stated for the form; `variant_pattern()`
is a Java regular expression that finds every text that may not be in it, so
that the JVM can pass over the rest."""

from __future__ import annotations

import re
import unicodedata

# Invisible characters that the form has none of.
INVISIBLE = "­؜᠎​‌‍‎‏‪‫‬‭‮⁠⁦⁧⁨⁩﻿"
# Spaces other than U+0020; U+3000 stays as indentation.
SPACES = "               　"
# Greek and Cyrillic letters that look like the Latin letter below them.
LOOKALIKE_FROM = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳАВЕКМНОРСТХІЈЅԌԚԜҮӀаеорсухіјѕһԁԛԝӏ"
LOOKALIKE_TO__ = "ABEZHIKMNOPTYXocjABEKMHOPCTXIJSGQWYIaeopcyxijshdqwl"
# The ligatures of f.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}

KANGXI = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x2F00, 0x2FD6)}
HALF_WIDTH = {chr(c): chr(c - 0xFEE0) for a, z in (("０", "９"), ("Ａ", "Ｚ"), ("ａ", "ｚ")) for c in range(ord(a), ord(z) + 1)}
LOOKALIKES = dict(zip(LOOKALIKE_FROM, LOOKALIKE_TO__))

_PLAIN = str.maketrans(HALF_WIDTH | LIGATURES | KANGXI | dict.fromkeys(INVISIBLE.replace("‍", ""), ""))
_SPACES = str.maketrans(dict.fromkeys(SPACES, " "))
_LOOKS = str.maketrans(LOOKALIKES)
_GREEK_CYRILLIC = "Ͱ-ͳͶͷͺ-ͽͿΆΈ-ϿЀ-ҁҊ-ԯἀ-῿"
_LATIN = "A-Za-zªºÀ-ÖØ-öø-ʸḀ-ỿ"
#: A combining accent inside a word belongs to it.
_WORD = re.compile(f"[{_LATIN}{_GREEK_CYRILLIC}̀-ͯ]+")
_HAS_LATIN = re.compile(f"[{_LATIN}]")
_HAS_LOOKALIKE = re.compile(f"[{LOOKALIKE_FROM}]")
_EMOJI = "©®‼⁉™ℹ←-⇿⌚-⏿▪-➿⤴⤵⬀-⯿〰〽㊗㊙\U0001f000-\U0001faff"
_JOINER = re.compile(f"(?<![{_EMOJI}️⃣])‍|‍(?![{_EMOJI}])")
_SUSPECT = (
    f"[{INVISIBLE}{SPACES[:-1]}０-９Ａ-Ｚａ-ｚﬀ-ﬄ⼀-⿕豈-﫿{LOOKALIKE_FROM}̀-ͯᄀ-ᇿ゙゚"
    "̀-ͅʹ;·ά-῿ΩKÅ〈〉\U0002f800-\U0002fa1f]"
)


def _word(m: re.Match) -> str:
    w = m.group()
    return w.translate(_LOOKS) if _HAS_LOOKALIKE.search(w) and _HAS_LATIN.search(w) else w


def consistent(text: str | None) -> str | None:
    """The text in the consistent form; null stays null, and the form of a form is itself."""
    if text is None or text.isascii():
        return text
    s = text.translate(_PLAIN)
    if "‍" in s:
        s = _JOINER.sub("", s)
    indent = len(s) - len(s.lstrip("　"))
    s = s[:indent] + s[indent:].translate(_SPACES)
    if _HAS_LOOKALIKE.search(s):
        s = _WORD.sub(_word, s)
    if not unicodedata.is_normalized("NFC", s):
        s = unicodedata.normalize("NFC", s)
    return s


def variant_pattern() -> str:
    """Java pattern of texts that may change under `consistent`; what it does not find is in the form."""
    esc = lambda s: "".join(f"\\x{{{ord(c):x}}}" if ord(c) > 126 and c != "-" else c for c in s)
    return esc(_SUSPECT) + "|[^\\x{3000}]\\x{3000}"
