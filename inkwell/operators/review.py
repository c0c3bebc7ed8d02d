"""Review of texts: findings are rows, and never rewrite anything."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from inkwell.functions.arrow import map_rows

# Advertising that sites put between paragraphs, by kind.
AD_KINDS = {"domain": r"(?i)(?:www\.|https?://|\.(?:com|net|org|cc)\b)", "group": r"(?:书友|资源|读者|粉丝)群\s*[:：]?\s*\d{5,}", "reader": r"(?:手机|移动端)(?:用户|阅读).{0,12}(?:阅读|继续)", "vote": r"求(?:推荐票|月票|收藏)"}


def bad_character(c: str) -> str | None:
    """Why a character should not stand in prose, or None."""
    if c in "\n\r\t":
        return None
    k, n = unicodedata.category(c), ord(c)
    if n == 0xFFFD:
        return "replacement"
    if k == "Co":
        return "private use"
    if 0x3100 <= n <= 0x312F:
        return "bopomofo"
    if c in "​‌‍⁠﻿":
        return "zero width"
    return {"Cc": "control", "Cn": "unassigned"}.get(k)


def quote_mismatches(paragraphs: list[str | None], opening: str = "“", closing: str = "”") -> list[int]:
    """Paragraphs with a closing quote that nothing opened, or the opening one that nothing closes.

    A speech over several paragraphs opens each of them and closes the last."""
    depth, began, found = 0, 0, set()
    for k, p in enumerate(paragraphs):
        p = p or ""
        spots = [i for i, c in enumerate(p) if c in (opening, closing)]
        for n, i in enumerate(spots):
            if p[i] == opening:
                if n == 0 and depth and not p[:i].strip():
                    continue
                if depth == 0:
                    began = k
                depth += 1
            elif depth:
                depth -= 1
            else:
                found.add(k)
    if depth:
        found.add(began)
    return sorted(found)


def _findings(cols: dict[str, list]) -> Iterator[tuple]:
    ads = {k: re.compile(v) for k, v in AD_KINDS.items()}
    for i, paragraphs in zip(cols["id"], cols["paragraphs"]):
        for k in quote_mismatches(paragraphs or []):
            yield i, k, "quotes", None
        for k, p in enumerate(paragraphs or []):
            if p is None:
                continue
            for why in sorted({w for c in set(p) if not c.isascii() and (w := bad_character(c))} | {"control" for c in p if c < " " and c not in "\n\r\t"}):
                yield i, k, "character", why
            for kind, pattern in ads.items():
                if pattern.search(p):
                    yield i, k, "advertising", kind
            if re.search(r"[㐀-鿿][*＊□]{1,8}[㐀-鿿]", p):
                yield i, k, "missing text", None
            if re.search(r"[㐀-鿿]\\[㐀-鿿]", p):
                yield i, k, "escape", None
            if '"' in p and re.search("[㐀-鿿]", p):
                yield i, k, "straight quote", None


def findings(df: DataFrame, id_col: str, list_col: str) -> DataFrame:
    """(id, para_no, kind, detail): what a reader should look at. Null paragraphs have none."""
    return map_rows(df.select(F.col(id_col).cast("long").alias("id"), F.col(list_col).alias("paragraphs")), _findings, "id long, para_no int, kind string, detail string", 2000)


def compare_editions(left: list[str], right: list[str]) -> list[tuple[str, int, int, int, int]]:
    """Aligned stretches of two paragraph lists: (equal, insert, delete or replace, left start, stop, right start, stop)."""
    return difflib.SequenceMatcher(None, left, right, autojunk=False).get_opcodes()


def _editions(cols: dict[str, list]) -> Iterator[tuple]:
    for a, b, x, y in zip(cols["a"], cols["b"], cols["x"], cols["y"]):
        for kind, i, j, k, m in compare_editions([p or "" for p in x or []], [p or "" for p in y or []]):
            yield a, b, kind, i, j, k, m


def edition_changes(pairs: DataFrame) -> DataFrame:
    """(a, b, kind, i, j, k, m) for pairs (a, b, x, y) of paragraph lists x and y."""
    return map_rows(pairs.select("a", "b", "x", "y"), _editions, "a long, b long, kind string, i int, j int, k int, m int", 2000)


def fidelity(source: str, output: str, low: float = 0.5, high: float = 1.8) -> list[str]:
    """What an output lost or added against its source: numbers, placeholders, Latin words, length, speech, quotes."""
    bag = lambda p, s: sorted(re.findall(p, s))
    out = []
    for name, p in (("numbers", r"\d+(?:[.,:/-]\d+)*"), ("placeholders", r"<[A-Z]+>"), ("latin", r"[A-Za-z][A-Za-z0-9_'-]*")):
        if bag(p, source) != bag(p, output):
            out.append(name)
    n = len(source.strip())
    if n and not low <= len(output.strip()) / n <= high:
        out.append("length")
    if source.strip()[:1] in "“\"「" and output.strip()[:1] not in "“\"「":
        out.append("speech")
    if output.count("“") != output.count("”"):
        out.append("quotes")
    return out


def apply_patches(text: str, patches: list[tuple[str, str]]) -> str:
    """Exact-once replacements, placed in the original text; a patch that is absent, repeated or overlaps another is a ValueError."""
    spans = []
    for old, new in patches:
        if not old or text.count(old) != 1:
            raise ValueError(f"found {text.count(old) if old else 0} times: {old!r}")
        k = text.index(old)
        spans.append((k, k + len(old), new))
    spans.sort()
    if any(a[1] > b[0] for a, b in zip(spans, spans[1:])):
        raise ValueError("patches overlap")
    for a, b, new in reversed(spans):
        text = text[:a] + new + text[b:]
    return text
