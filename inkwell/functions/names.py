"""Column expressions on names, titles, links and short settings. Null gives null unless stated."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from inkwell.functions.text import col

# Characters that no file name holds.
NOT_IN_PATHS = '[\\\\/:*?"<>|\\x00]+'
# What ends a file name.
EXTENSIONS = "jpe?g|png|gif|webp|avi|mp4|mp3|txt|pdf|docx?|xlsx?|zip|rar|epub|html?"
# Lines of mirror sites.
MIRROR_DOMAIN = "^[()\\[\\]（）【】\\s•·.。ｃｏｍcomCOM]+$"
MIRROR_PROMO = "^[^\\x{4e00}-\\x{9fff}A-Za-z0-9]{0,3}想看.{0,40}《[^》]+》$"
MIRROR_WORDS = "提醒您最全|最新章 节|最新章节|全网首发更新|想看"
# Traces of damage in a text, by signal.
SIGNALS = {"damaged_character": "[\\x{fffd}\\x{e000}-\\x{f8ff}]", "mojibake": "锟斤拷|鏂囧|鈥|\\x{fffd}", "missing_text_marker": "[\\x{3400}-\\x{9fff}][*＊□]{1,8}[\\x{3400}-\\x{9fff}]", "escape_residue": "[\\x{3400}-\\x{9fff}]\\\\[\\x{3400}-\\x{9fff}]"}


def path_name(c: Column | str, fallback: str) -> Column:
    """A name that a file can have; null, empty and dotted-out names become the fallback."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), NOT_IN_PATHS, "_"), "\\s+", " ")
    return F.coalesce(F.nullif(F.regexp_replace(s, "^[ .]+|[ .]+$", ""), F.lit("")), F.lit(fallback))


def anchor(member: Column | str, key: Column | str) -> Column:
    """A stable anchor of a place in a document."""
    return F.concat(F.lit("anchor-"), F.substring(F.sha2(F.concat(col(member), F.lit("#"), col(key)), 256), 1, 20))


def title_dots(c: Column | str) -> Column:
    """Full stops of a title as middle dots, but for decimals, ellipses and file extensions."""
    return F.regexp_replace(col(c), f"(?i)(?<!\\.)(?<![0-9](?=\\.[0-9]))\\.(?!\\.)(?!(?:{EXTENSIONS})(?![A-Za-z0-9]))", "·")


def is_mirror_line(c: Column | str) -> Column:
    """Whether a line is an advertisement of a mirror site; null is none."""
    x = col(c)
    advert = x.contains("域名") & x.contains("《") & x.rlike(MIRROR_WORDS)
    return F.coalesce(x.rlike(MIRROR_DOMAIN) | x.rlike(MIRROR_PROMO) | advert, F.lit(False))


def damage(c: Column | str) -> Column:
    """The signals of damage that a text shows, in order; an empty array for null."""
    return F.filter(F.array(*[F.when(col(c).rlike(p), F.lit(k)) for k, p in SIGNALS.items()]), lambda x: x.isNotNull())


def declared_author(lines: Column | str, within: int = 8) -> Column:
    """The author that one of the first lines declares; null if none does."""
    found = F.transform(F.slice(col(lines), 1, within), lambda x: F.regexp_extract(x, "^\\s*作者\\s*[:：]\\s*(\\S.{0,39}?)\\s*$", 1))
    return F.try_element_at(F.filter(found, lambda x: x != ""), F.lit(1))


def query_value(url: Column | str, key: str) -> Column:
    """The value of a key in the query of a link; null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(col(url), f"[?&]{key}=([^&#]*)", 1), F.lit(""))


def declarations(style: Column | str) -> Column:
    """property -> value of a style attribute, lower-cased names, the last of a name wins; null is an empty map."""
    parts = F.filter(F.transform(F.split(F.coalesce(col(style), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x.rlike("^[^:]+:.*\\S"))
    pairs = F.transform(parts, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]+:", "")).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"]))


def unknown_fields(c: Column | str, allowed: list[str]) -> Column:
    """The names of a comma list that are not allowed, in order, each once."""
    names = F.filter(F.transform(F.split(col(c), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_except(names, F.array(*[F.lit(a) for a in allowed]))


def distinct_filled(c: Column | str) -> Column:
    """The different values of an array that are neither null nor blank, in order."""
    return F.array_distinct(F.filter(F.transform(col(c), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False))))
