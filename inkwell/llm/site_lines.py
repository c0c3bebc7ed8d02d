"""Lines repeated across one site's documents.

Method: hash normalized lines, count distinct documents per source and hash,
threshold by document share, then join back and rebuild documents without the
frequent lines.

Every record emits each of its distinct lines once, so that counting needs one
pre-aggregated shuffle of hashes; the host that owns a third of all rows is
spread over its lines. Frequent lines are joined back on their hash."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import xxhash
from pyspark.sql import DataFrame, functions as F

from inkwell.functions.arrow import map_rows
from inkwell.functions.textform import consistent
from inkwell.session import cut

MIN_RECORDS = 6
MIN_SHARE = 0.05

_DIGITS = re.compile(r"\d+")


def source_of(url: str | None) -> str | None:
    """The host in a URL, lower-cased, without port and a leading www. or m.; null without one."""
    if url is None or not (u := url.strip()):
        return None
    if "//" not in u:
        u = "//" + u
    try:
        host = (urlsplit(u).netloc.rpartition("@")[2] or "").lower()
    except ValueError:
        return None
    host = re.sub(r":\d*$", "", host)
    for lead in ("www.", "m."):
        if host.startswith(lead):
            host = host[len(lead) :]
            break
    return host or None


def line_key(line: str | None) -> str | None:
    """What makes two lines the same: consistent form, no white space, digit runs as one mark; None if blank."""
    if line is None:
        return None
    s = "".join(consistent(line).split())
    return _DIGITS.sub("0", s) or None


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _lines(cols: dict[str, list]) -> Iterator[tuple]:
    sources: dict[str, str | None] = {}
    for i, url, paragraphs in zip(cols["id"], cols["url"], cols["paragraphs"]):
        if url is None:
            continue
        if url not in sources:
            if len(sources) > 100_000:
                sources.clear()
            sources[url] = source_of(url)
        if (source := sources[url]) is None:
            continue
        at: dict[str, list[int]] = {}
        for no, p in enumerate(paragraphs or []):
            if (k := line_key(p)) is not None:
                at.setdefault(k, []).append(no)
        s = _signed(xxhash.xxh3_64_intdigest(source.encode("utf-8", "surrogatepass")))
        yield i, source, s, [_signed(xxhash.xxh3_64_intdigest(f"{source}\0{k}".encode("utf-8", "surrogatepass"))) for k in at], list(at.values())


def site_lines(df: DataFrame, id_col: str = "chapter_id", url_col: str = "source_url", paragraphs_col: str = "paragraphs", min_records: int = MIN_RECORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """(id, para_no, source, line) of every paragraph whose line is frequent in its source; line is the line's hash.

    Every row counts as a record of its source, also without paragraphs. Null
    and blank paragraphs are no lines; null ids and null, empty or hostless
    URLs are left out."""
    base = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(paragraphs_col).alias("paragraphs")).where("id is not null")
    rows = cut(map_rows(base, _lines, "id long, source string, s long, keys array<long>, nos array<array<int>>", 2000))
    each = rows.select("id", "s", F.posexplode("keys").alias("k", "line"), "nos").select("id", "s", "line", F.col("nos")[F.col("k")].alias("nos"))
    size = rows.groupBy("s").agg(F.count("*").alias("records"), F.min("source").alias("source"))
    often = each.groupBy("line").agg(F.count("*").alias("n"), F.min("s").alias("s")).where(F.col("n") >= min_records)
    frequent = cut(often.join(size, "s").where(F.col("n") + 1e-9 >= F.col("records") * min_share).select("line", "source", "n", "records"))
    return each.join(frequent, "line").select("id", F.explode("nos").alias("para_no"), "source", "line", "n", "records")


def frequent_lines(df: DataFrame, id_col: str = "chapter_id", url_col: str = "source_url", paragraphs_col: str = "paragraphs") -> DataFrame:
    """(source, line, example, n, records): each frequent line per site with the least of its stored forms."""
    found = site_lines(df, id_col, url_col, paragraphs_col)
    texts = df.select(F.col(id_col).alias("id"), F.posexplode(paragraphs_col).alias("para_no", "text"))
    return found.join(texts, ["id", "para_no"]).groupBy("source", "line").agg(F.min("text").alias("example"), F.max("n").alias("n"), F.max("records").alias("records"))


def without_paragraphs(df: DataFrame, found: DataFrame, id_col: str = "chapter_id", paragraphs_col: str = "paragraphs") -> DataFrame:
    """df's ids and paragraphs without the found (id, para_no); null lists stay null."""
    gone = found.groupBy("id").agg(F.collect_set("para_no").alias("gone"))
    base = df.select(F.col(id_col), F.col(paragraphs_col))
    out = base.join(gone, base[id_col] == gone["id"], "left")
    kept = F.when(F.col("gone").isNull(), F.col(paragraphs_col)).otherwise(F.filter(F.col(paragraphs_col), lambda p, k: ~F.array_contains(F.col("gone"), k)))
    return out.select(id_col, kept.alias(paragraphs_col), F.coalesce(F.size("gone"), F.lit(0)).alias("dropped"))
