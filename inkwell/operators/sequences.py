"""Operators on ordered rows: chunks, windows, runs, gaps, forward fill, transitions."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from inkwell.functions.arrow import map_rows

TARGET, LEAST = 1500, 800


def pack(sizes: list[int], target: int = TARGET, least: int = LEAST) -> list[tuple[int, int]]:
    """Greedy packing of consecutive items: [start, stop) of each pack.

    A pack closes before an item that would exceed the target once it has the
    least size, and after one that reaches it; a tail below the least joins the
    pack before it."""
    out: list[tuple[int, int]] = []
    start, have = 0, 0
    for k, n in enumerate(sizes):
        if k > start and have >= least and have + n > target:
            out.append((start, k))
            start, have = k, 0
        have += n
        if have >= target:
            out.append((start, k + 1))
            start, have = k + 1, 0
    if start < len(sizes):
        if out and have < least:
            out[-1] = (out[-1][0], len(sizes))
        else:
            out.append((start, len(sizes)))
    return out


class _Chunks:
    def __init__(self, target: int, least: int) -> None:
        self.target, self.least = target, least

    def __call__(self, cols: dict[str, list]) -> Iterator[tuple]:
        han = re.compile("[一-鿿]")
        for i, paragraphs in zip(cols["id"], cols["paragraphs"]):
            kept = [p.strip() for p in paragraphs or [] if p and p.strip()]
            sizes = [len(han.findall(p)) for p in kept]
            for no, (a, b) in enumerate(pack(sizes, self.target, self.least)):
                yield i, no, a, b, sum(sizes[a:b]), "\n".join(kept[a:b])


def chunks(df: DataFrame, id_col: str, paragraphs: Column, target: int = TARGET, least: int = LEAST) -> DataFrame:
    """(id, chunk_no, first, stop, han, text): paragraphs packed into chunks of about target Han characters.

    Null and blank paragraphs are left out; a null or empty list has no chunk."""
    ddl = f"id {df.schema[id_col].dataType.simpleString()}, chunk_no int, first int, stop int, han long, text string"
    return map_rows(df.select(F.col(id_col).alias("id"), paragraphs.alias("paragraphs")), _Chunks(target, least), ddl, 1000)


def fixed_blocks(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Numbered blocks of `size` consecutive rows per key, as column block."""
    k = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("block", F.floor(k / size))


def sliding(df: DataFrame, keys: list[str], order: list[str], value: str, size: int) -> DataFrame:
    """For every row with size rows from it on: the list of their values, as column window."""
    w = W.partitionBy(*keys).orderBy(*order)
    ahead = W.partitionBy(*keys).orderBy(*order).rowsBetween(0, size - 1)
    return df.withColumn("_last", F.lead(F.lit(1), size - 1).over(w)).withColumn("window", F.collect_list(value).over(ahead)).where(F.col("_last").isNotNull()).drop("_last")


def runs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Run-length groups: (*keys, run_no, value, first, last, length) of consecutive rows with one value (nulls equal)."""
    w = W.partitionBy(*keys).orderBy(*order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    numbered = df.withColumn("_k", F.row_number().over(w).cast("long")).withColumn("_c", change.cast("long")).withColumn("run_no", F.sum("_c").over(w))
    return numbered.groupBy(*keys, "run_no").agg(F.first(value).alias("value"), F.min("_k").alias("first"), F.max("_k").alias("last"), F.count("*").alias("length"))


def forward_fill(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Last non-null value up to each row."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def context(df: DataFrame, keys: list[str], order: list[str], value: str, before: int, behind: int) -> DataFrame:
    """The values of the rows around each row, without its own, as columns before and behind."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("before", F.collect_list(value).over(w.rowsBetween(-before, -1))).withColumn("behind", F.collect_list(value).over(w.rowsBetween(1, behind)))


def transitions(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(source, target, n): how often one value follows another inside a key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_next", F.lead(value).over(w)).withColumn("_k", F.lead(F.lit(1)).over(w)).where("_k = 1").groupBy(F.col(value).alias("source"), F.col("_next").alias("target")).agg(F.count("*").alias("n"))


def sequence_findings(df: DataFrame, unit: str, order: str, number: str, tolerated: str | None = None) -> DataFrame:
    """(unit, order, number, finding): duplicate numbers, and numbers that do not follow the one before by one.

    A gap as large as the tolerated column of its row (extras between) is none. Null numbers are left out."""
    w = W.partitionBy(unit).orderBy(order)
    base = df.where(F.col(number).isNotNull())
    prev, gap = F.lag(number).over(w), F.col(number) - F.lag(number).over(w)
    twice = F.count("*").over(W.partitionBy(unit, number)) > 1
    allowed = F.coalesce(F.col(tolerated), F.lit(0)) if tolerated else F.lit(0)
    finding = F.when(twice, "duplicate").when(prev.isNull(), None).when(gap <= 0, "order").when(gap - 1 > allowed, "gap")
    return base.select(unit, order, number, finding.alias("finding")).where("finding is not null")


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Rows numbered by session: a session ends where nothing follows for gap_seconds."""
    w = W.partitionBy(key).orderBy(ts)
    new = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp")) > gap_seconds * 1_000_000).cast("long")
    return df.withColumn("session", F.sum(F.coalesce(new, F.lit(1))).over(w.rowsBetween(W.unboundedPreceding, 0)))


def balanced_blocks(sizes: list[int], blocks: int) -> list[tuple[int, int]]:
    """Contiguous blocks whose sizes differ least from their mean, by squared distance; never more blocks than items."""
    n = len(sizes)
    blocks = max(1, min(blocks, n)) if n else 0
    if not blocks:
        return []
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    mean = total[-1] / blocks
    best = [[float("inf")] * (n + 1) for _ in range(blocks + 1)]
    back = [[0] * (n + 1) for _ in range(blocks + 1)]
    best[0][0] = 0.0
    for k in range(1, blocks + 1):
        for j in range(k, n + 1):
            for i in range(k - 1, j):
                c = best[k - 1][i] + (total[j] - total[i] - mean) ** 2
                if c < best[k][j]:
                    best[k][j], back[k][j] = c, i
    out, j = [], n
    for k in range(blocks, 0, -1):
        out.append((back[k][j], j))
        j = back[k][j]
    return out[::-1]


def word_windows(sizes: list[int], target: int, least: int) -> list[tuple[int, int]]:
    """Consecutive items until the target is reached; a short tail joins the window before it, or is dropped if there is none."""
    out, start, have = [], 0, 0
    for k, n in enumerate(sizes):
        have += n
        if have >= target:
            out.append((start, k + 1))
            start, have = k + 1, 0
    if start < len(sizes):
        if have >= least:
            out.append((start, len(sizes)))
        elif out:
            out[-1] = (out[-1][0], len(sizes))
    return out


def excerpt_windows(sizes: list[int], low: int = 330, high: int = 520) -> list[tuple[int, int]]:
    """From every item the shortest stretch of at least low, if it does not exceed high."""
    out, stop, have = [], 0, 0
    for start in range(len(sizes)):
        while stop < len(sizes) and have < low:
            have += sizes[stop]
            stop += 1
        if low <= have <= high:
            out.append((start, stop))
        have -= sizes[start]
    return out


def aligned_windows(sizes: list[int], target: int = 1200, least: int = 600, most: int = 1500, merged: int = 1800) -> list[tuple[int, int]]:
    """Windows over paragraphs that two versions share by index: packed like chunks, closed before `most`; a short tail joins the last one up to `merged`."""
    out, start, have = [], 0, 0
    for k, n in enumerate(sizes):
        if k > start and have >= least and have + n > most:
            out.append((start, k))
            start, have = k, 0
        have += n
        if have >= target:
            out.append((start, k + 1))
            start, have = k + 1, 0
    if start < len(sizes):
        if out and have < least and sum(sizes[out[-1][0] : out[-1][1]]) + have <= merged:
            out[-1] = (out[-1][0], len(sizes))
        else:
            out.append((start, len(sizes)))
    return out


def covering_windows(n: int, failed: list[int], width: int) -> list[tuple[int, int]]:
    """Windows of at most width items that cover all failed positions, each with its failures in the middle."""
    out: list[tuple[int, int]] = []
    left = sorted(set(failed))
    while left:
        first = left[0]
        inside = [f for f in left if f < first + width]
        left = left[len(inside) :]
        spare = width - (inside[-1] - first + 1)
        a = max(0, min(first - spare // 2, n - width))
        out.append((a, min(n, a + width)))
    return out


_NUMBERED = re.compile(r"^\s*(?:\(|（)?(\d{1,3}|[一二三四五六七八九十]{1,3})(?:\)|）|[.、．])\s*(\S.*)?$")


def numbered_items(paragraphs: list[str]) -> list[int]:
    """Positions of paragraphs numbered 1, 2, ... N in order, N at least 2; none if the numbers do not make such a list."""
    from inkwell.functions.prose import parse_number

    hits = [(k, parse_number(m[1])) for k, p in enumerate(paragraphs) if (m := _NUMBERED.match(p))]
    return [k for k, _ in hits] if len(hits) >= 2 and [n for _, n in hits] == list(range(1, len(hits) + 1)) else []


def rejoined(paragraphs: list[str]) -> list[str]:
    """Paragraphs broken in the wrong place put together: one that ends in a comma, and one that is only a closing mark."""
    out: list[str] = []
    for p in paragraphs:
        if out and p and (out[-1].endswith(("，", "、")) or p.strip() in ("”", "’", "」", "』")):
            out[-1] += p.strip()
        else:
            out.append(p)
    return out


def note_ranges(paragraphs: list[str]) -> list[tuple[int, int]]:
    """[start, stop) of author's notes: from a paragraph that opens one to the next scene break, heading or blank, or to the end."""
    opens = re.compile(r"^\s*[【\[（(]?\s*作者(?:有话(?:要)?说|的话)")
    stops = re.compile(r"^\s*(?:\*{3,}|[-—]{3,}|第[零〇一二三四五六七八九十百千\d]+[章节回])?\s*$|^\s*第[零〇一二三四五六七八九十百千\d]+[章节回]")
    out, k = [], 0
    while k < len(paragraphs):
        if opens.match(paragraphs[k]):
            j = k + 1
            while j < len(paragraphs) and not stops.match(paragraphs[j]):
                j += 1
            out.append((k, j))
            k = j
        else:
            k += 1
    return out
