"""Catalogue operators: addresses, search ranking, coverage checks, strata, quotas, nested values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from inkwell.operators.order import with_prefix


def canonical_url(c: Column | str) -> Column:
    """host/path in lower-case host: no scheme, user, port, www. or m., query, fragment or slash at the end; null without a host."""
    u = F.trim(F.col(c) if isinstance(c, str) else c)
    bare = F.regexp_replace(u, "^([A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    bare = F.regexp_replace(F.regexp_replace(bare, "[?#].*$", ""), "/+$", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, "^([^/]*)", 1), "^.*@", ""), ":[0-9]*$", ""))
    host = F.regexp_replace(host, "^(www|m)\\.", "")
    return F.when(host != "", F.concat(host, F.regexp_extract(bare, "^[^/]*(/.*)?$", 1)))


def match_level(query: str, title: Column, author: Column, snippet: Column | None = None) -> Column:
    """4 equal title, 3 title holds the query, 2 title holds all its words, 1 author or snippet holds it, 0 nothing."""
    key = lambda c: F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", "")
    import re

    q = re.sub(r"[\W_]+", "", query.lower())
    words = [w for w in re.split(r"[\W_]+", query.lower()) if w]
    t = key(title)
    every = F.lit(True)
    for w in words:
        every = every & t.contains(w)
    side = key(author).contains(q)
    if snippet is not None:
        side = side | F.coalesce(key(snippet).contains(q), F.lit(False))
    return F.when(t == q, 4).when(t.contains(q), 3).when(every, 2).when(F.coalesce(side, F.lit(False)), 1).otherwise(0)


def ranked(df: DataFrame, level: Column, ties: list[Column], top: int) -> DataFrame:
    """The best rows of a level above 0."""
    return df.withColumn("level", level).where("level > 0").orderBy(F.desc("level"), *ties).limit(top)


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of every key; rows with a null key are kept apart by their null."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def conflicting(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, rows, versions): keys whose rows disagree in the columns (null is a value of its own)."""
    v = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"), F.countDistinct(v).alias("versions")).where("versions > 1")


def index_gaps(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """(*keys, first, last): stretches of indexes missing between those there are. One lead per row, no list of expected ones."""
    d = df.where(F.col(index).isNotNull()).select(*keys, index).distinct()
    nxt = F.lead(index).over(W.partitionBy(*keys).orderBy(index))
    return d.withColumn("_n", nxt).where(F.col("_n") > F.col(index) + 1).select(*keys, (F.col(index) + 1).alias("first"), (F.col("_n") - 1).alias("last"))


def zipped(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, no, left, right): two lists side by side, the shorter one filled with null."""
    z = F.arrays_zip(F.coalesce(F.col(left), F.array().cast("array<string>")).alias("l"), F.coalesce(F.col(right), F.array().cast("array<string>")).alias("r"))
    return df.select(key, F.posexplode(z).alias("no", "z")).select(key, F.col("no").cast("long").alias("no"), F.col("z.l").alias(left), F.col("z.r").alias(right))


def strata(df: DataFrame, value: str) -> DataFrame:
    """df with low, medium or high by the terciles of all rows, and the percent rank, as columns stratum and percent."""
    cuts = df.agg(F.percentile(value, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_c"))
    per = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    whole = per.agg(F.sum("_n").alias("_all"))
    pct = with_prefix(per, value, {"_n": "_b"}).crossJoin(F.broadcast(whole)).select(F.col(value).alias("_v"), (F.col("_b") / F.greatest(F.col("_all") - 1, F.lit(1))).alias("percent"))
    out = df.crossJoin(F.broadcast(cuts)).join(pct, F.col(value) == F.col("_v"), "left")
    return out.withColumn("stratum", F.when(F.col(value) <= F.col("_c")[0], "low").when(F.col(value) <= F.col("_c")[1], "medium").when(F.col(value).isNotNull(), "high")).drop("_c", "_v")


def quota(candidates: DataFrame, have: DataFrame, group: str, want: int, order: list) -> DataFrame:
    """Of every group the first candidates that bring it to the wanted number, with what it has already."""
    h = have.select(F.col(group).alias("_g"), F.col("n").alias("_have"))
    k = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return candidates.join(h, F.col(group) == F.col("_g"), "left").withColumn("_k", k).where(F.col("_k") <= F.lit(want) - F.coalesce("_have", F.lit(0))).drop("_g", "_have", "_k")


def two_level_rate(df: DataFrame, outer: str, inner: str, hit: Column) -> DataFrame:
    """(outer, rate, inners): mean over inner groups of their share of hits, so that every inner group counts the same."""
    per = df.groupBy(outer, inner).agg(F.avg(hit.cast("double")).alias("r"))
    return per.groupBy(outer).agg(F.avg("r").alias("rate"), F.count("*").alias("inners"))


def paired_gap(df: DataFrame, keys: list[str], side: str, a: str, b: str, value: str) -> DataFrame:
    """(*keys, a, b, gap) of the mean values on both sides; keys without one of them are left out."""
    p = df.groupBy(*keys).agg(F.avg(F.when(F.col(side) == a, F.col(value))).alias("a"), F.avg(F.when(F.col(side) == b, F.col(value))).alias("b"))
    return p.where("a is not null and b is not null").withColumn("gap", F.col("a") - F.col("b"))


def filled_titles(df: DataFrame, key: str, order: str, title: str) -> DataFrame:
    """Missing and blank titles as the last good one with its distance: title (2), title (3)."""
    good = F.when(F.trim(F.col(title)) != "", F.col(title))
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    d = df.withColumn("_good", F.last(good, ignorenulls=True).over(w)).withColumn("_run", F.count(good).over(w))
    n = F.row_number().over(W.partitionBy(key, "_run").orderBy(order))
    return d.withColumn("_n", n).withColumn("filled", F.when(good.isNotNull(), good).when(F.col("_good").isNotNull(), F.concat("_good", F.lit(" ("), F.col("_n").cast("string"), F.lit(")")))).drop("_good", "_run", "_n")


def walk(value: object, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], str]]:
    """All strings of nested lists and maps with their paths, in order."""
    if isinstance(value, str):
        return [(path, value)]
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    return [leaf for k, v in items for leaf in walk(v, (*path, str(k)))]


def ordered_members(sections: list[dict], depth: int = 3) -> list[str]:
    """Members of an outline depth first; an empty section, or one deeper than depth, is a ValueError."""
    out: list[str] = []
    for s in sections:
        if "member" in s:
            out.append(s["member"])
            continue
        if depth <= 1 or not s.get("children"):
            raise ValueError(f"section {s.get('title')!r} is empty or too deep")
        out += ordered_members(s["children"], depth - 1)
    return out


def outline_problems(sections: list[dict], chapters: list[str]) -> list[str]:
    """Chapters that an outline names never or more than once, and members that are no chapters."""
    named = ordered_members(sections)
    twice = sorted({m for m in named if named.count(m) > 1})
    return [f"missing {c}" for c in chapters if c not in named] + [f"twice {m}" for m in twice] + [f"unknown {m}" for m in dict.fromkeys(named) if m not in chapters]
