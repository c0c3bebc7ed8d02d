"""Joins of books, titles, links and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from inkwell.functions import text as X


def title_variants(c: Column | str) -> Column:
    """A title's comparable forms: itself, and itself without what is in brackets at its end or behind a separator."""
    t = F.lower(X.without_space(c))
    t = F.regexp_replace(t, "^[《「『]|[》」』]$", "")
    return F.array_distinct(F.filter(F.array(t, F.regexp_replace(t, "[（(【\\[][^（(【\\[）)】\\]]*[）)】\\]]$", "")), lambda x: x != ""))


def match_titles(left: DataFrame, right: DataFrame, left_id: str, right_id: str, title: str = "title") -> DataFrame:
    """(left_id, right_id): rows of which some title variants are equal. An equi join on variants, not on pairs."""
    a = left.select(F.col(left_id), F.explode(title_variants(title)).alias("v"))
    b = right.select(F.col(right_id), F.explode(title_variants(title)).alias("v"))
    return a.join(b, "v").select(left_id, right_id).distinct()


def overlay(base: DataFrame, patch: DataFrame, key: str, fields: list[str], keep: list[str] | None = None) -> DataFrame:
    """base with the patch's non-empty fields; pinned fields and those the patch leaves empty stay."""
    keep = keep or []
    p = patch.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    full = lambda f: F.col(f"_{f}").isNotNull() & (F.col(f"_{f}").cast("string") != "")
    new = {f: F.when(full(f), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields if f not in keep}
    return base.join(p, F.col(key) == F.col("_k"), "left").select(*[new.get(c, F.col(c)).alias(c) for c in base.columns])


def cascade(base: DataFrame, key: str, value: str, sources: list[DataFrame]) -> DataFrame:
    """The first source that knows a key gives its value: columns value and source_no."""
    out = base
    for k, s in enumerate(sources):
        out = out.join(s.select(F.col(key).alias(f"_k{k}"), F.col(value).alias(f"_v{k}")), F.col(key) == F.col(f"_k{k}"), "left")
    found = [F.col(f"_v{k}") for k in range(len(sources))]
    no = F.coalesce(*[F.when(v.isNotNull(), F.lit(k)) for k, v in enumerate(found)])
    return out.select(*base.columns, F.coalesce(*found).alias(value), no.alias("source_no"))


def interval_join(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Rows of both sides with one key whose closed intervals [start, stop] overlap: left columns, right ones with r_.

    Intervals are spread over buckets of the given width, joined on key and bucket,
    and each pair is kept in the bucket where the later of them starts."""

    def spread(df: DataFrame) -> DataFrame:
        return df.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))))

    r = right.select(F.col(key), *[F.col(c).alias(f"r_{c}") for c in right.columns if c != key])
    r = r.withColumn("_b", F.explode(F.sequence(F.floor(F.col("r_start") / width), F.floor(F.col("r_stop") / width))))
    j = spread(left).join(r, [key, "_b"]).where("start <= r_stop and r_start <= stop")
    return j.where(F.floor(F.greatest("start", "r_start") / width) == F.col("_b")).drop("_b")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, out: str) -> DataFrame:
    """Each left row with the latest right value at or before its time; a union and one sort, no pairs."""
    a = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"))
    b = right.select(*[F.col(c) if c in (key, ts) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(value).alias("_v"), F.lit(0).alias("_side"))
    w = W.partitionBy(key).orderBy(ts, "_side").rowsBetween(W.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(out, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_v", "_side")


def two_of_three(df: DataFrame, item: str, rater: str, verdict: str) -> DataFrame:
    """(item, verdict, decided_by): what raters 1 and 2 agree on, else what rater 3 says."""
    p = df.groupBy(item).agg(*[F.max(F.when(F.col(rater) == k, F.col(verdict))).alias(f"v{k}") for k in (1, 2, 3)])
    same = F.col("v1") == F.col("v2")
    return p.select(item, F.when(same, F.col("v1")).otherwise(F.col("v3")).alias("verdict"), F.when(same, "raters").when(F.col("v3").isNotNull(), "third").alias("decided_by"))


def pivot_views(df: DataFrame, keys: list[str], view: str, value: str, views: list[str]) -> DataFrame:
    """One row per key with a column for every view."""
    return df.groupBy(*keys).pivot(view, views).agg(F.first(value, ignorenulls=True))


def _words(c: Column) -> Column:
    """Lower-case words: runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(c), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def glossary_hits(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, target, n): glossary terms by whole words, aliases counted for their target.

    Terms and texts are cut into words by one rule, and texts into runs of as many
    words as terms have (the driver gets these numbers); the runs are joined to the
    terms. A conflicting alias goes to the least target."""
    all_terms = terms.select("target", F.explode(F.array_union(F.array("source"), F.coalesce(F.col("aliases"), F.array().cast("array<string>")))).alias("t")).where("t is not null and target is not null")
    known = all_terms.select(_words(F.col("t")).alias("w"), "target").where(F.size("w") > 0).groupBy(F.concat_ws(" ", "w").alias("t"), F.size("w").alias("k")).agg(F.min("target").alias("target"))
    lengths = sorted(r["k"] for r in known.select("k").distinct().collect())
    base = texts.select(F.col(id_col).alias("id"), _words(F.col(text_col)).alias("w")).where(F.size("w") > 0)

    def runs(k: int) -> Column:
        all_runs = F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.concat_ws(" ", F.slice("w", i, k)))
        return F.when(F.size("w") >= k, F.col("w") if k == 1 else all_runs).otherwise(F.array().cast("array<string>"))

    each = base.select("id", F.explode(F.concat(F.array().cast("array<string>"), *[runs(k) for k in lengths])).alias("t"))
    return each.join(known.select("t", "target"), "t").groupBy("id", "target").agg(F.count("*").alias("n"))


def unique_url_targets(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(link_id, page_id): links resolved to the page with their URL, where exactly one has it."""
    one = pages.where("url is not null and url <> ''").groupBy("url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n")).where("n = 1")
    return links.join(one, "url").select("link_id", "page_id")
