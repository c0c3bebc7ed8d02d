"""Statistics over rows: ranks, correlation, intervals, resampling, multiple testing.

Resampling draws are hashed from (seed, resample, position), so they are the same
in every run, need no driver loop, and can be said in SQL. A resample is a row
set of draws joined to the clusters' sums, not to their rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from inkwell.operators.order import grouped_prefix, numbered, with_least, with_prefix
from inkwell.session import cut


def wilson(successes: Column, total: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval; null where the total is 0."""
    n = F.nullif(total.cast("double"), F.lit(0.0))
    p = successes / n
    d = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def average_ranks(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Ranks from 1, ties at their mean. Nulls have none. Ranked over distinct values, so ties cost nothing."""
    by = by or []
    per = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    placed = grouped_prefix(per, by, value, {"_n": "_b"})
    ranks = placed.select(*by, value, (F.col("_b") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, [*by, value], "left")


def spearman(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Rank correlation of two columns over rows with both; null where one is constant."""
    by = by or []
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, a, b)
    r = average_ranks(average_ranks(both, a, "_ra", by), b, "_rb", by)
    rho = F.covar_pop("_ra", "_rb") / F.nullif(F.stddev_pop("_ra") * F.stddev_pop("_rb"), F.lit(0.0))
    return r.groupBy(*by).agg(rho.alias("rho"), F.count("*").alias("n"))


def nearest_rank(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """The value at rank ceil(q n), at least the first. Nulls are left out. Ranked over distinct values, a group over many tasks."""
    per = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    placed = grouped_prefix(per, by, value, {"_n": "_b"})
    whole = per.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.sum("_n") * q)).alias("_at")).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_at")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    return placed.join(whole, same).where("_b < _at and _at <= _b + _n").select(*by, F.col(value).alias("value"))


def draw_index(resample: Column, position: Column, n: Column, seed: int) -> Column:
    """A number from 0 to n - 1 hashed from seed, resample and position."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), resample.cast("string"), position.cast("string"))), 1, 8), 16, 10).cast("long")
    return h % n


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, resamples: int = 200, seed: int = 13) -> DataFrame:
    """Mean of value and the 2.5 % and 97.5 % points of its means over resampled clusters.

    Null values and clusters are left out. Clusters are numbered once; each resample
    joins its draws to the clusters' sums."""
    per = df.where(F.col(value).isNotNull() & F.col(cluster).isNotNull()).groupBy(cluster).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    clusters = numbered(cut(per), cluster, "i")
    size = clusters.agg(F.count("*").alias("k"), (F.sum("s") / F.sum("n")).alias("mean")).first()
    k = size["k"]
    draws = df.sparkSession.range(resamples * k).select((F.col("id") / F.lit(max(k, 1))).cast("long").alias("r"), (F.col("id") % F.lit(max(k, 1))).alias("p"))
    picked = draws.select("r", draw_index(F.col("r"), F.col("p"), F.lit(k), seed).alias("i")).join(clusters, "i")
    means = picked.groupBy("r").agg((F.sum("s") / F.sum("n")).alias("m"))
    ends = means.agg(F.percentile("m", 0.025).alias("lower"), F.percentile("m", 0.975).alias("upper"), F.count("*").alias("resamples"))
    return ends.where(F.lit(k > 0)).select(F.lit(size["mean"]).alias("mean"), "lower", "upper", "resamples", F.lit(k).cast("long").alias("clusters"))


#: Rows whose order within a relabelling one task settles.
_SETTLED = 10_000


def permutation_test(df: DataFrame, group: str, value: str, permutations: int = 200, seed: int = 13) -> DataFrame:
    """Difference of the two groups' means, and the share of relabellings, hashed per row, with one as large (plus one).

    df: (id, group, value) with group 0 or 1. In each relabelling the rows with
    the least hashes are the group: hashes are summed by their first digits, and
    only the rows of the one prefix at the border are put in order."""
    base = cut(df.select("id", F.col(group).cast("int").alias("g"), F.col(value).cast("double").alias("v")).where("v is not null and g is not null"))
    size = base.agg(F.count("*").alias("n"), F.sum("g").alias("ones"), F.sum("v").alias("s"), (F.avg(F.when(F.col("g") == 1, F.col("v"))) - F.avg(F.when(F.col("g") == 0, F.col("v")))).alias("observed")).first()
    n, ones, digits = size["n"], size["ones"] or 0, 1
    while 16**digits * _SETTLED < size["n"]:
        digits += 1
    each = df.sparkSession.range(permutations).withColumnRenamed("id", "r")
    shuffled = base.select("id", "v").withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(permutations - 1).cast("long")))).withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), "r", "id"))).withColumn("b", F.substring("h", 1, digits))
    per = shuffled.groupBy("r", "b").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    per = cut(per.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("r").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    inside = per.where(F.col("before") + F.col("n") <= ones).groupBy("r").agg(F.sum("s").alias("s"))
    border = per.where((F.col("before") < ones) & (F.col("before") + F.col("n") > ones)).select("r", "b", "before")
    rest = shuffled.join(F.broadcast(border), ["r", "b"]).withColumn("k", F.row_number().over(W.partitionBy("r", "b").orderBy("h", "id")) + F.col("before")).where(F.col("k") <= ones).groupBy("r").agg(F.sum("v").alias("s"))
    sums = each.join(inside.unionByName(rest), "r", "left").groupBy("r").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s1"))
    d = sums.select(F.when(F.lit(0 < ones < n), F.col("s1") / F.lit(float(ones or 1)) - (F.lit(size["s"]) - F.col("s1")) / F.lit(float(max(1, n - ones)))).alias("d"))
    seen = F.lit(size["observed"]).cast("double")
    return d.agg(F.max(seen).alias("observed"), ((F.sum((F.abs("d") >= F.abs(seen) - 1e-12).cast("long")) + 1) / (F.count("*") + 1)).alias("p"), F.count("*").alias("permutations")).where(F.lit(n > 0))


def benjamini_hochberg(df: DataFrame, p: str, out: str = "q") -> DataFrame:
    """Adjusted p-values: running minimum from the largest of p m / rank. A null p has a null q and does not count."""
    per = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("_n"))
    ranked = with_prefix(per, p, {"_n": "_b"})
    m = per.agg(F.sum("_n").alias("_m"))
    scaled = ranked.crossJoin(F.broadcast(m)).withColumn("_x", F.least(F.lit(1.0), F.col(p) * F.col("_m") / (F.col("_b") + F.col("_n"))))
    return df.join(with_least(scaled, p, "_x", out, descending=True).select(p, out), p, "left").select(*df.columns, out)


def logit(score: Column, eps: float = 1e-6) -> Column:
    s = F.least(F.greatest(score, F.lit(eps)), F.lit(1 - eps))
    return F.log(s / (1 - s))


def stable_seed(seed: int, value: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.sha256(f"{seed}:{value}".encode()).digest()[:8], "big")


def wilson_lower(successes: int, total: int, z: float = 1.96) -> float:
    if total <= 0:
        return 0.0
    p, d = successes / total, 1 + z * z / total
    return (p + z * z / (2 * total) - z * math.sqrt(p * (1 - p) / total + z * z / (4 * total * total))) / d


def paired_difference(df: DataFrame, cluster: str, a: str, b: str, resamples: int = 200, seed: int = 13) -> DataFrame:
    """Mean of a - b over rows with both, its bootstrap interval over clusters, and the table of agreement of two binary outcomes."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(cluster), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    boot = cluster_bootstrap(both.withColumn("d", F.col("a") - F.col("b")), cluster, "d", resamples, seed)
    n = lambda x, y: F.sum(((F.col("a") == x) & (F.col("b") == y)).cast("long"))
    return boot.crossJoin(both.agg(n(1, 1).alias("both"), n(1, 0).alias("only_a"), n(0, 1).alias("only_b"), n(0, 0).alias("neither")))


def freedman_lane(outcome, reduced, added, permutations: int = 999, seed: int = 13) -> tuple[float, float]:
    """Partial R2 of the added design given the reduced one, and its permutation p: residuals of the reduced fit are permuted.

    For per-group summaries, which are few; arrays of floats."""
    import numpy as np

    y, x = np.asarray(outcome, float), np.asarray(reduced, float)
    full = np.column_stack([x, np.asarray(added, float)])

    def rss(m, v) -> float:
        return float(((v - m @ np.linalg.lstsq(m, v, rcond=None)[0]) ** 2).sum())

    fitted = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    residual = y - fitted
    effect = lambda v: 1 - rss(full, v) / max(rss(x, v), 1e-300)
    seen = effect(y)
    rng = np.random.default_rng(seed)
    as_large = sum(effect(fitted + rng.permutation(residual)) >= seen - 1e-12 for _ in range(permutations))
    return seen, (as_large + 1) / (permutations + 1)
