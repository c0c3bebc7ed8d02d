"""Summaries of results: arms, pairwise outcomes, strata, policies, selections, changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from inkwell.operators.order import grouped_prefix, numbered
from inkwell.operators.statistics import draw_index


def equal_weight_means(df: DataFrame, arm: str, unit: str, score: str) -> DataFrame:
    """(arm, units, mean): means of the units' means, so that a unit counts once however many rows it has. Null scores are left out."""
    per = df.where(F.col(score).isNotNull()).groupBy(arm, unit).agg(F.avg(score).alias("_m"))
    return per.groupBy(arm).agg(F.count("*").alias("units"), F.avg("_m").alias("mean"))


def pairwise_outcomes(df: DataFrame, arm: str, unit: str, score: str) -> DataFrame:
    """(arm_a, arm_b, wins, ties, losses) over units that both arms have, by the units' mean scores. Arms are few; the join is on the unit."""
    per = df.where(F.col(score).isNotNull() & F.col(unit).isNotNull()).groupBy(arm, unit).agg(F.avg(score).alias("m"))
    a, b = per.toDF("arm_a", "_u", "_x"), per.toDF("arm_b", "_u", "_y")
    count = lambda c: F.sum(c.cast("long"))
    both = a.join(b, "_u").where("arm_a < arm_b")
    return both.groupBy("arm_a", "arm_b").agg(count(F.col("_x") > F.col("_y")).alias("wins"), count(F.col("_x") == F.col("_y")).alias("ties"), count(F.col("_x") < F.col("_y")).alias("losses"))


def arm_summary(df: DataFrame, by: list[str], outcome: str, lift: str) -> DataFrame:
    """Per arm: rows, pending (null outcome), share of successes, its bounds with all pending as failed and as passed, mean and median lift."""
    done, won = F.count(outcome), F.sum(F.coalesce(F.col(outcome).cast("long"), F.lit(0)))
    n = F.count("*")
    return df.groupBy(*by).agg(n.alias("rows"), (n - done).alias("pending"), (won / F.nullif(done, F.lit(0))).alias("share"), (won / n).alias("lower"), ((won + n - done) / n).alias("upper"), F.avg(lift).alias("mean_lift"), F.percentile(lift, 0.5).alias("median_lift"))


def shares_above(df: DataFrame, by: list[str], score: str, thresholds: list[float]) -> DataFrame:
    """(by, threshold, rows, share): share of the rows with a score that is at least the threshold. Null scores are left out."""
    each = df.where(F.col(score).isNotNull()).select(*by, score, F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    return each.groupBy(*by, "threshold").agg(F.count("*").alias("rows"), F.avg((F.col(score) >= F.col("threshold")).cast("double")).alias("share"))


def stratum_rates(calibration: DataFrame, rows: DataFrame, stratum: str, hit: str, cuts: tuple[float, ...] = (1 / 3, 2 / 3)) -> DataFrame:
    """(stratum, rows, hits, rate) of rows, strata between the quantiles of the calibration rows; a null stratum value is in none."""
    edges = calibration.agg(*[F.percentile(stratum, q).alias(f"_e{k}") for k, q in enumerate(cuts)])
    placed = rows.where(F.col(stratum).isNotNull()).crossJoin(F.broadcast(edges)).withColumn("_s", reduce(lambda x, y: x + y, [(F.col(stratum) > F.col(f"_e{k}")).cast("int") for k in range(len(cuts))]))
    return placed.groupBy(F.col("_s").alias("stratum")).agg(F.count("*").alias("rows"), F.sum(F.col(hit).cast("long")).alias("hits"), F.avg(F.col(hit).cast("double")).alias("rate"))


def policies(table: DataFrame, floors: list[float]) -> DataFrame:
    """(floor, threshold, sensitivity, specificity): of a threshold table the least threshold whose specificity reaches each floor; a floor that none reaches has no row."""
    each = table.withColumn("floor", F.explode(F.array(*[F.lit(float(f)) for f in floors]))).where("specificity >= floor")
    return each.groupBy("floor").agg(F.min_by(F.struct("threshold", "sensitivity", "specificity"), "threshold").alias("m")).select("floor", "m.threshold", "m.sensitivity", "m.specificity")


def group_minima(df: DataFrame, policy: DataFrame, group: str, score: str, truth: str) -> DataFrame:
    """(floor, groups, least_sensitivity, least_specificity) of a policy's thresholds over groups; groups without positives or negatives do not count for that side."""
    p = df.crossJoin(F.broadcast(policy.select("floor", "threshold"))).withColumn("_p", F.col(score) >= F.col("threshold"))
    per = p.groupBy("floor", group).agg(F.avg(F.when(F.col(truth) == 1, F.col("_p").cast("double"))).alias("s"), F.avg(F.when(F.col(truth) == 0, (~F.col("_p")).cast("double"))).alias("n"))
    return per.groupBy("floor").agg(F.count("*").alias("groups"), F.min("s").alias("least_sensitivity"), F.min("n").alias("least_specificity"))


def best_rows(df: DataFrame, by: list[str], order: list[Column], passing: Column | None = None) -> DataFrame:
    """The first row of every group among those that pass; groups where none does have none."""
    rows = df if passing is None else df.where(passing)
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def ranked_terms(df: DataFrame, by: str, term: str, count: str, title: str, limit: int) -> DataFrame:
    """(by, term, rank): per group terms of the title first, then by count times length, length and term; at most limit, which is the feature."""
    order = [F.col(title).contains(F.col(term)).desc(), (F.col(count) * F.length(term)).desc(), F.length(term).desc(), F.asc(term)]
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= limit).select(by, term, "rank")


def cue_scores(text: Column, cues: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """How often the cues of each scene stand in a text."""
    return {k: F.size(F.regexp_extract_all(text, F.lit("|".join(sorted(v, key=lambda w: (-len(w), w)))), F.lit(0))) for k, v in cues.items()}


def best_percentile(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, best, percentile): the column in which a row stands highest among all rows (share of rows with no more); ties go to the column named first.

    Percentiles are taken over distinct values, in one range-partitioned order over all columns."""
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(k).alias("_no"), F.col(c).cast("double").alias("_v")) for k, c in enumerate(columns)])).alias("_e")).select(key, "_e._no", "_e._v").where("_v is not null")
    per = long.groupBy("_no", "_v").agg(F.count("*").alias("_n"))
    whole = per.groupBy("_no").agg(F.sum("_n").alias("_all"))
    share = grouped_prefix(per, ["_no"], "_v", {"_n": "_b"}).join(F.broadcast(whole), "_no").select("_no", "_v", ((F.col("_b") + F.col("_n")) / F.col("_all")).alias("percentile"))
    names = F.array(*[F.lit(c) for c in columns])
    placed = long.join(share, ["_no", "_v"]).groupBy(key).agg(F.max(F.struct(F.col("percentile"), (-F.col("_no")).alias("_m"))).alias("b"))
    return placed.select(key, F.get(names, -F.col("b._m")).alias("best"), F.col("b.percentile").alias("percentile"))


def deltas(candidate: Column, baseline: Column) -> Column:
    """Key by key, candidate minus baseline of two maps; keys that one lacks are left out."""
    return F.map_filter(F.map_zip_with(candidate, baseline, lambda k, a, b: a - b), lambda k, v: v.isNotNull())


def map_similarity(left: Column, right: Column) -> Column:
    """1 / (1 + Euclidean distance) of two maps of numbers; a key that one lacks counts as 0 there."""
    squares = F.map_values(F.map_zip_with(left, right, lambda k, a, b: F.pow(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)), F.lit(2.0))))
    return 1 / (1 + F.sqrt(F.aggregate(squares, F.lit(0.0), lambda x, y: x + y)))


def busiest_window(df: DataFrame, by: str, order: str, change: str, width: int) -> DataFrame:
    """(by, first, total): per group the width consecutive rows with the greatest sum of changes, the earliest of ties; groups shorter than that are one window."""
    w = W.partitionBy(by).orderBy(order)
    rolled = df.select(by, order, F.sum(change).over(w.rowsBetween(0, width - 1)).alias("_s"), F.row_number().over(w).alias("_k"), F.count("*").over(W.partitionBy(by)).alias("_n"))
    full = rolled.where(F.col("_k") <= F.greatest(F.lit(1), F.col("_n") - width + 1))
    return full.groupBy(by).agg(F.max(F.struct(F.col("_s"), (-F.col("_k")).alias("_m"), F.col(order).alias("_o"))).alias("b")).select(by, F.col("b._o").alias("first"), F.col("b._s").alias("total"))


def without_features(weights: DataFrame, group: str, feature: str, weight: str, dropped: Column) -> DataFrame:
    """(group, feature, weight): the weights without the dropped features, made unit length again; a group that loses all has no row."""
    left = weights.where(~dropped)
    norm = left.groupBy(group).agg(F.sqrt(F.sum(F.col(weight) * F.col(weight))).alias("_n")).where("_n > 0")
    return left.join(norm, group).select(group, feature, (F.col(weight) / F.col("_n")).alias(weight))


def rate_bootstrap(df: DataFrame, cluster: str, hit: str, q: float = 0.05, resamples: int = 200, seed: int = 13) -> DataFrame:
    """(clusters, mean, lower, positive_lower): mean of the clusters' rates, the q point of its resampled means, and that of the share of clusters with a rate above 0.

    A cluster counts once, however many rows it has; draws are hashed from seed, resample and position."""
    per = df.where(F.col(cluster).isNotNull() & F.col(hit).isNotNull()).groupBy(cluster).agg(F.avg(F.col(hit).cast("double")).alias("_r"))
    clusters = numbered(per, cluster, "i").select("i", "_r")
    size = clusters.agg(F.count("*").alias("k"), F.avg("_r").alias("mean")).first()
    k = size["k"]
    draws = df.sparkSession.range(resamples * k).select((F.col("id") / F.lit(max(k, 1))).cast("long").alias("r"), (F.col("id") % F.lit(max(k, 1))).alias("p"))
    means = draws.select("r", draw_index(F.col("r"), F.col("p"), F.lit(k), seed).alias("i")).join(clusters, "i").groupBy("r").agg(F.avg("_r").alias("m"), F.avg((F.col("_r") > 0).cast("double")).alias("s"))
    return means.agg(F.percentile("m", q).alias("lower"), F.percentile("s", q).alias("positive_lower")).where(F.lit(k > 0)).select(F.lit(k).cast("long").alias("clusters"), F.lit(size["mean"]).alias("mean"), "lower", "positive_lower")


def confirmed_contrasts(discovery: DataFrame, validation: DataFrame, least_z: float, least_support: int) -> DataFrame:
    """(feature, z, validation_z): contrasts strong and frequent enough in discovery, of the same sign in validation."""
    v = validation.select("feature", F.col("z").alias("validation_z"))
    return discovery.where((F.abs("z") >= least_z) & (F.col("support") >= least_support)).join(v, "feature").where(F.signum("z") == F.signum("validation_z")).select("feature", "z", "validation_z")
