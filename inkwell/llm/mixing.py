"""Mixing sources to target weights.

Method: Poisson replication: invert a hash-seeded Poisson distribution with mean
target repetition rate, explode each document by its count, and shuffle
globally.

The total T is a parameter; by default the tokens of all listed sources. A
source with target share w and S tokens needs every document w T / S times on
average. Draws are cut at the source's cap m, so the Poisson mean is the one
whose cut draws have that average; where w T / S >= m every document is taken
m times and the target cannot be met. A draw depends on the document's id and
the seed alone, so it is the same in every run and on every executor."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from inkwell.functions.arrow import map_rows
from inkwell.llm.tokens import VOCABULARY, token_counts
from inkwell.session import cut

SEED = 17


@lru_cache(maxsize=256)
def poisson(rate: float) -> tuple[int, np.ndarray, np.ndarray]:
    """(least count, probabilities, their sums from below) of the counts whose probability is not below e^-100 or so.

    Reckoned from logarithms, so one way holds for every rate; what is left out is far less than the last digit of a draw."""
    wide = 15 * math.sqrt(rate) + 120
    low = max(0, math.floor(rate - wide))
    k = np.arange(low, math.ceil(rate + wide) + 1, dtype=np.float64)
    steps = np.log(rate) - np.log(np.maximum(k[1:], 1.0))
    logs = np.concatenate(([0.0], np.cumsum(steps))) + (low * math.log(rate) - rate - math.lgamma(low + 1))
    p = np.exp(logs)
    p /= p.sum()
    return low, p, np.cumsum(p)


def cut_mean(rate: float, cap: int | None) -> float:
    """Mean of min(X, cap), X Poisson with this rate."""
    if cap is None or rate <= 0:
        return max(0.0, rate)
    low, p, _ = poisson(rate)
    return float(np.minimum(np.arange(low, low + len(p)), cap) @ p)


def rate_for(mean: float, cap: int | None) -> float:
    """The Poisson rate whose draws, cut at cap, have this mean; infinite where the cap forbids it."""
    if cap is None or mean <= 0:
        return max(0.0, mean)
    if mean >= cap:
        return math.inf
    lo, hi = mean, max(1.0, mean)
    while cut_mean(hi, cap) < mean and hi < 8 * cap + 800:  # beyond that every draw is cut, to the last digit
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cut_mean(mid, cap) < mean else (lo, mid)
    return (lo + hi) / 2


def draw(doc_id: int, seed: int, rate: float, cap: int | None) -> int:
    """The count of a document: the inverse of the Poisson distribution at a number hashed from its id."""
    if rate == math.inf:
        return cap or 0
    if rate <= 0:
        return 0
    u = (xxhash.xxh3_64_intdigest(f"{seed}:{doc_id}".encode()) >> 11) / float(1 << 53)
    if u == 0:  # less than any probability, also those left out
        return 0
    low, p, below = poisson(rate)
    k = low + min(int(np.searchsorted(below, u, "right")), len(p) - 1)
    return k if cap is None else min(k, cap)


class _Draws:
    def __init__(self, seed: int) -> None:
        self.seed = seed

    def __call__(self, cols: dict[str, list]) -> Iterator[tuple]:
        for i, source, tokens, rate, cap in zip(cols["id"], cols["source"], cols["tokens"], cols["rate"], cols["cap"]):
            yield i, source, tokens, 0 if rate is None or i is None else draw(i, self.seed, rate, cap)


class _Rates:
    def __call__(self, cols: dict[str, list]) -> Iterator[tuple]:
        for source, share, cap, tokens, total in zip(cols["source"], cols["target_share"], cols["cap"], cols["tokens"], cols["total"]):
            mean = share * total / tokens if tokens and share is not None else 0.0
            yield source, rate_for(mean, cap), cap


def drawn(df: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, source, tokens, times) of every document: how often it is taken.

    Documents of no listed source, or of none, are taken 0 times and keep a null
    token count, as their size plays no part. Null and empty texts have 0
    tokens and are drawn like others of their source. Shares are taken in
    proportion to their sum."""
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.min(F.col("max_repeats").cast("int")).alias("cap"))
    share = t.agg(F.sum("target_share").alias("shares"))
    t = t.crossJoin(share).select("source", (F.col("target_share") / F.col("shares")).alias("target_share"), "cap")
    base = df.withColumn("_src", F.col(source_col))
    listed = base.join(F.broadcast(t.select(F.col("source").alias("_src"))), "_src", "left_semi")
    other = base.join(F.broadcast(t.select(F.col("source").alias("_src"))), "_src", "left_anti")
    counted = cut(token_counts(listed, id_col, text_col, {source_col: "string"}, vocabulary).toDF("id", "tokens", "source"))
    sizes = counted.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    whole = sizes.agg(F.coalesce(F.lit(total_tokens).cast("long"), F.sum("tokens")).alias("total"))
    rates = map_rows(t.join(sizes, "source", "left").crossJoin(whole), _Rates(), "source string, rate double, cap int")
    out = map_rows(counted.join(F.broadcast(rates), "source", "left"), _Draws(seed), "id long, source string, tokens long, times int")
    rest = other.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), F.lit(None).cast("long").alias("tokens"), F.lit(0).alias("times"))
    return out.unionByName(rest)


def shares_reached(times: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: target share, documents, tokens held and taken, share of all tokens taken, whether the cap forbids the target."""
    per = times.where("times >= 0 and tokens is not null").groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens_held"), F.sum(F.col("tokens") * F.col("times")).alias("tokens_taken"), F.sum("times").alias("copies"), F.max("times").alias("most"))
    whole = per.agg(F.sum("tokens_taken").alias("all_taken"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return targets.select("source", "target_share", "max_repeats").join(per, "source", "left").crossJoin(whole).select(
        "source", "target_share", "max_repeats", z("documents"), z("tokens_held"), z("copies"), z("tokens_taken"), F.coalesce(F.col("tokens_taken") / F.nullif(F.col("all_taken"), F.lit(0)), F.lit(0.0)).alias("share"),
        F.coalesce(F.col("copies") == F.col("documents") * F.col("max_repeats"), F.lit(False)).alias("exhausted"),
    )


def mixture(times: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixture itself: one row (position key, id, copy) per taken copy, in a global random order by hash."""
    copies = times.where("times > 0").select("id", "source", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    return copies.withColumn("order_key", F.xxhash64(F.lit(seed), "id", "copy")).repartitionByRange("order_key", "id", "copy").sortWithinPartitions("order_key", "id", "copy")
