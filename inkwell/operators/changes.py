"""Guarded incremental updates: change sets with expected hashes, upserts, refresh of cached rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def content_hash(*columns: str) -> Column:
    """sha256 of a row's columns in canonical JSON: keys sorted, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def apply_changes(base: DataFrame, changes: DataFrame, key: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """(result, report): base after a change set, and the outcome of every change.

    base: (key, payload); changes: (key, op_index, kind, expected, payload) with kind
    replace, append or delete. A replace or delete applies if the payload's sha256 is
    the expected one, an append if the key is new; an equal append is a repeat and
    changes nothing. Of several changes to one key only a single one is allowed: all of
    them are refused. Untargeted rows pass unchanged."""
    c = changes.select(F.col(key), "op_index", "kind", "expected", F.col(payload).alias("_new")).withColumn("_n", F.count("*").over(W.partitionBy(key)))
    j = c.join(base.select(F.col(key), F.col(payload).alias("_old"), F.lit(True).alias("_there")), key, "left")
    sha = F.sha2(F.col("_old"), 256)
    there = F.coalesce(F.col("_there"), F.lit(False))
    outcome = (
        F.when(F.col("_n") > 1, "refused: several changes")
        .when((F.col("kind") == "append") & there & F.col("_old").eqNullSafe(F.col("_new")), "repeated")
        .when((F.col("kind") == "append") & there, "refused: exists").when(F.col("kind") == "append", "appended")
        .when(~there, "refused: missing").when(~F.coalesce(sha == F.col("expected"), F.lit(False)), "refused: changed")
        .when(F.col("kind") == "replace", "replaced").when(F.col("kind") == "delete", "deleted").otherwise("refused: unknown kind")
    )
    report = j.select(key, "op_index", "kind", outcome.alias("outcome"), "_new")
    done = report.where("outcome in ('appended', 'replaced', 'deleted')")
    kept = base.join(done.where("outcome <> 'appended'").select(key), key, "left_anti").select(key, payload)
    fresh = done.where("outcome <> 'deleted'").select(key, F.col("_new").alias(payload))
    return kept.unionByName(fresh), report.drop("_new")


def upsert(base: DataFrame, fresh: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """base with fresh rows in place of those with their keys; of several fresh ones the first in order counts."""
    one = fresh.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
    return base.join(one.select(*keys), keys, "left_anti").unionByName(one.select(*base.columns))


def refresh_plan(cache: DataFrame, current: DataFrame, key: str, revision: str, observed: str) -> DataFrame:
    """(key, action): reuse, read or drop for every cached or current row.

    A cached row is reused only if its revision is the current one and was already
    closed when it was observed: in a later minute than the revision's own."""
    c = cache.select(F.col(key), F.col(revision).alias("_was"), F.col(observed).alias("_seen"), F.lit(True).alias("_cached"))
    n = current.select(F.col(key), F.col(revision).alias("_is"), F.lit(True).alias("_current"))
    j = c.join(n, key, "full")
    closed = F.date_trunc("minute", F.col("_seen")) > F.date_trunc("minute", F.col("_was"))
    action = F.when(F.col("_current").isNull(), "drop").when(F.col("_cached").isNotNull() & (F.col("_was") == F.col("_is")) & closed, "reuse").otherwise("read")
    return j.select(key, action.alias("action"))


def latest(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The last row of every key by time, ties by the greater tie column."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last(ts), F.desc(tie)))).where("_k = 1").drop("_k")


def missing(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Expected rows not done yet."""
    return expected.join(done.select(*keys).distinct(), keys, "left_anti")
