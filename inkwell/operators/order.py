"""Global order without one task that holds all rows.

Rows are range-partitioned by the order columns and written once with their
partition; only the partitions' sums, as many as there are partitions, are put
together in one place. Equal values fall into one partition, so the order
should be distinct (aggregate first), and nulls left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from inkwell.session import cut

Order = str | list[str | Column]


def _keys(order: Order, descending: bool) -> list[Column]:
    named = [order] if isinstance(order, str) else order
    return [(F.desc(c) if descending else F.asc(c)) if isinstance(c, str) else c for c in named]


def with_prefix(df: DataFrame, order: Order, values: dict[str, str], descending: bool = False) -> DataFrame:
    """df with, for every value column named, its sum over all rows before this one: values maps column -> new column."""
    keys = _keys(order, descending)
    d = cut(df.repartitionByRange(*keys).withColumn("_pid", F.spark_partition_id()))
    sums = d.groupBy("_pid").agg(*[F.sum(v).alias(f"_s_{o}") for v, o in values.items()])
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(F.col("_pid").alias("_p"), *[F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in values.values()])
    inside = W.partitionBy("_pid").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    out = d.join(F.broadcast(base), F.col("_pid") == F.col("_p"))
    for v, o in values.items():
        out = out.withColumn(o, F.col(f"_b_{o}") + F.coalesce(F.sum(v).over(inside), F.lit(0)))
    return out.select(*df.columns, *values.values())


def with_least(df: DataFrame, order: Order, value: str, out: str, descending: bool = False) -> DataFrame:
    """df with the least value of this row and all rows before it."""
    keys = _keys(order, descending)
    d = cut(df.repartitionByRange(*keys).withColumn("_pid", F.spark_partition_id()))
    least = d.groupBy("_pid").agg(F.min(value).alias("_l"))
    base = least.select(F.col("_pid").alias("_p"), F.min("_l").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)).alias("_least"))
    inside = W.partitionBy("_pid").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)
    joined = d.join(F.broadcast(base), F.col("_pid") == F.col("_p"))
    return joined.withColumn(out, F.least("_least", F.min(value).over(inside))).select(*df.columns, out)


def numbered(df: DataFrame, order: Order, out: str = "no") -> DataFrame:
    """df with the number of every row, from 0, in a distinct order."""
    return with_prefix(df.withColumn("_one", F.lit(1).cast("long")), order, {"_one": out}).drop("_one")


def grouped_prefix(df: DataFrame, by: list[str], value: str, values: dict[str, str]) -> DataFrame:
    """df with the sums over the rows of its group before it, in the order of a column that is distinct within the group; a group may span tasks."""
    if not by:
        return with_prefix(df, value, values)
    run = with_prefix(df, [*by, value], {v: f"_r_{o}" for v, o in values.items()})
    first = run.groupBy(*by).agg(*[F.min(f"_r_{o}").alias(f"_f_{o}") for o in values.values()]).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], *[f"_f_{o}" for o in values.values()])
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    return run.join(first, same).select(*df.columns, *[(F.col(f"_r_{o}") - F.col(f"_f_{o}")).alias(o) for o in values.values()])
