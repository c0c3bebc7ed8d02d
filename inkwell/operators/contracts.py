"""Checks of tables against what they must hold. Each returns the rows that break the rule; a kept rule gives none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def misaligned(df: DataFrame, view: str, keys: list[str], attributes: list[str]) -> DataFrame:
    """(keys, views, missing, differing): rows that not every view has, or for which views differ in an attribute.

    One aggregation over all views; views are counted once."""
    views = df.agg(F.countDistinct(view).alias("all_views"))
    per = df.where(F.col(view).isNotNull()).groupBy(*keys).agg(F.countDistinct(view).alias("views"), *[F.countDistinct(F.coalesce(F.col(a).cast("string"), F.lit("\0"))).alias(f"_{a}") for a in attributes])
    differing = F.filter(F.array(*[F.when(F.col(f"_{a}") > 1, F.lit(a)) for a in attributes]), lambda x: x.isNotNull())
    return per.crossJoin(F.broadcast(views)).select(*keys, "views", (F.col("all_views") - F.col("views")).alias("missing"), F.array_join(differing, ",").alias("differing")).where("missing > 0 or differing <> ''")


def one_sided(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): key values that only one of the two tables has; nulls count as a value."""
    a, b = left.select(*keys).distinct().withColumn("_a", F.lit(True)), right.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "full_outer")
    return both.where("_a is null or _b is null").select(*[F.when(F.col("_a").isNull(), F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in keys], F.when(F.col("_a").isNull(), "right").otherwise("left").alias("side"))


def disagreements(tables: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """(key, one column per table): keys whose value is missing in a table or not the same in all. Of repeated keys the least value counts."""
    per = [t.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(name)) for name, t in tables.items()]
    joined = reduce(lambda x, y: x.join(y, key, "full_outer"), per)
    names = list(tables)
    same = reduce(lambda x, y: x & y, [F.coalesce(F.col(names[0]) == F.col(n), F.lit(False)) for n in names])
    return joined.where(~same)


def uncovered(df: DataFrame, by: list[str], index: str) -> DataFrame:
    """(by, least, most, rows, missing, repeated): groups whose numbers do not run through from the least, each once. Null numbers are left out."""
    g = df.where(F.col(index).isNotNull()).groupBy(*by).agg(F.min(index).alias("least"), F.max(index).alias("most"), F.count("*").alias("rows"), F.countDistinct(index).alias("_n"))
    return g.select(*by, "least", "most", "rows", (F.col("most") - F.col("least") + 1 - F.col("_n")).alias("missing"), (F.col("rows") - F.col("_n")).alias("repeated")).where("missing > 0 or repeated > 0")


def exposed(df: DataFrame, key: str, tests: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """(key, reason): rows whose column is among the values of a table, for any of the tests (reason, column, table of one column)."""
    found = []
    for reason, column, values in tests:
        v = values.toDF("_v").where("_v is not null").distinct()
        found.append(df.join(v, F.col(column) == F.col("_v"), "left_semi").select(key, F.lit(reason).alias("reason")))
    return reduce(DataFrame.unionByName, found).distinct()


def unexpected_features(df: DataFrame, feature: str, prefixes: list[str]) -> DataFrame:
    """(feature, rows): features that begin with none of the prefixes."""
    known = reduce(lambda x, y: x | y, [F.col(feature).startswith(p) for p in prefixes], F.lit(False))
    return df.where(F.col(feature).isNotNull() & ~known).groupBy(feature).agg(F.count("*").alias("rows"))


def introduced_grams(candidates: DataFrame, references: DataFrame, inputs: DataFrame, key: str, text: str, n: int = 8) -> DataFrame:
    """(key, gram): runs of n characters of a candidate that some reference has and its own input has not.

    Grams are compared without white space; references are joined by gram, the input by key and gram."""
    def cut_up(df: DataFrame, *keep: Column | str) -> DataFrame:
        s = F.regexp_replace(text, "\\s+", "")
        return df.where(F.length(s) >= n).select(*keep, F.explode(F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, F.lit(n)))).alias("gram")).distinct()

    return cut_up(candidates, key).join(cut_up(references), "gram", "left_semi").join(cut_up(inputs, key), [key, "gram"], "left_anti").select(key, "gram")


def lost_terms(df: DataFrame, terms: DataFrame, key: str, before: str, after: str, term: str) -> DataFrame:
    """(key, term): terms that the text before holds and the text after does not. A null text holds nothing.

    terms must be a short list, as a glossary is: it is joined by containment."""
    return df.join(F.broadcast(terms.select(term).where(F.length(term) > 0).distinct()), F.col(before).contains(F.col(term)) & ~F.coalesce(F.col(after).contains(F.col(term)), F.lit(False))).select(key, term)


def repeated_openings(df: DataFrame, by: str, order: str, lines: str) -> DataFrame:
    """(by, order, same, share, prefix): per later member of a group how many of the first member's distinct lines it has too, their share, and how many lines at the start are the same.

    Null and empty lists, and groups of one, have no row."""
    filled = F.filter(lines, lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
    base = df.where(F.col(by).isNotNull() & (F.size(filled) > 0)).select(by, order, filled.alias("_l"))
    first = base.groupBy(by).agg(F.min_by("_l", order).alias("_f"), F.min(order).alias("_o"))
    both = base.join(first, by).where(F.col(order) > F.col("_o"))
    same = F.size(F.array_intersect("_l", "_f"))
    k = F.least(F.size("_l"), F.size("_f"))
    apart = F.filter(F.zip_with(F.slice("_l", 1, k), F.slice("_f", 1, k), lambda a, b: a == b), lambda x: x.isNotNull())
    prefix = F.coalesce(F.nullif(F.array_position(apart, F.lit(False)), F.lit(0)) - 1, k.cast("long"))
    return both.select(by, order, same.cast("long").alias("same"), (same / F.size(F.array_distinct("_f"))).alias("share"), prefix.alias("prefix"))


def blank_gaps(df: DataFrame, key: str, lines: str) -> DataFrame:
    """(key, pos, blanks): non-blank lines followed, behind blank or null ones only, by another non-blank line."""
    each = df.select(key, F.posexplode(lines).alias("pos", "_l")).where(F.coalesce(F.trim("_l") != "", F.lit(False)))
    after = each.withColumn("_n", F.lead("pos").over(W.partitionBy(key).orderBy("pos")))
    return after.where(F.col("_n") - F.col("pos") > 1).select(key, F.col("pos").cast("long").alias("pos"), (F.col("_n") - F.col("pos") - 1).cast("long").alias("blanks"))
