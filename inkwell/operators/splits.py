"""Splits, deterministic picks and reservations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from inkwell.functions import text as X


def book_units(records: DataFrame) -> DataFrame:
    """(author, title, units) per book; rows without author or title belong to no book."""
    return records.where("author is not null and title is not null").groupBy("author", "title").agg(F.sum("chunk_clean_units").alias("units"))


def split_books(books: DataFrame, target: str | None = None) -> DataFrame:
    """(author, title, units, role): books ranked by size, then title, within their author.

    Largest to test, next to dev, rest to train; authors with fewer than three
    books are excluded. The target author gives a tenth, at least one and at
    most four, to test and to dev, and with twelve books or more also to
    proxy_transfer (at least two), before train."""
    w = W.partitionBy("author")
    r = books.withColumn("k", F.row_number().over(w.orderBy(F.desc("units"), "title"))).withColumn("n", F.count("*").over(w))
    role = F.when(F.col("n") < 3, "excluded").when(F.col("k") == 1, "test").when(F.col("k") == 2, "dev").otherwise("train")
    if target is not None:
        tenth = F.floor(F.col("n") / 10)
        some = F.when(F.col("n") >= 5, F.least(F.lit(4), F.greatest(F.lit(1), tenth))).otherwise(1)
        proxy = F.when(F.col("n") >= 12, F.least(F.lit(4), F.greatest(F.lit(2), tenth))).otherwise(0)
        mine = F.when(F.col("k") <= proxy, "proxy_transfer").when(F.col("k") <= proxy + some, "test").when(F.col("k") <= proxy + some + some, "dev").otherwise("train")
        role = F.when(F.col("author") == target, mine).otherwise(role)
    return r.select("author", "title", "units", role.alias("role"))


def keep_roles(now: DataFrame, before: DataFrame) -> DataFrame:
    """Earlier roles stay: a book that was placed keeps its role while it is eligible, a new book is never promoted beyond train."""
    b = before.select("author", "title", F.col("role").alias("was"))
    role = F.when(F.col("role") == "excluded", "excluded").when(F.col("was").isNull(), F.when(F.col("role") == "train", "train").otherwise("excluded")).otherwise(F.col("was"))
    return now.join(b, ["author", "title"], "left").select("author", "title", "units", role.alias("role"))


def first_by_hash(df: DataFrame, keys: list[str], id_col: str, salt: str, n: int = 1) -> DataFrame:
    """The n rows of every group with the least salted hash of their id; ties by id."""
    w = W.partitionBy(*keys).orderBy(X.salted(id_col, salt), id_col)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def side_order(pair: Column, rater: str, seed: int) -> Column:
    """style_first or control_first, by the parity of the first byte of a hash."""
    byte = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:{rater}:"), pair.cast("string")), 256), 1, 2), 16, 10).cast("int")
    return F.when(byte % 2 == 0, "style_first").otherwise("control_first")


def spaced(df: DataFrame, keys: list[str], index: str, taken: DataFrame, distance: int) -> DataFrame:
    """Rows whose index is farther than distance from every taken row of their group.

    Taken rows are spread to the indexes they block, so the join is on equality."""
    blocked = taken.select(*keys, F.explode(F.sequence(F.col(index) - distance, F.col(index) + distance)).alias(index)).distinct()
    return df.join(blocked, [*keys, index], "left_anti")


def round_robin(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """n rows taken in turn from the groups: first of each, then second of each, and so on."""
    ranked = df.withColumn("_turn", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    return ranked.orderBy("_turn", group).limit(n).drop("_turn")


def williams_square(n: int) -> list[list[int]]:
    """Rows of a balanced Latin square of n treatments; for odd n followed by its mirror."""
    seq = [0]
    lo, hi = 1, n - 1
    for k in range(1, n):
        seq.append(lo if k % 2 else hi)
        lo, hi = (lo + 1, hi) if k % 2 else (lo, hi - 1)
    rows = [[(x + r) % n for x in seq] for r in range(n)]
    return rows if n % 2 == 0 else rows + [row[::-1] for row in rows]


def diverse(rows: list[dict], n: int, strata: list[str], group: str, index: str, distance: int, salt: str) -> list[dict]:
    """n rows chosen one by one: the least used strata first, then by salted hash of the id; rows of a group within distance of a chosen one are out.

    For a bounded list of candidates, such as the first of every stratum by hash."""
    import hashlib
    from collections import Counter

    order = sorted(rows, key=lambda r: (hashlib.sha256(f"{salt}:{r['id']}".encode()).hexdigest(), str(r["id"])))
    used: Counter = Counter()
    taken: list[dict] = []
    while len(taken) < n:
        free = [r for r in order if not any(r[group] == t[group] and abs(r[index] - t[index]) <= distance for t in taken)]
        if not free:
            break
        best = min(free, key=lambda r: sum(used[s, r[s]] for s in strata))
        taken.append(best)
        used.update((s, best[s]) for s in strata)
    return taken
