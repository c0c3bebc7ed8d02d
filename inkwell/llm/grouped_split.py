"""Splits that keep related records together.

Method: distributed union-find with local forests merged hierarchically, then
greedy largest-first assignment of groups to the split furthest below target.

A record ties its persons and its title. Only distinct (author, title) pairs
are looked at, and each gives a star of links between hashed keys, whose
components `operators.components` finds: local forests merged level by level,
and rounds over all partitions for what no single task can hold.

Groups of one size are interchangeable for the greedy rule, so it runs over
the sizes, of which there are at most about sqrt(2 x records); groups of one
size are then numbered in salted buckets, and no group list is ever in one task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction

import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from inkwell.functions.arrow import map_rows
from inkwell.functions.textform import consistent
from inkwell.operators.components import components
from inkwell.session import cut

SHARES = {"train": 0.8, "dev": 0.1, "test": 0.1}
#: Groups that one task numbers, and authors of a group that one task pairs: what is larger is salted.
NUMBERED, PAIRED = 100_000, 1_000

_SPLIT_PERSONS = re.compile("[、，/&]")
_SPACE = re.compile(r"\s+")


def person_keys(author: str | None) -> list[str]:
    """Comparable names of the persons in an author field; null or blank names none."""
    if author is None:
        return []
    names = (_SPACE.sub("", p).casefold() for p in _SPLIT_PERSONS.split(consistent(author)))
    return sorted({n for n in names if n})


def title_key(title: str | None) -> str | None:
    """Comparable title: consistent form, no white space, no case, no enclosing 《》; null or blank has none."""
    if title is None:
        return None
    t = _SPACE.sub("", consistent(title)).casefold()
    while len(t) > 2 and t[0] == "《" and t[-1] == "》":
        t = t[1:-1]
    return t or None


def _node(kind: str, key: str) -> int:
    x = xxhash.xxh3_64_intdigest((kind + key).encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >= 1 << 63 else x


def _nodes(cols: dict[str, list]) -> Iterator[tuple]:
    for a, t in zip(cols["author"], cols["title"]):
        nodes = [_node("p:", p) for p in person_keys(a)]
        if (k := title_key(t)) is not None:
            nodes.append(_node("t:", k))
        yield a, t, nodes


def pair_groups(records: DataFrame) -> DataFrame:
    """(author, title, root) of the distinct pairs; root null where both are null or blank."""
    pairs = cut(map_rows(records.select("author", "title").distinct(), _nodes, "author string, title string, nodes array<long>"))
    links = pairs.where(F.size("nodes") > 0).select(F.col("nodes")[0].alias("v"), F.explode("nodes").alias("u")).select("u", "v").distinct()
    comp = components(links.where("u <> v"))
    firsts = pairs.select("author", "title", F.try_element_at("nodes", F.lit(1)).alias("key"))
    return firsts.join(comp, "key", "left").select("author", "title", F.coalesce("root", "key").alias("root"))


def author_groups(records: DataFrame) -> DataFrame:
    """(author, group) of every stored author value but null and blank ones: two values of one group must share a split."""
    return pair_groups(records).where("author is not null and root is not null").select("author", F.col("root").alias("group")).distinct()


def tied_authors(records: DataFrame) -> DataFrame:
    """Every two different stored authors (author_a < author_b by code point) whose records must share a split.

    A large group is dealt over as many tasks as its size asks for: one side by
    salt, the other copied to every salt. `author_groups` says the same in one row per author."""
    who = cut(author_groups(records))
    salts = who.groupBy("group").agg(F.ceil(F.count("*") / PAIRED).alias("salts")).where("salts >= 1")
    salted = who.join(salts, "group")
    a = salted.select("group", F.col("author").alias("author_a"), F.pmod(F.xxhash64("author"), F.col("salts")).alias("salt"))
    b = salted.select("group", F.col("author").alias("author_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    return a.join(b, ["group", "salt"]).where("author_a < author_b").select("author_a", "author_b")


def greedy_by_size(sizes: list[tuple[int, int]], shares: dict[str, float]) -> list[tuple[int, str, int, int]]:
    """Largest first, each group to the split furthest below its target.

    sizes: (size, groups). Returns (size, split, first, last) where groups of a
    size are numbered from 0 and the numbers first..last-1 go to split. Ties go
    to the split named first. Groups of one size are dealt in steps that give
    every split as many of them as dealing them singly: a run to the split that
    stays furthest below, and, once all splits are less than one group apart,
    whole rounds of one to each, which change nothing but the level. Reckoned in fractions."""
    names = list(shares)
    total = sum(s * c for s, c in sizes)
    below = [Fraction(shares[n]) * total for n in names]
    out: list[tuple[int, str, int, int]] = []
    for size, count in sorted(sizes, reverse=True):
        at = 0
        while at < count:
            order = sorted(range(len(names)), key=lambda i: (-below[i], i))
            first = order[0]
            rounds = (count - at) // len(names)
            if size and rounds and max(below) - min(below) < size:
                for i in order:
                    out.append((size, names[i], at, at + rounds))
                    below[i] -= rounds * size
                    at += rounds
                continue
            steps = max(1, int((below[first] - below[order[1]]) // size)) if size and len(order) > 1 else count - at
            run = min(count - at, steps)
            out.append((size, names[first], at, at + run))
            below[first] -= run * size
            at += run
    return out


class _Greedy:
    def __init__(self, shares: dict[str, float]) -> None:
        self.shares = shares

    def __call__(self, cols: dict[str, list]) -> Iterator[tuple]:
        for sizes in cols["sizes"]:
            yield from greedy_by_size([(s["size"], s["groups"]) for s in sizes], self.shares)


def split_records(records: DataFrame, shares: dict[str, float] | None = None, id_col: str = "chunk_id") -> DataFrame:
    """One split per row of records: its columns id_col, author, title, and group, split.

    A row without author and title is a group of its own id; repeated rows
    share their group. A null id without author and title is the group of the
    null id. Shares need not sum to 1; they are taken in proportion."""
    shares = shares or SHARES
    whole = sum(shares.values())
    shares = {k: v / whole for k, v in shares.items()}
    groups = pair_groups(records)
    keyed = records.select(F.col(id_col), "author", "title").join(
        groups.select(F.col("author").alias("ga"), F.col("title").alias("gt"), "root"), F.col("author").eqNullSafe(F.col("ga")) & F.col("title").eqNullSafe(F.col("gt")), "left"
    )
    keyed = keyed.select(id_col, "author", "title", F.coalesce(F.concat(F.lit("g"), F.col("root").cast("string")), F.concat(F.lit("r"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("group"))
    sized = cut(keyed.groupBy("group").agg(F.count("*").alias("size")))
    buckets = max(1, math.ceil(sized.count() / NUMBERED))
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)))
    counts = sized.groupBy("size").agg(F.count("*").alias("groups"))
    plan = map_rows(counts.groupBy().agg(F.collect_list(F.struct("size", "groups")).alias("sizes")), _Greedy(shares), "size long, split string, first long, last long")
    before = sized.groupBy("size", "bucket").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(W.partitionBy("size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    numbered = sized.withColumn("k", F.row_number().over(W.partitionBy("size", "bucket").orderBy(F.xxhash64("group"), "group")) - 1)
    ranked = numbered.join(before.select("size", "bucket", "base"), ["size", "bucket"]).select("group", "size", (F.col("k") + F.coalesce("base", F.lit(0))).alias("no"))
    placed = ranked.join(plan, "size").where("no >= first and no < last").select("group", "split")
    return keyed.join(placed, "group").select(id_col, "author", "title", "group", "split")


def shares_reached(split: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """Per split: target share, records, groups and the share reached."""
    shares = shares or SHARES
    spark = split.sparkSession
    want = spark.createDataFrame([(k, float(v)) for k, v in shares.items()], T.StructType([T.StructField("split", T.StringType()), T.StructField("target_share", T.DoubleType())]))
    got = split.groupBy("split").agg(F.count("*").alias("records"), F.countDistinct("group").alias("groups"))
    total = split.agg(F.count("*").alias("total"))
    return want.join(got, "split", "left").crossJoin(total).select(
        "split", "target_share", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("groups", F.lit(0)).alias("groups"), (F.coalesce("records", F.lit(0)) / F.greatest("total", F.lit(1))).alias("share")
    )
