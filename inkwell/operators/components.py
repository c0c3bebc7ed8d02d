"""Connected components of links between keys.

Every partition reduces its links to a forest, which has fewer links than keys.
Forests are merged level by level in ever fewer partitions, as long as the links
that one task of the next level would get fit FOREST_EDGES; the count is taken
anew at every level, as forests shrink. Links that still do not fit one task go
by rounds that hook every key to its least neighbour, spread over all
partitions. Both ways give the same roots."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkwell.functions.arrow import arrow_schema, as_batch
from inkwell.session import cut

#: Links that one task may merge.
FOREST_EDGES = 2_000_000
_DDL = "u long, v long"


class _Forest:
    """Links in, spanning links (key, least key of its local tree) out."""

    def __init__(self) -> None:
        self.schema = arrow_schema(_DDL)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (p := up.get(root, root)) != root:
                root = p
            while (p := up.get(x, x)) != root:
                up[x], x = root, p
            return root

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a, c = find(u), find(v)
                if a != c:
                    up[max(a, c)] = min(a, c)
        keys = list(up)
        for lo in range(0, len(keys), 50_000):
            rows = [(k, r) for k in keys[lo : lo + 50_000] if (r := find(k)) != k]
            if rows:
                yield as_batch(rows, self.schema, 2)


def _merged(forest: DataFrame, forest_edges: int, fan_in: int) -> tuple[DataFrame, bool]:
    """The forest after all levels that fit, and whether it is one tree of merges."""
    parts = max(1, forest.rdd.getNumPartitions())
    while parts > 1:
        after = max(1, parts // fan_in)
        if forest.count() > forest_edges * after:
            return forest, False
        parts = after
        forest = cut(forest.repartition(parts, "v").mapInArrow(_Forest(), _DDL))
    return forest, True


def _hooked(forest: DataFrame) -> DataFrame:
    """Rounds of hooking every key, and every key's neighbours, to the least of them, until nothing changes."""
    swapped = lambda d: d.select(F.col("v").alias("u"), F.col("u").alias("v"))
    while True:
        both = forest.union(swapped(forest))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.union(swapped(large)).where("v <= u")
        least = small.groupBy("u").agg(F.min("v").alias("m"))
        after = cut(small.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        if after.exceptAll(forest).isEmpty() and forest.exceptAll(after).isEmpty():
            return after
        forest = after


def components(links: DataFrame, forest_edges: int = FOREST_EDGES, fan_in: int = 8) -> DataFrame:
    """(key, root) for every key in links(u, v); root is the least key of the component. No links give no rows."""
    forest, whole = _merged(cut(links.mapInArrow(_Forest(), _DDL)), forest_edges, fan_in)
    if not whole:
        forest = _hooked(forest)
    roots = forest.select(F.col("u").alias("key"), F.col("v").alias("root"))
    return roots.union(forest.select("v").distinct().select(F.col("v").alias("key"), F.col("v").alias("root")))
