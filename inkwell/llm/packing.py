"""Filling fixed-capacity containers with items.

Method: best-fit decreasing with a segment tree over remaining capacities,
finding the tightest open bin in logarithmic time per document.

Sizes are at most the capacity, and items of one size, like open bins with the
same room, are interchangeable for the rule. So the rule runs over sizes, not
over documents: the segment tree has a leaf for every remaining capacity, each
leaf holds ranges of bin numbers, and a whole range of bins takes its items in
one step. The result is exactly that of best-fit decreasing item by item, in a
plan whose length depends on the capacity only. Documents of one size are
numbered in salted buckets and look their bins up in the plan.

A document larger than a container is cut into full pieces, which fill bins by
themselves, and a rest, which is an item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from inkwell.functions.arrow import arrow_schema, map_rows
from inkwell.llm.tokens import VOCABULARY, token_counts
from inkwell.session import cut

BUCKETS = 64


class TightestFit:
    """Segment tree over remaining capacities: the least one, at least a given size, that some open bin has."""

    def __init__(self, capacity: int) -> None:
        self.n = 1
        while self.n < capacity + 1:
            self.n *= 2
        self.some = bytearray(2 * self.n)
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def put(self, room: int, first: int, last: int) -> None:
        """Bins first..last-1 have this room."""
        self.ranges.setdefault(room, []).append((first, last))
        self._mark(room, 1)

    def take(self, room: int) -> tuple[int, int]:
        """A range of the bins with this room."""
        stack = self.ranges[room]
        out = stack.pop()
        if not stack:
            self._mark(room, 0)
        return out

    def _mark(self, room: int, on: int) -> None:
        i = self.n + room
        self.some[i] = on
        i //= 2
        while i:
            self.some[i] = self.some[2 * i] | self.some[2 * i + 1]
            i //= 2

    def tightest(self, size: int) -> int | None:
        i = self.n + size
        if self.some[i]:
            return size
        while i > 1:
            if i % 2 == 0 and self.some[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.n
            i //= 2
        return None


def best_fit_plan(sizes: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over (size, items): rows (size, first, last, bin, per_bin).

    Items first..last-1 of a size go into bins from `bin` on, per_bin into each.
    Bins are numbered from 0 in the order of opening."""
    tree, bins = TightestFit(capacity), 0
    plan: list[tuple[int, int, int, int, int]] = []
    for size, count in sorted(sizes, reverse=True):
        if size <= 0 or count <= 0:
            continue
        if size > capacity:
            raise ValueError("an item is larger than the capacity")
        at = 0
        while at < count:
            room = tree.tightest(size)
            if room is None:
                room, need = capacity, -(-(count - at) // (capacity // size))
                first, last = bins, bins + need
                bins += need
            else:
                first, last = tree.take(room)
            per = room // size
            full = min(last - first, (count - at) // per)
            if full:
                plan.append((size, at, at + full * per, first, per))
                at += full * per
                if room - per * size > 0:
                    tree.put(room - per * size, first, first + full)
            first += full
            if at < count and first < last:
                left = count - at
                plan.append((size, at, count, first, left))
                at = count
                tree.put(room - left * size, first, first + 1)
                first += 1
            if first < last:
                tree.put(room, first, last)
    return plan


def _plans(cols: dict[str, list]) -> Iterator[tuple]:
    for name, capacity, sizes in zip(cols["bin_name"], cols["capacity"], cols["sizes"]):
        for row in best_fit_plan([(s["size"], s["items"]) for s in sizes], capacity):
            yield name, *row


def packed(df: DataFrame, bins: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(bin_name, id, piece_no, token_start, tokens, container) of every piece of every document for every capacity.

    A document that fits has one piece 0. Containers of rests and whole
    documents are named b0, b1, ...; a full piece p of document i has the
    container f<i>.<p>. Null and empty texts have 0 tokens, one piece and no
    container. Rows with one id count as separate documents only by their
    order; ids are expected to be unique. A capacity of null or less than 1 is left out."""
    counts = cut(token_counts(df, id_col, text_col, vocabulary=vocabulary))
    caps = bins.where("capacity_tokens >= 1").select("bin_name", F.col("capacity_tokens").cast("int").alias("capacity"))
    each = counts.crossJoin(F.broadcast(caps))
    items = each.select("bin_name", "capacity", "id", "tokens", F.pmod("tokens", "capacity").cast("int").alias("size")).where("size > 0")
    items = items.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)))
    per = cut(items.groupBy("bin_name", "capacity", "size", "bucket").agg(F.count("*").alias("n")))
    sizes = per.groupBy("bin_name", "capacity", "size").agg(F.sum("n").alias("items"))
    plan = cut(map_rows(sizes.groupBy("bin_name", "capacity").agg(F.collect_list(F.struct("size", "items")).alias("sizes")), _plans, "bin_name string, size int, first long, last long, bin long, per_bin long"))
    base = per.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("bin_name", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    numbered = items.withColumn("k", F.row_number().over(W.partitionBy("bin_name", "size", "bucket").orderBy("id")) - 1)
    placed = numbered.join(base.select("bin_name", "size", "bucket", "base"), ["bin_name", "size", "bucket"]).select("bin_name", "capacity", "id", "tokens", "size", (F.col("k") + F.col("base")).alias("no"))
    rests = placed.join(plan, ["bin_name", "size"]).where("no >= first and no < last").select(
        "bin_name", "id", F.floor(F.col("tokens") / F.col("capacity")).cast("int").alias("piece_no"), (F.col("tokens") - F.col("size")).alias("token_start"), F.col("size").cast("long").alias("tokens"),
        F.concat(F.lit("b"), (F.col("bin") + F.floor((F.col("no") - F.col("first")) / F.col("per_bin"))).cast("string")).alias("container"),
    )
    full = each.where("tokens >= capacity").select("bin_name", "id", "capacity", F.explode(F.sequence(F.lit(0), (F.floor(F.col("tokens") / F.col("capacity")) - 1).cast("int"))).alias("piece_no")).select(
        "bin_name", "id", "piece_no", (F.col("piece_no").cast("long") * F.col("capacity")).alias("token_start"), F.col("capacity").cast("long").alias("tokens"), F.concat(F.lit("f"), F.col("id").cast("string"), F.lit("."), F.col("piece_no").cast("string")).alias("container"),
    )
    none = each.where("tokens = 0").select("bin_name", "id", F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("token_start"), F.col("tokens"), F.lit(None).cast("string").alias("container"))
    return rests.unionByName(full).unionByName(none)


def unused(pieces: DataFrame, bins: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens laid, room in all and the share of it left unused."""
    caps = bins.where("capacity_tokens >= 1").select("bin_name", F.col("capacity_tokens").cast("long").alias("capacity"))
    used = pieces.where("container is not null").groupBy("bin_name").agg(
        F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"),
        F.sum(F.when(F.col("container").startswith("f"), 1).otherwise(0)).alias("full"),
        F.max(F.when(F.col("container").startswith("b"), F.substring("container", 2, 20).cast("long"))).alias("last"),
    )
    n = F.coalesce(F.col("full"), F.lit(0)) + F.coalesce(F.col("last") + 1, F.lit(0))
    laid = F.coalesce(F.col("tokens"), F.lit(0))
    return caps.join(used, "bin_name", "left").select(
        "bin_name", "capacity", n.alias("containers"), F.coalesce("pieces", F.lit(0)).alias("pieces"), laid.alias("tokens"), (n * F.col("capacity") - laid).alias("unused_tokens"),
        F.coalesce((n * F.col("capacity") - laid) / F.nullif(n * F.col("capacity"), F.lit(0)), F.lit(0.0)).alias("unused_share"),
    )
