"""Whole Arrow columns of text as arrays of code points, so that scans over all text run in NumPy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from inkwell.functions.arrow import arrow_schema

TOP = 0x110000


@dataclass
class Points:
    """Texts of a column laid end to end.

    points: the code points; starts: where each text begins, and the end of the
    last; row, no: the batch row and the position in its list (0 for plain strings)."""

    points: np.ndarray
    starts: np.ndarray
    row: np.ndarray
    no: np.ndarray
    texts: pa.Array

    def counts(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged code points each text has."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.starts[1:]] - total[self.starts[:-1]]


def points_of(column: pa.Array) -> Points:
    """Null texts are left out, but positions in a list count them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        offsets = column.offsets.to_numpy()
        sizes = np.where(np.asarray(column.is_null()), 0, np.diff(offsets))
        row = np.repeat(np.arange(len(column)), sizes)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        no = np.arange(len(row)) - first
        values = column.flatten()
    else:
        row, no, values = np.arange(len(column)), np.zeros(len(column), dtype=np.int64), column
    keep = np.asarray(values.is_valid())
    row, no, values = row[keep], no[keep], values.drop_null()
    if pa.types.is_string(values.type):
        values = pa.concat_arrays([values])
    ends = np.concatenate(([0], np.cumsum(np.asarray(pc.binary_length(values), dtype=np.int64)))) if len(values) else np.zeros(1, dtype=np.int64)
    data = b"".join(values.cast(pa.binary()).to_pylist()) if len(values) else b""
    raw = np.frombuffer(data, dtype=np.uint8)
    lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)))
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    return Points(points, lead[ends], row, no, values)


class _Census:
    def __init__(self, columns: list[str]) -> None:
        self.columns, self.schema = columns, arrow_schema("point int, n long")

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TOP, dtype=np.int64)
        for b in batches:
            for c in self.columns:
                p = points_of(b.column(b.schema.get_field_index(c))).points
                if len(p):
                    n = np.bincount(p)
                    total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], schema=self.schema)


def census(df: DataFrame, columns: list[str]) -> np.ndarray:
    """How often each code point occurs in the columns (strings or lists of strings), over all rows.

    What reaches the driver is bounded by the number of code points, 1,114,112."""
    counts = df.select(*columns).mapInArrow(_Census(columns), "point int, n long").groupBy("point").agg(F.sum("n").alias("n"))
    out = np.zeros(TOP, dtype=np.int64)
    for r in counts.toLocalIterator():
        out[r["point"]] = r["n"]
    return out
