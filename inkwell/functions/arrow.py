"""Small helpers for Arrow functions that run over whole partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a schema string; needs the driver."""
    return to_arrow_schema(_parse_datatype_string(ddl))


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], Iterable[tuple]], ddl: str, batch: int = 20_000) -> DataFrame:
    """Apply fn to each Arrow batch, given as a dict of Python lists; fn yields row tuples in the order of ddl.

    Rows leave in batches of at most `batch`, so an exploding fn stays within bounded memory."""
    return df.mapInArrow(_Mapper(fn, ddl, batch), ddl)


class _Mapper:
    def __init__(self, fn: Callable, ddl: str, batch: int) -> None:
        self.fn, self.schema, self.batch = fn, arrow_schema(ddl), batch

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, width = self.schema, len(self.schema)
        for b in batches:
            rows: list[tuple] = []
            for row in self.fn(b.to_pydict()):
                rows.append(row)
                if len(rows) >= self.batch:
                    yield as_batch(rows, schema, width)
                    rows = []
            if rows:
                yield as_batch(rows, schema, width)


def as_batch(rows: list[tuple], schema: pa.Schema, width: int) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * width
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def grouped_rows(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """Consecutive rows with the same key, from batches sorted by it; a group may span batches."""
    current, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if r[key] != current or not rows:
                if rows:
                    yield current, rows
                current, rows = r[key], []
            rows.append(r)
    if rows:
        yield current, rows


@contextmanager
def one_row_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, what runs sends Arrow functions rows of a megabyte or more one by one: rows that hold whole blocks would else gather up to 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(1 << 20))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
