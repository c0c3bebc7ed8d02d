"""Structured Streaming over event data: windows with late data, sessions, first sightings, guarded upserts.

Queries read a folder as a stream. Times are cast to TIMESTAMP before a watermark.
`drained` runs a query to its end and returns what it appended, for tests and one-off runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkwell.operators.changes import upsert
from inkwell.session import shared_folder


def event_stream(spark: SparkSession, folder: str, name: str = "events", files_per_trigger: int = 1) -> DataFrame:
    """A table of the folder as a stream, with ts as TIMESTAMP. A file with all rows, or a folder of such files."""
    import os

    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and event type; rows later than the watermark are dropped. Tumbling, or sliding with slide."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return stream.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a user: first and last time, and events."""
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy(w, "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def first_seen(stream: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """The first row of every key; state is kept as long as the watermark says."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def drained(query: DataFrame, mode: str = "append") -> DataFrame:
    """What the query gives until its input is used up, as a table in the shared folder. In other modes than append every batch writes the whole result anew, and the last is read."""
    spark = query.sparkSession
    folder = f"{shared_folder(spark)}/inkwell-stream_{uuid.uuid4().hex}"
    start = lambda w: w.option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    if mode == "append":
        start(query.writeStream.format("parquet").option("path", f"{folder}/out"))
        return spark.read.schema(query.schema).parquet(f"{folder}/out")
    if mode != "complete":
        raise ValueError("results can be drained in append and complete mode")
    start(query.writeStream.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{folder}/out/v{epoch:08d}")))
    last = _versions(spark, f"{folder}/out")
    return spark.read.schema(query.schema).parquet(last[-1]) if last else spark.createDataFrame([], query.schema)


def _versions(spark: SparkSession, folder: str) -> list[str]:
    """The versions of a table, oldest first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(str(f.getPath()) for f in fs.listStatus(path) if f.getPath().getName().startswith("v")) if fs.exists(path) else []


def upsert_into(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that upserts each batch into the versioned table at path; a repeated batch changes nothing.

    Every version is a folder of its own, so readers never see half a batch. A
    batch starts from the last version before it, whichever that is."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        target = f"{path}/v{epoch:08d}"
        before = [v for v in _versions(spark, path) if v.rsplit("/", 1)[-1] < f"v{epoch:08d}"]
        base = spark.read.parquet(before[-1]) if before else batch.limit(0)
        upsert(base, batch, keys, [F.desc(order)]).write.mode("overwrite").parquet(target)

    return run
