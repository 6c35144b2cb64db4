"""Structured Streaming: continuous ingestion, streaming rollups and live values."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from chronoframe.operators.aggregates import greatest, least
from chronoframe.sources import requests, store


#: Milliseconds from the epoch to 2020, and bits of the order of files: over 34 years of milliseconds.
SINCE = 1_577_836_800_000


def request_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Samples of write requests, one JSON object to a line, in files as they arrive.

    Samples arrive in the order of their files' modification times and then as they
    stand in the file. A file is read whole, so it must fit in a task.
    """
    files = spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("wholetext", True).text(path)
    at = F.unix_millis("_metadata.file_modification_time") - SINCE
    return requests.parse(files.select(F.split("value", "\n").alias("lines"), F.greatest(at, F.lit(0)).alias("at")), "lines", "at")


def land(stream: DataFrame, path: str, checkpoint: str, rows_per_file: int = 5_000_000, **trigger) -> StreamingQuery:
    """Append a samples stream to the storage layout, a batch of it for each micro-batch.

    A micro-batch that is run again after a failure overwrites its own batch only,
    so nothing is written twice. A batch is written when the trigger says so or,
    under `availableNow`, as often as the source's files for each trigger ask.
    """

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.write(batch, path, f"stream-{number}", rows_per_file=rows_per_file)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def landed(spark: SparkSession, path: str) -> DataFrame:
    """All samples that `land` has written."""
    return store.Store(spark, path).samples()


def writer_stats(query: StreamingQuery, spark: SparkSession, path: str) -> DataFrame:
    """What a landing query has done, in one row: total_ingested, total_batches, total_errors.

    Samples and batches are counted where they stand, those of queries before a
    restart included; an error ends a query, so there is at most one.
    """
    rows = store.Store(spark, path)._rows().filter(F.col("batch").startswith("stream-"))
    failed = int(query.exception() is not None)
    return rows.agg(F.count("*").alias("total_ingested"), F.countDistinct("batch").alias("total_batches")).select("*", F.lit(failed).cast("long").alias("total_errors"))


def rollup_stream(stream: DataFrame, width_ms: int, late: str = "10 minutes") -> DataFrame:
    """Rollup rows in windows of event time; in append mode a window is emitted once the watermark has passed it."""
    at = F.timestamp_millis("ts")
    v = F.col("value")
    out = stream.withColumn("at", at).withWatermark("at", late).groupBy("series_key", F.window("at", f"{width_ms} milliseconds").alias("w"))
    out = out.agg(least(v).alias("min"), greatest(v).alias("max"), F.avg(v).alias("avg"), F.sum(v).alias("sum"), F.count("*").alias("count"))
    return out.select("series_key", (F.unix_millis(F.col("w.start")) + width_ms // 2).alias("ts"), "min", "max", "avg", "sum", "count")


def latest_stream(stream: DataFrame) -> DataFrame:
    """The latest value of each series, for update or complete mode."""
    return stream.groupBy("series_key").agg(F.max("ts").alias("ts"), F.max_by("value", F.struct("ts", "seq")).alias("value"))


def rate_stream(stream: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Samples that arrive for each second of event time."""
    at = stream.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    return at.groupBy(F.window("at", "1 second").alias("w")).agg(F.count("*").alias("samples")).select(F.col("w.start").alias("second"), "samples")


class LastSamples(StatefulProcessor):
    """Keeps the newest `n` samples of a series as state and emits them whenever they change."""

    def __init__(self, n: int = 300):
        self.n = n

    def init(self, handle) -> None:
        self.held = handle.getListState("held", "ts bigint, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = pd.DataFrame(list(self.held.get()) if self.held.exists() else [], columns=["ts", "value"])
        new = pd.concat([known, *[r[["ts", "value"]] for r in rows]]).sort_values("ts", kind="stable").tail(self.n)
        self.held.put([(int(t), float(v)) for t, v in zip(new["ts"], new["value"], strict=True)])
        yield pd.DataFrame({"series_key": key[0], "ts": new["ts"].astype("int64"), "value": new["value"].astype(float)})

    def close(self) -> None:
        pass


def last_samples_stream(stream: DataFrame, n: int = 300) -> DataFrame:
    """The last n samples of each series; needs the RocksDB state store."""
    return stream.groupBy("series_key").transformWithStateInPandas(LastSamples(n), "series_key string, ts bigint, value double", "Update", "None")
