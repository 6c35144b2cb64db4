"""Metadata and statistics over all samples, and what the dashboards show of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.model import NAME, distinct_series, label

#: Upper bounds of the latency buckets, in milliseconds.
LATENCY_MS = (1, 5, 10, 25, 50, 100, 250, 500, 1000)


def series(df: DataFrame) -> DataFrame:
    """One row for each series: samples, first and last timestamp, and the value that arrived last."""
    return df.groupBy("series_key", "name", "labels").agg(
        F.count("*").alias("sample_count"),
        F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.max_by("value", "seq").alias("last_value"),
    )


def label_names(df: DataFrame) -> DataFrame:
    """Sorted distinct label names, __name__ among them if there is any series."""
    own = df.select(F.explode(F.map_keys("labels")).alias("label"))
    named = df.limit(1).select(F.lit(NAME).alias("label"))
    return own.union(named).distinct().orderBy("label")


def label_values(df: DataFrame, name: str) -> DataFrame:
    """Sorted distinct values of a label; no row if no series has it."""
    return df.select(label(name).alias("value")).filter("value is not null").distinct().orderBy("value")


def metric_types(df: DataFrame) -> DataFrame:
    """counter for names that end in _total, else gauge."""
    return df.select("name").distinct().select("name", F.when(F.col("name").endswith("_total"), "counter").otherwise("gauge").alias("type"))


def blocks(df: DataFrame, width_ms: int) -> DataFrame:
    """The time blocks that hold the samples: true bounds, samples and series of each."""
    start = F.expr(f"ts div {int(width_ms)}") * int(width_ms)
    return df.groupBy(start.alias("block_start")).agg(F.min("ts").alias("min_time"), F.max("ts").alias("max_time"), F.count("*").alias("num_samples"), F.countDistinct("series_key").alias("num_series"), F.lit(1).alias("level"))


def stats(df: DataFrame, chunk_bytes: int = 0, disk_bytes: int = 0) -> DataFrame:
    """Counts of samples and series, their raw size at 16 bytes a sample, and how far they were compressed."""
    out = df.agg(F.count("*").alias("samples"), F.countDistinct("series_key").alias("series"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))
    raw = F.col("samples") * 16
    return out.select("*", raw.alias("raw_bytes"), F.lit(chunk_bytes).cast("long").alias("chunk_bytes"), F.lit(disk_bytes).cast("long").alias("disk_bytes"), ratio(raw, F.lit(chunk_bytes)).alias("compression_ratio"))


def storage_stats(df: DataFrame, chunks: DataFrame, width_ms: int, disk_bytes: int = 0) -> DataFrame:
    """stats with the real size of the encoded chunks (`codec.encode_chunks`), the number of blocks, and what the stored layout takes."""
    counted = stats(df).drop("chunk_bytes", "disk_bytes", "compression_ratio")
    packed = chunks.agg(F.coalesce(F.sum(F.length("chunk").cast("long")), F.lit(0).cast("long")).alias("chunk_bytes"))
    own = df.agg(F.countDistinct(F.expr(f"ts div {int(width_ms)}")).alias("blocks"))
    # each is one row
    out = counted.join(F.broadcast(packed)).join(F.broadcast(own)).withColumn("disk_bytes", F.lit(disk_bytes).cast("long"))
    return out.withColumn("compression_ratio", ratio(F.col("raw_bytes"), F.col("chunk_bytes")))


def ratio(raw: Column, packed: Column) -> Column:
    """raw / packed; 0 if nothing is packed."""
    return F.coalesce(F.try_divide(raw.cast("double"), packed), F.lit(0.0))


def cluster_stats(node_stats: DataFrame) -> DataFrame:
    """Sums over the nodes' stats rows."""
    sums = node_stats.agg(*[F.sum(c).alias(c) for c in ("samples", "series", "raw_bytes", "chunk_bytes", "disk_bytes")])
    return sums.withColumn("compression_ratio", ratio(F.col("raw_bytes"), F.col("disk_bytes")))


def latency_histogram(df: DataFrame, latency_ms: Column, bounds=LATENCY_MS) -> DataFrame:
    """Observations for each upper bound (inclusive), all bounds shown; what is slower than all counts in the last."""
    le = F.lit(bounds[-1])
    for b in reversed(bounds[:-1]):
        le = F.when(latency_ms <= b, F.lit(b)).otherwise(le)
    found = df.groupBy(le.cast("int").alias("le")).agg(F.count("*").alias("found"))
    every = df.sparkSession.createDataFrame([(b,) for b in bounds], "le int")
    return every.join(F.broadcast(found), "le", "left").select("le", F.coalesce("found", F.lit(0)).alias("count"))


def cumulative_histogram(histogram: DataFrame) -> DataFrame:
    """Running totals of the buckets, with the sum estimated by upper bounds. The buckets are few and fixed."""
    upto = Window.orderBy("le").rowsBetween(Window.unboundedPreceding, 0)
    return histogram.select("le", F.sum("count").over(upto).alias("cumulative"), F.sum(F.col("count") * F.col("le")).over(upto).cast("long").alias("sum_ms"))


def result_stats(df: DataFrame) -> DataFrame:
    """Series and samples of a query result."""
    return df.agg(F.countDistinct("series_key").alias("series"), F.count("*").alias("samples"))


def chart_bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def varying_labels(df: DataFrame) -> DataFrame:
    """Labels whose values differ among the result's series; a missing label counts as empty."""
    each = distinct_series(df).select("series_key", "labels")
    values = each.select(F.explode("labels").alias("label", "value")).groupBy("label").agg(F.countDistinct("value").alias("values"), F.count("*").alias("having"))
    total = each.agg(F.count("*").alias("total"))
    # the total is one row
    return values.join(F.broadcast(total)).filter((F.col("values") + (F.col("having") < F.col("total")).cast("int")) > 1).select("label")


def retention_timeline(block_rows: DataFrame, now: int) -> DataFrame:
    """The blocks and the head's interval: from the last block's end (or an hour ago) to now."""
    own = block_rows.select(F.lit("block").alias("kind"), F.col("min_time").alias("from_ts"), F.col("max_time").alias("to_ts"))
    head = block_rows.agg(F.coalesce(F.max("max_time"), F.lit(now - 3_600_000)).alias("from_ts")).select(F.lit("head").alias("kind"), "from_ts", F.lit(now).cast("long").alias("to_ts"))
    return own.unionByName(head)


def newest_per_series(df: DataFrame, n: int = 300) -> DataFrame:
    """The last n samples of each series (n at least 1)."""
    newest = Window.partitionBy("series_key").orderBy(F.desc("ts"), F.desc("seq"))
    return df.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= n).drop("__n")


def recent_feed(df: DataFrame, each: int = 3, total: int = 50) -> DataFrame:
    """The newest samples overall, no more than `each` of a series. Ties: series key, then arrival."""
    return newest_per_series(df, each).orderBy(F.desc("ts"), "series_key", F.desc("seq")).limit(total)


def ingest_rate(df: DataFrame, tick_ms: int = 1000, last: int = 120) -> DataFrame:
    """Samples of each tick, the last ticks that have any."""
    ticks = df.groupBy((F.expr(f"ts div {int(tick_ms)}") * int(tick_ms)).alias("tick")).agg(F.count("*").alias("samples"))
    return ticks.orderBy(F.desc("tick")).limit(last)
