"""Rollups, their cascade, the choice of a resolution, retention and merging of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.operators.aggregates import greatest, least

#: Source resolution or raw, target resolution, how long it is kept (ms).
CASCADE = ((5_000, 60_000, 7 * 86_400_000), (60_000, 3_600_000, 30 * 86_400_000))


def _window(width_ms: int):
    # div truncates towards zero, negative timestamps included
    return F.expr(f"ts div {int(width_ms)}") * int(width_ms)


def rollup(df: DataFrame, width_ms: int) -> DataFrame:
    """min, max, avg, sum, count of each series in tumbling windows from the epoch, at the window's middle.

    NaN counts in sum and avg only. Empty windows give no row; a width of zero or
    less gives no row at all.
    """
    if width_ms <= 0:
        return rollup(df, 1).limit(0)
    v = F.col("value")
    out = df.groupBy("series_key", _window(width_ms).alias("start")).agg(least(v).alias("min"), greatest(v).alias("max"), F.avg(v).alias("avg"), F.sum(v).alias("sum"), F.count("*").alias("count"))
    return out.select("series_key", F.lit(width_ms).cast("long").alias("resolution_ms"), (F.col("start") + width_ms // 2).alias("ts"), "min", "max", "avg", "sum", "count")


def cascade(rolled: DataFrame, width_ms: int) -> DataFrame:
    """A coarser rollup of a rollup, without the samples."""
    out = rolled.groupBy("series_key", _window(width_ms).alias("start")).agg(F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"), F.sum("count").alias("count"))
    return out.select("series_key", F.lit(width_ms).cast("long").alias("resolution_ms"), (F.col("start") + width_ms // 2).alias("ts"), "min", "max", (F.col("sum") / F.col("count")).alias("avg"), "sum", "count")


def resolution_for(start: int, end: int, most_points: int = 1000, resolutions=(0, 60_000, 3_600_000), raw_ms: int = 5_000) -> int:
    """The finest resolution (0: raw) that keeps a range within `most_points` for each series."""
    return next((r for r in resolutions if (end - start) / (r or raw_ms) <= most_points), resolutions[-1])


def expired(blocks: DataFrame, now: int, keep_ms: int) -> DataFrame:
    """Blocks that end before now - keep_ms: whole blocks only."""
    return blocks.filter(F.col("max_time") < now - keep_ms)


def retained(blocks: DataFrame, now: int, keep_ms: int) -> DataFrame:
    return blocks.filter(F.col("max_time") >= now - keep_ms)


def merge_sources(*sources: DataFrame) -> DataFrame:
    """Samples of several sources; at equal series and timestamp the source named first wins, with all it has there."""
    tagged = reduce(DataFrame.unionByName, [df.withColumn("__rank", F.lit(i)) for i, df in enumerate(sources)])
    first = Window.partitionBy("series_key", "ts")
    return tagged.withColumn("__first", F.min("__rank").over(first)).filter("__rank = __first").drop("__rank", "__first")
