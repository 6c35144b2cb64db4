"""Result formats: matrix JSON, text table, CSV, and the exposition of counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.model import NAME, series_key


def number(v: Column) -> Column:
    return F.when(F.isnan(v), F.lit("NaN")).otherwise(v.cast("string"))


def to_matrix(df: DataFrame) -> DataFrame:
    """One row for each series: name, labels and values [[ts, v], ...] in order of time, as a JSON object."""
    points = F.transform(F.sort_array(F.collect_list(F.struct("ts", "value"))), lambda p: F.concat(F.lit("["), p["ts"].cast("string"), F.lit(","), number(p["value"]), F.lit("]")))
    nested = df.groupBy("series_key", "name", "labels").agg(F.array_join(points, ",").alias("points"))
    head = F.to_json(F.struct("name", "labels"))
    return nested.select("series_key", F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"values":['), F.col("points"), F.lit("]}")).alias("json"))


def to_envelope(df: DataFrame) -> DataFrame:
    """The answer of the query API in pieces: at (order), text. Their texts in order are one JSON object.

    No piece holds more than one series, so an answer of any size is written by many tasks.
    """
    series = to_matrix(df)
    first = F.broadcast(series.agg(F.min("series_key").alias("first")))  # one row
    spark = df.sparkSession
    ends = spark.range(1).select(F.explode(F.array(F.struct(F.lit("").alias("at"), F.lit('{"status":"success","data":{"resultType":"matrix","result":[').alias("text")), F.struct(F.lit("~").alias("at"), F.lit("]}}").alias("text")))).alias("e")).select("e.*")
    body = series.join(first).select(F.concat(F.lit(" "), "series_key").alias("at"), F.concat(F.when(F.col("series_key") == F.col("first"), F.lit("")).otherwise(F.lit(",")), "json").alias("text"))
    return ends.union(body)


def error_envelope(spark, message: str) -> DataFrame:
    """The answer to a query that failed: one piece."""
    return spark.range(1).select(F.lit("").alias("at"), F.to_json(F.struct(F.lit("error").alias("status"), F.lit(message).alias("error"))).alias("text"))


def to_table(df: DataFrame) -> DataFrame:
    """SERIES, TIMESTAMP (HH:mm:ss) and VALUE with four decimals; the series without __name__."""
    shown = series_key(F.col("name"), F.map_filter("labels", lambda k, _: k != NAME))
    return df.select(shown.alias("series"), F.date_format(F.timestamp_millis("ts"), "HH:mm:ss").alias("timestamp"), F.format_string("%.4f", "value").alias("value"))


def to_csv(df: DataFrame) -> DataFrame:
    """series (the metric's name alone), timestamp, value with six decimals; write it with df.write.csv(header=True)."""
    return df.select(F.col("name").alias("series"), F.col("ts").alias("timestamp"), F.format_string("%.6f", "value").alias("value"))


def exposition(stats: DataFrame, prefix: str = "chronoframe") -> DataFrame:
    """Lines of the text exposition format, a gauge for each column of a stats row."""
    lines = F.array(*[F.concat(F.lit(f"# TYPE {prefix}_{c} gauge\n{prefix}_{c} "), F.col(c).cast("string")) for c in stats.columns])
    return stats.select(F.explode(lines).alias("line"))
