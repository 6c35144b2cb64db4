"""Aggregations over series at equal timestamps, and functions over one series' samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.model import NAME, series_key

INF = float("inf")


def least(v: Column) -> Column:
    """Minimum without NaN; +Inf of nothing else."""
    return F.coalesce(F.min(F.when(~F.isnan(v), v)), F.lit(INF))


def greatest(v: Column) -> Column:
    """Maximum without NaN; -Inf of nothing else."""
    return F.coalesce(F.max(F.when(~F.isnan(v), v)), F.lit(-INF))


REDUCE = {"sum": F.sum, "avg": F.avg, "max": greatest, "min": least, "count": lambda v: F.count(v).cast("double")}


def first_at(df: DataFrame, *carried: str) -> DataFrame:
    """Of several samples of a series at one timestamp the first that arrived.

    What is carried depends on the series alone and is part of the key, so that the
    buffers hold numbers only and a hash aggregate does.
    """
    return df.groupBy("series_key", "ts", *carried).agg(F.min_by("value", "seq").alias("value"))


def _named(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Labels, name and key of grouped rows. keys: label -> its column; empty values are missing labels."""
    pairs = [F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in keys.items()]
    labels = F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["v"] != "")) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    df = df.withColumn("labels", labels).withColumn("name", F.lit(""))
    return df.select("name", "labels", series_key(F.col("name"), F.col("labels")).alias("series_key"), "ts", "value", F.lit(0).cast("long").alias("seq"))


def _value_of(label: str) -> Column:
    value = F.try_element_at("labels", F.lit(label))
    return F.coalesce(value, F.col("name") if label == NAME else F.lit(None), F.lit(""))


def aggregate(df: DataFrame, op: str, by=(), unique: bool = False) -> DataFrame:
    """`op` over the groups' values at each timestamp.

    by: grouping labels; a missing label is the empty group value and does not
    show. unique: no series has two samples at one timestamp. Partial sums are
    formed before the only shuffle then.
    """
    keys = {label: f"__g{i}" for i, label in enumerate(dict.fromkeys(by))}
    df = df.select("series_key", "ts", "value", "seq", *[_value_of(k).alias(c) for k, c in keys.items()])
    if not unique:
        df = first_at(df, *keys.values())
    return _named(df.groupBy(*keys.values(), "ts").agg(REDUCE[op](F.col("value")).alias("value")), keys)


def aggregate_without(df: DataFrame, op: str, dropped, unique: bool = False) -> DataFrame:
    """`op` over groups of series that agree in all labels but `dropped` and the name."""
    kept = F.map_filter("labels", lambda k, _: ~k.isin(NAME, *dropped))
    df = df.select("series_key", "ts", "value", "seq", series_key(F.lit(""), kept).alias("__key"), F.to_json(kept).alias("__labels"))
    if not unique:
        df = first_at(df, "__key", "__labels")
    out = df.groupBy("__key", "__labels", "ts").agg(REDUCE[op](F.col("value")).alias("value"))
    return out.select(F.lit("").alias("name"), F.from_json("__labels", "map<string,string>").alias("labels"), F.col("__key").alias("series_key"), "ts", "value", F.lit(0).cast("long").alias("seq"))


def ranked(df: DataFrame, op: str, k: int, by=(), unique: bool = False) -> DataFrame:
    """topk / bottomk: the k series with the largest or smallest values at each timestamp and group. Ties go to the smaller key."""
    df = df.select("*", *[_value_of(label).alias(f"__g{i}") for i, label in enumerate(by)])
    if not unique:
        first = Window.partitionBy("series_key", "ts").orderBy("seq")
        df = df.withColumn("__first", F.row_number().over(first)).filter("__first = 1")
    value = F.when(~F.isnan("value"), F.col("value"))
    order = value.desc_nulls_last() if op == "topk" else value.asc_nulls_last()
    best = Window.partitionBy(*[f"__g{i}" for i in range(len(by))], "ts").orderBy(order, "series_key")
    return df.withColumn("__rank", F.row_number().over(best)).filter(F.col("__rank") <= k).select("name", "labels", "series_key", "ts", "value", "seq")


def _gain(before: Column, value: Column) -> Column:
    """What a counter gained from one sample to the next: a fall is a reset, and the new value the gain."""
    rise = value - before
    return F.when(before.isNull(), F.lit(0.0)).when(~F.isnan(rise) & (rise >= 0), rise).otherwise(value)


def rate(df: DataFrame, part_ms: int = 86_400_000) -> DataFrame:
    """Increase for each second between a series' first and last sample, at the last.

    A fall of the value is a reset: the new value is the increase. Series of one
    sample or no time span have no rate. Samples meet by series and time part, so a
    hot series takes many tasks; one row of each part then meets by series.
    """
    part = F.expr(f"ts div {int(part_ms)}").alias("part")
    within = Window.partitionBy("series_key", "part").orderBy("ts", "seq")
    steps = df.select("name", "labels", "series_key", "ts", "value", "seq", part).withColumns({"before": F.lag("value").over(within), "after": F.lead("ts").over(within)})
    parts = steps.groupBy("series_key", "name", "labels", "part").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.sum(_gain(F.col("before"), F.col("value"))).alias("gain"),
        F.max(F.when(F.col("before").isNull(), F.col("value"))).alias("first"), F.max(F.when(F.col("after").isNull(), F.col("value"))).alias("last"),
    )
    parts = parts.withColumn("came", F.lag("last").over(Window.partitionBy("series_key").orderBy("part")))
    span = (F.max("last_ts") - F.min("first_ts")) / 1000.0
    total = F.sum(F.col("gain") + _gain(F.col("came"), F.col("first")))
    out = parts.groupBy("series_key", "name", "labels").agg(F.max("last_ts").alias("ts"), (total / F.nullif(span, F.lit(0.0))).alias("value"), F.sum("n").alias("n"))
    return out.filter("n >= 2 and value is not null").select("name", "labels", "series_key", "ts", "value", F.lit(0).cast("long").alias("seq"))


def quantile(df: DataFrame, q: float) -> DataFrame:
    """Nearest-rank quantile of each series' values, at its last timestamp; NaN are the smallest. None outside [0, 1]."""
    series = Window.partitionBy("series_key")
    order = series.orderBy(F.isnan("value").desc(), "value")
    rank = F.greatest(F.lit(1), F.least(F.col("n"), F.ceil(F.lit(float(q)) * F.col("n"))))
    out = df.select("*", F.row_number().over(order).alias("rank"), F.count("*").over(series).alias("n"), F.max("ts").over(series).alias("last"))
    out = out.filter((F.col("rank") == rank) & F.lit(0 <= q <= 1))
    return out.select("name", "labels", "series_key", F.col("last").alias("ts"), "value", "seq")
