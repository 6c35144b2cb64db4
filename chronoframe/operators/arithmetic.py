"""Binary arithmetic. Whether an operand is a scalar is a matter of data: one row in all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("name", "labels", "series_key", "ts", "value", "seq")


def apply(op: str, a: Column, b: Column) -> Column:
    """IEEE arithmetic, but division by zero gives 0."""
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b != 0, b))


def with_literal(df: DataFrame, op: str, number: float) -> DataFrame:
    """A number on the right is always a scalar: no join."""
    return df.withColumn("value", apply(op, F.col("value"), F.lit(float(number))))


def combine(left: DataFrame, op: str, right: DataFrame) -> DataFrame:
    """The right side is tried as the scalar first, then the left; else the left side is the result.

    Both sides stand in one tagged union; its summary is one row, so the broadcast
    join multiplies nothing, and equal subplans are evaluated once by reuse.
    """
    both = left.select(*COLUMNS, F.lit(True).alias("__left")).unionByName(right.select(*COLUMNS, F.lit(False).alias("__left")))
    mine, other = F.col("__left"), ~F.col("__left")
    sums = both.agg(F.count_if(mine).alias("__ln"), F.count_if(other).alias("__rn"), F.max(F.when(mine, F.col("value"))).alias("__lv"), F.max(F.when(other, F.col("value"))).alias("__rv"))
    out = both.join(F.broadcast(sums)).filter(F.when(mine, (F.col("__rn") == 1) | (F.col("__ln") != 1)).otherwise((F.col("__rn") != 1) & (F.col("__ln") == 1)))
    value = F.when(other, apply(op, F.col("__lv"), F.col("value"))).when(F.col("__rn") == 1, apply(op, F.col("value"), F.col("__rv"))).otherwise(F.col("value"))
    return out.withColumn("value", value).select(*COLUMNS)


def matched(left: DataFrame, op: str, right: DataFrame) -> DataFrame:
    """Extension: samples of equal labels (without the name) and timestamp."""
    from chronoframe.model import NAME, series_key

    key = series_key(F.lit(""), F.map_filter("labels", lambda k, _: k != NAME))
    r = right.select(key.alias("__key"), F.col("ts").alias("__ts"), F.col("value").alias("__v"))
    l = left.withColumn("__key", key)  # noqa: E741
    out = l.join(r, (l["__key"] == r["__key"]) & (l["ts"] == r["__ts"]))
    return out.withColumn("value", apply(op, F.col("value"), F.col("__v"))).select(*COLUMNS)
