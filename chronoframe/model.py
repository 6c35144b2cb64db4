"""The sample model: one row for each sample, long format.

samples(name STRING, labels MAP<STRING,STRING>, series_key STRING, ts BIGINT ms,
value DOUBLE, seq BIGINT). `seq` is the order of arrival and settles equal
timestamps. A missing label is an absent key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLES = "name string, labels map<string,string>, series_key string, ts bigint, value double, seq bigint"
NAME = "__name__"


def series_key(name: Column, labels: Column) -> Column:
    """name{k=v,k=v} with sorted label names; the bare name without labels."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(F.size(labels) > 0, F.concat(name, F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(name)


def samples(df: DataFrame, name: Column, labels: Column | dict[str, Column], ts: Column, value: Column, seq: Column) -> DataFrame:
    """A samples DataFrame out of any table. Rows without a value are no samples.

    labels: a map, or columns by label name. With these, which are never null, keys
    are plain concatenations in the names' order instead of a sort for each row.
    """
    columns = ["name", "labels", "series_key", "ts", "value", "seq"]
    rest = [ts.cast("long").alias("ts"), value.cast("double").alias("value"), seq.cast("long").alias("seq")]
    if isinstance(labels, dict):
        texts = {k: c.cast("string") for k, c in sorted(labels.items())}
        pairs = [x for i, (k, c) in enumerate(texts.items()) for x in (F.lit(("," if i else "{") + k + "="), c)]
        key = F.concat(name.cast("string"), *pairs, F.lit("}")) if texts else name.cast("string")
        made = F.create_map(*[x for k, c in texts.items() for x in (F.lit(k), c)]) if texts else F.expr("map()")
        out = df.select(name.cast("string").alias("name"), made.cast("map<string,string>").alias("labels"), key.alias("series_key"), *rest)
    else:
        out = df.select(name.cast("string").alias("name"), labels.cast("map<string,string>").alias("labels"), *rest)
        out = out.withColumn("series_key", series_key(F.col("name"), F.col("labels"))).select(*columns)
    return out.filter(F.col("value").isNotNull())


def distinct_series(df: DataFrame) -> DataFrame:
    """series_key, name, labels of every series."""
    return df.groupBy("series_key", "name", "labels").count().drop("count")


def label(name: str) -> Column:
    """A label's value; null where the series lacks it."""
    return F.col("name") if name == NAME else F.try_element_at(F.col("labels"), F.lit(name))


def millis(column: str) -> Column:
    """Whole milliseconds of a timestamp column, floored. The session's zone must be UTC."""
    return F.unix_millis(F.col(column).cast("timestamp"))
