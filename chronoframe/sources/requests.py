"""Write requests as JSON: time_series of a name, label pairs and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.model import samples
from chronoframe.operators.matchers import valid_name

SERIES = "array<struct<name:string,labels:array<struct<name:string,value:string>>,samples:array<struct<timestamp_ms:bigint,value:double>>>>"
SCHEMA = f"struct<time_series:{SERIES}>"


def _last_wins(pairs: Column) -> Column:
    """A map of label pairs in which a repeated name has its last value."""
    pairs = F.coalesce(pairs, F.array().cast("array<struct<name:string,value:string>>"))
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    value = lambda n: F.element_at(F.filter(pairs, lambda p: p["name"] == n), -1)["value"]
    return F.map_from_entries(F.transform(F.filter(names, lambda n: n.isNotNull()), lambda n: F.struct(n.alias("k"), value(n).alias("v"))))


#: Bits of `seq` for the place of a sample among its request's; a request of more is an error.
PLACE = 24


def parse(df: DataFrame, json: str = "value", order: str | None = None) -> DataFrame:
    """Samples of the requests in column `json`, or of an array of requests that arrived together.

    Series with invalid names are left out, malformed requests too. `order`: a
    numeric column below 2**39 that gives the requests' order of arrival; without
    it, rows arrive in their order of the DataFrame. Within a request, samples
    arrive as they stand, over all its series, so no two have the same `seq`.
    """
    texts = F.col(json) if dict(df.dtypes)[json].startswith("array") else F.array(F.col(json).cast("string"))
    series = F.flatten(F.transform(texts, lambda t: F.coalesce(F.from_json(t, SCHEMA)["time_series"], F.array().cast(SERIES))))
    if order:
        base = F.col(order).cast("long")
    else:  # partition and row, as 17 and 22 bits
        row = F.monotonically_increasing_id()
        part, own = F.shiftright(row, 33), row.bitwiseAND(F.lit((1 << 33) - 1))
        base = F.when((part < 1 << 17) & (own < 1 << 22), part * (1 << 22) + own).otherwise(F.raise_error(F.lit("too many requests in a partition: name their order")).cast("long"))
    each = df.select(base.alias("request"), F.filter(series, lambda s: F.coalesce(valid_name(s["name"]), F.lit(False)) & s["samples"].isNotNull()).alias("series"))
    flat = F.flatten(F.transform("series", lambda s: F.transform(s["samples"], lambda p: F.struct(s["name"].alias("name"), s["labels"].alias("labels"), p["timestamp_ms"].alias("ts"), p["value"].alias("value")))))
    points = each.select("request", F.posexplode(flat).alias("at", "p")).select("request", "at", "p.*")
    seq = F.when(F.col("at") < 1 << PLACE, F.col("request") * (1 << PLACE) + F.col("at")).otherwise(F.raise_error(F.lit("too many samples in a request")).cast("long"))
    return samples(points, F.col("name"), _last_wins(F.col("labels")), F.col("ts"), F.col("value"), seq)


def to_requests(df: DataFrame, per: str = "series_key") -> DataFrame:
    """Requests of one series each, the inverse of parse."""
    labels = F.transform(F.map_entries("labels"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    each = df.groupBy(per).agg(F.any_value("name").alias("name"), F.any_value(labels).alias("labels"), F.transform(F.sort_array(F.collect_list(F.struct("ts", "seq", "value"))), lambda s: F.struct(s["ts"].alias("timestamp_ms"), s["value"].alias("value"))).alias("samples"))
    return each.select(F.to_json(F.struct(F.array(F.struct("name", "labels", "samples")).alias("time_series"))).alias("value"))
