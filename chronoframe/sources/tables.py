"""Sample sources over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.model import millis, samples


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _user():
    return {"user": F.col("user_id")}


def events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a sample of its type's metric, by user."""
    return samples(read(spark, sf_dir, "events"), F.col("event_type"), _user(), millis("ts"), F.col("value"), F.col("event_id"))


def events_bucket(spark: SparkSession, sf_dir: str, width_ms: int = 86_400_000) -> DataFrame:
    """Sums of the events' values on a grid of `width_ms`: aligned samples."""
    at = millis("ts") - F.pmod(millis("ts"), F.lit(width_ms))
    sums = read(spark, sf_dir, "events").groupBy("event_type", "user_id", at.alias("at")).agg(F.round(F.sum("value"), 2).alias("total"))
    return samples(sums, F.col("event_type"), _user(), F.col("at"), F.col("total"), F.lit(0))


def events_counter(spark: SparkSession, sf_dir: str, modulo: int | None = None) -> DataFrame:
    """A counter of each series' events; with `modulo` it resets."""
    from pyspark.sql import Window

    order = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    n = F.row_number().over(order)
    df = read(spark, sf_dir, "events").withColumn("n", (n % modulo if modulo else n).cast("double"))
    return samples(df, F.concat("event_type", F.lit("_total")), _user(), millis("ts"), F.col("n"), F.col("event_id"))


def lineitem_ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items' quantities at their ship date: many samples of a series at one timestamp.

    The table holds no order of arrival. Order and line number stand in for it, and
    the quantity settles the few rows that agree in both: a tie by value.
    """
    labels = {"returnflag": F.col("l_returnflag"), "linestatus": F.col("l_linestatus")}
    return samples(read(spark, sf_dir, "lineitem"), F.lit("l_quantity"), labels, millis("l_shipdate"), F.col("l_quantity"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100 + F.col("l_quantity").cast("long"))
