"""Synthetic host metrics by seed: counters, processor loads with spikes, drifting memory, gauges and ratios, on a daily rhythm."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoframe.model import samples

#: Hosts of each role.
HOSTS = {"web": 3, "database": 2, "cache": 1, "queue": 1, "loadbalancer": 1}
#: What the hosts of a role measure: metric, kind, base, noise.
PROFILES = {
    "web": [("page_views_total", "counter", 90, 15), ("page_seconds", "gauge", 0.06, 0.02), ("open_sessions", "gauge", 150, 25), ("cpu_percent", "cpu", 42, 6), ("memory_bytes", "memory", 3.5e9, 1e8)],
    "database": [("statements_total", "counter", 420, 60), ("open_cursors", "gauge", 25, 8), ("replica_lag_bytes", "gauge", 2048, 700), ("cpu_percent", "cpu", 38, 7), ("memory_bytes", "memory", 9e9, 2e8), ("disk_bytes_total", "counter", 9e5, 4e5)],
    "cache": [("lookups_total", "counter", 1800, 220), ("hit_ratio", "ratio", 0.93, 0.03), ("stored_bytes", "memory", 2.5e9, 1e8), ("clients", "gauge", 60, 12), ("cpu_percent", "cpu", 18, 5)],
    "queue": [("messages_total", "counter", 900, 110), ("publishes", "gauge", 210, 45), ("deliveries", "gauge", 205, 45), ("backlog", "gauge", 40, 25), ("cpu_percent", "cpu", 22, 5), ("memory_bytes", "memory", 2.8e9, 2e8)],
    "loadbalancer": [("requests_total", "counter", 330, 40), ("open_connections", "gauge", 230, 50), ("upstream_seconds", "gauge", 0.03, 0.01), ("failed_ratio", "ratio", 0.003, 0.001), ("cpu_percent", "cpu", 14, 4)],
}


def diurnal(ts):
    """0.5 + 0.3 sin: largest at 14:00 UTC, smallest at 02:00."""
    hour = F.pmod(ts, F.lit(86_400_000)) / 3_600_000.0
    return 0.5 + 0.3 * F.sin((hour - 14) * math.pi / 12 + math.pi / 2)


def uniform(seed: int, *columns: str) -> Column:
    """In (0, 1), by hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + 0.5) * F.lit(2.0**-53)


def normal(seed: int, *columns: str) -> Column:
    """Standard normal, by hash (Box and Muller)."""
    return F.sqrt(-2 * F.log(uniform(seed, *columns))) * F.cos(2 * math.pi * uniform(seed + 1, *columns))


def generate(spark: SparkSession, start: int, ticks: int, step_ms: int = 5000, seed: int = 42) -> DataFrame:
    """Samples of every host and metric at each tick.

    Counters rise by a noisy share of their base. A processor is in [0, 100]; once
    in a hundred ticks it spikes, and the spike decays by 0.85 a tick. Memory
    drifts up until it is freed, which happens three times in a thousand ticks.
    Ratios are in [0, 1], gauges not negative.
    """
    grid = spark.range(ticks).select((F.lit(start) + F.col("id") * step_ms).alias("ts"), F.col("id").alias("tick"))
    each = [F.struct(F.lit(f"{role}-{i:02d}").alias("host"), F.lit(role).alias("role"), F.lit(m).alias("name"), F.lit(k).alias("kind"), F.lit(float(b)).alias("base"), F.lit(float(n)).alias("noise")) for role, hosts in HOSTS.items() for i in range(1, hosts + 1) for m, k, b, n in PROFILES[role]]
    rows = grid.select("ts", "tick", F.explode(F.array(*each)).alias("s")).select("ts", "tick", "s.*")
    key = ("host", "name", "tick")
    rows = rows.withColumns({"load": F.col("base") * diurnal(F.col("ts")), "z": F.col("noise") * normal(seed, *key)})
    upto = Window.partitionBy("host", "name").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    spiked = (F.col("kind") == "cpu") & (uniform(seed + 2, *key) < 0.01)
    freed = (F.col("kind") == "memory") & (uniform(seed + 3, *key) < 0.003)
    rows = rows.withColumns({
        "risen": F.sum(F.when(F.col("kind") == "counter", F.greatest(F.lit(0.0), F.col("load") + F.col("z")))).over(upto),
        "drift": F.sum(F.when(F.col("kind") == "memory", F.col("noise") * 0.01 * uniform(seed + 4, *key))).over(upto),
        "last": F.last(F.when(spiked, F.struct("tick", ((2 + uniform(seed + 5, *key)) * 0.3 * F.col("base")).alias("size"))), ignorenulls=True).over(upto),
    })
    rows = rows.withColumn("freed", F.coalesce(F.last(F.when(freed, F.col("drift")), ignorenulls=True).over(upto), F.lit(0.0)))
    spike = F.coalesce(F.col("last.size") * F.pow(F.lit(0.85), F.col("tick") - F.col("last.tick") + 1), F.lit(0.0))
    least = lambda v: F.greatest(F.lit(0.0), v)
    value = (
        F.when(F.col("kind") == "counter", F.round("risen"))
        .when(F.col("kind") == "cpu", F.round(F.least(F.lit(100.0), least(F.col("load") + F.col("z") + spike)), 1))
        .when(F.col("kind") == "memory", F.round(least(F.col("base") + F.col("drift") - F.col("freed") + 0.1 * F.col("z"))))
        .when(F.col("kind") == "ratio", F.round(F.least(F.lit(1.0), least(F.col("base") + F.col("z"))), 3))
        .otherwise(F.round(least(F.col("load") + F.col("z")), 2))
    )
    return samples(rows.withColumn("v", value), F.col("name"), {"host": F.col("host"), "role": F.col("role")}, F.col("ts"), F.col("v"), F.col("tick"))


PATTERNS = ("regular", "irregular", "spiky")


def pattern(spark: SparkSession, n: int, kind: str = "regular", start: int = 1_700_000_000_000, seed: int = 42) -> DataFrame:
    """n samples of one series for measuring the codec.

    regular: every 5 s, whole numbers in [0, 100] that change three times in ten.
    irregular: the same values 1 to 31 s apart. spiky: every 5 s, noise about 45
    and one value in a hundred above 95.
    """
    if kind not in PATTERNS:
        raise ValueError(f"unknown pattern {kind!r}")
    upto = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)  # one series is one sequence
    rows = spark.range(n).withColumns({"gap": F.lit(5000) if kind != "irregular" else 1000 + F.floor(30_000 * uniform(seed + 1, "id")), "step": F.when(uniform(seed + 2, "id") < 0.3, F.floor(3 * normal(seed + 3, "id"))).otherwise(F.lit(0))})
    walk = F.pmod(F.lit(50) + F.sum("step").over(upto), F.lit(200))
    calm = 45 + 3 * normal(seed + 5, "id")
    value = F.when(uniform(seed + 7, "id") < 0.01, 95 + 5 * uniform(seed + 8, "id")).otherwise(calm) if kind == "spiky" else F.when(walk > 100, 200 - walk).otherwise(walk).cast("double")
    return samples(rows.withColumn("ts", F.lit(start) + F.sum("gap").over(upto)).withColumn("v", value), F.lit(kind), {}, F.col("ts"), F.col("v"), F.col("id"))
