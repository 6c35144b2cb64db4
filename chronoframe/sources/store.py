"""Storage layout: samples in Parquet by batch, metric name and day, sorted by series and time.

    <path>/samples/batch=<id>/name=<metric>/day=<n>/*.parquet
    <path>/series/batch=<id>/name=<metric>/*.parquet
    <path>/_compaction.json        only while a compaction is under way

Every write is a batch of its own, so writing a batch again replaces it, and
streamed and batch data stand side by side. A query's name and range prune
directories; row groups are skipped by timestamp. Label predicates, which Parquet
cannot push down, are answered from the far smaller series table and reach the
samples as a semi-join.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.model import SAMPLES, distinct_series
from chronoframe.operators.matchers import all_of, in_range

DAY = 86_400_000
COLUMNS = [c.split()[0] for c in SAMPLES.split(", ")]
SERIES = "series_key string, name string, labels map<string,string>"


def write(df: DataFrame, path: str, batch: str | None = None, files_per_day: int = 1, rows_per_file: int = 5_000_000) -> str:
    """Write samples and their series as a batch, replacing one of the same id; returns the id.

    Rows of a name and day meet in `files_per_day` tasks, by series: hot metrics take
    several. A file holds `rows_per_file` at most.
    """
    batch = batch or uuid.uuid4().hex
    day = F.expr(f"ts div {DAY}").cast("int")
    spread = F.pmod(F.xxhash64("series_key"), F.lit(files_per_day))
    rows = df.select(*COLUMNS).withColumn("day", day).repartition("name", "day", spread).sortWithinPartitions("name", "day", "series_key", "ts")
    rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("name", "day").parquet(f"{path}/samples/batch={batch}")
    written = df.sparkSession.read.schema(SAMPLES + ", day int").parquet(f"{path}/samples/batch={batch}")
    distinct_series(written).write.mode("overwrite").partitionBy("name").parquet(f"{path}/series/batch={batch}")
    return batch


class Store:
    """A source over a stored layout.

    skip_unreadable: files that are no Parquet are passed over instead of failing
    the query.
    """

    def __init__(self, spark: SparkSession, path: str, skip_unreadable: bool = False):
        self.spark, self.path, self.skip = spark, path, skip_unreadable

    def _fs(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _batches(self, table: str = "samples") -> list[str]:
        """Ids of the batches; during a compaction either those it replaces or the one that replaces them."""
        fs, path = self._fs()
        found = sorted(s.getPath().getName().split("=", 1)[1] for s in fs.globStatus(path(f"{self.path}/{table}/batch=*")) or [])
        if state := self._compacting():
            gone = set(state["old"]) if state["done"] else {state["new"]}
            found = [b for b in found if b not in gone]
        return found

    def _read(self, table: str, schema: str) -> DataFrame:
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").option("ignoreCorruptFiles", self.skip).option("ignoreMissingFiles", self.skip)
        batches = self._batches(table)
        if not batches:
            return self.spark.createDataFrame([], schema)
        whole = f"{self.path}/{table}"
        return reader.parquet(*([f"{whole}/batch={b}" for b in batches] if self._compacting() else [whole]))

    def _rows(self) -> DataFrame:
        return self._read("samples", SAMPLES + ", batch string, day int")

    def samples(self) -> DataFrame:
        return self._rows().select(*COLUMNS)

    def series(self) -> DataFrame:
        """A row for each series."""
        return distinct_series(self._read("series", SERIES + ", batch string"))

    def scan(self, name: str, start: int, end: int, matchers=()) -> DataFrame:
        """Samples of a metric in a range whose series match; other names, and days outside the range, are not listed."""
        days = F.col("day").between(int(start / DAY), int(end / DAY))
        rows = self._rows().filter((F.col("name") == name) & days & in_range(start, end))
        if matchers:
            wanted = self._read("series", SERIES + ", batch string").filter((F.col("name") == name) & all_of(matchers)).select("series_key")
            rows = rows.join(wanted, "series_key", "left_semi")
        return rows.select(*COLUMNS)

    def blocks(self) -> DataFrame:
        """The stored blocks, one for each batch and day: block_id, bounds, samples, series, level."""
        rows = self._rows().withColumn("block_id", F.concat("batch", F.lit("/"), "day"))
        out = rows.groupBy("block_id").agg(F.min("ts").alias("min_time"), F.max("ts").alias("max_time"), F.count("*").alias("num_samples"), F.countDistinct("series_key").alias("num_series"))
        return out.withColumn("level", F.when(F.col("block_id").startswith("compacted-"), 2).otherwise(1))

    def delete_block(self, block_id: str) -> bool:
        """Remove one block by its id; false if there is none."""
        batch, day = block_id.rsplit("/", 1)
        fs, path = self._fs()
        found = fs.globStatus(path(f"{self.path}/samples/batch={batch}/name=*/day={int(day)}")) or []
        gone = [fs.delete(f.getPath(), True) for f in found]
        self._forget_series([batch])
        return any(gone)

    def disk_bytes(self) -> int:
        """Bytes of the stored layout's files."""
        fs, path = self._fs()
        return fs.getContentSummary(path(self.path)).getLength()

    def expire(self, now: int, keep_ms: int) -> list[int]:
        """Remove whole days that end before now - keep_ms, and series that have no sample left; returns the days."""
        fs, path = self._fs()
        gone, batches = set(), set()
        for found in fs.globStatus(path(f"{self.path}/samples/batch=*/name=*/day=*")) or []:
            day = int(found.getPath().getName().split("=")[1])
            if (day + 1) * DAY - 1 < now - keep_ms:
                fs.delete(found.getPath(), True)
                gone.add(day)
                batches.add(found.getPath().getParent().getParent().getName().split("=", 1)[1])
        self._forget_series(sorted(batches))
        return sorted(gone)

    def _forget_series(self, batches: list[str]) -> None:
        """Write the series tables of batches that lost samples anew."""
        fs, path = self._fs()
        for batch in batches:
            if not fs.globStatus(path(f"{self.path}/samples/batch={batch}/name=*/day=*")):
                fs.delete(path(f"{self.path}/samples/batch={batch}"), True)
                fs.delete(path(f"{self.path}/series/batch={batch}"), True)
                continue
            rows = self.spark.read.schema(SAMPLES + ", day int").parquet(f"{self.path}/samples/batch={batch}")
            distinct_series(rows).write.mode("overwrite").partitionBy("name").parquet(f"{self.path}/series/batch={batch}")

    def _compacting(self) -> dict | None:
        fs, path = self._fs()
        marker = path(f"{self.path}/_compaction.json")
        if not fs.exists(marker):
            return None
        stream = fs.open(marker)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _mark(self, state: dict) -> None:
        fs, path = self._fs()
        out = fs.create(path(f"{self.path}/_compaction.json"), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()

    def compact(self, files_per_day: int = 1) -> str | None:
        """Rewrite all batches as one of large sorted files; returns its id, or None if there is nothing to join.

        A marker names the batches and the one that replaces them before it appears
        and turns readers over when it is whole, so a compaction cut short loses and
        doubles nothing; the next call ends it. One compaction at a time.
        """
        fs, path = self._fs()
        state = self._compacting()
        if not state or not state["done"]:
            if state:
                for table in ("samples", "series"):
                    fs.delete(path(f"{self.path}/{table}/batch={state['new']}"), True)
                fs.delete(path(f"{self.path}/_compaction.json"), False)
            old = self._batches()
            if len(old) < 2:
                return None
            state = {"old": old, "new": f"compacted-{uuid.uuid4().hex}", "done": False}
            rows = self.samples()
            self._mark(state)
            write(rows, self.path, state["new"], files_per_day)
            self._mark(state | {"done": True})
        for batch in state["old"]:
            for table in ("samples", "series"):
                fs.delete(path(f"{self.path}/{table}/batch={batch}"), True)
        fs.delete(path(f"{self.path}/_compaction.json"), False)
        return state["new"]
