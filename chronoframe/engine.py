"""The engine: queries and metadata over any source of samples."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.errors import QueryError
from chronoframe.functions import codec
from chronoframe.operators import metadata
from chronoframe.operators.matchers import all_of, in_range
from chronoframe.plans.compiler import Compiler


class SampleSource(Protocol):
    """What the engine reads: all samples, and those of a metric in a range whose series match."""

    spark: SparkSession

    def samples(self) -> DataFrame: ...

    def scan(self, name: str, start: int, end: int, matchers=()) -> DataFrame: ...


class FrameSource:
    """A source over one samples DataFrame."""

    def __init__(self, df: DataFrame):
        self.spark, self._df = df.sparkSession, df

    def samples(self) -> DataFrame:
        return self._df

    def scan(self, name: str, start: int, end: int, matchers=()) -> DataFrame:
        """Plain predicates: Catalyst takes them to whatever the frame reads."""
        return self._df.filter((F.col("name") == name) & in_range(start, end) & all_of(matchers))


class Engine:
    """Lazy results; nothing runs before an action.

    `step` is accepted and has no effect: selectors give raw samples. `match`:
    what vector with vector arithmetic does, `first` (the left side) or `labels`.
    """

    def __init__(self, source: SampleSource | DataFrame, match: str = "first"):
        self.source = FrameSource(source) if isinstance(source, DataFrame) else source
        self.match = match

    def query(self, text: str, start: int, end: int, step: int | None = None) -> DataFrame:
        if start is None or end is None:
            raise QueryError("start and end are needed")
        return Compiler(self.source, start, end, self.match).run(text).drop("seq")

    def series(self) -> DataFrame:
        return metadata.series(self.source.samples())

    def labels(self) -> DataFrame:
        return metadata.label_names(self.source.samples())

    def label_values(self, label: str) -> DataFrame:
        return metadata.label_values(self.source.samples(), label)

    def stats(self, block_ms: int | None = None) -> DataFrame:
        """Counts and sizes.

        With a width of blocks: bytes of the chunks encoded by it, number of
        blocks, and bytes of the files of a source that has a stored layout.
        Without, nothing counts as packed and these sizes are 0.
        """
        df = self.source.samples()
        if block_ms is None:
            return metadata.stats(df)
        disk = self.source.disk_bytes() if hasattr(self.source, "disk_bytes") else 0
        return metadata.storage_stats(df, codec.encode_chunks(df, block_ms), block_ms, disk)

    def blocks(self, width_ms: int) -> DataFrame:
        return metadata.blocks(self.source.samples(), width_ms)
