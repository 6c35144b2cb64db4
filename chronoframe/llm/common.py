"""What the operators share: reading tables, batched row maps, reliable checkpoints."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that are turned into Python objects at a time: very long texts must not meet in thousands.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, rows: Callable[[dict[str, list]], Iterable[tuple]], schema: str, batch_rows: int = BATCH_ROWS, finish: Callable[[], Iterable[tuple]] = tuple) -> DataFrame:
    """mapInArrow where `rows` turns one batch (column name -> Python list) into tuples.

    Input is handed on in slices of `batch_rows` rows, fewer where they hold more
    than BATCH_BYTES, and output leaves in slices of BATCH_ROWS. So Python holds
    one Arrow batch, which Spark itself bounds in rows and bytes, and a slice of
    either. `finish` gives further rows when a partition is through.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out_schema = to_arrow_schema(_parse_datatype_string(schema))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if batch_rows <= BATCH_ROWS:
            for batch in batches:
                step = max(1, min(batch_rows, batch.num_rows * BATCH_BYTES // max(batch.nbytes, 1)))
                for at in range(0, batch.num_rows, step):
                    yield batch.slice(at, step)
            return
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= batch_rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def packed(part):
            columns = list(zip(*part, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, out_schema, strict=True)], schema=out_schema)

        for batch in sliced(batches):
            for row in rows({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}):
                held.append(row)
                if len(held) >= BATCH_ROWS:
                    yield packed(held)
                    held = []
        for row in finish():
            held.append(row)
            if len(held) >= BATCH_ROWS:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


def release() -> None:
    """Give memory that a Python worker has freed back to the system: it stays beside the JVM when its task is through."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


#: Limits of what the JVM packs into one Arrow batch while a table of `materialized` is written.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Small Arrow batches for what runs inside; the session's own settings hold again afterwards."""
    before = {k: spark.conf.get(k, None) for k in ARROW}
    for k, v in ARROW.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Only a local session that names none gets a temporary folder of its own.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="chronoframe-"))
    return _OWN[0]


def materialized(df: DataFrame) -> DataFrame:
    """Cut the lineage: write `df` as a table in the shared folder and read it back.

    A lost executor costs nothing that is written. The tables of one application
    stand together in <folder>/chronoframe-<application id> and may go when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/chronoframe-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    schema = df.schema
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
