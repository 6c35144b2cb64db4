"""Chunk codec: timestamps by delta of delta, values by XOR, most significant bit first.

Bits are gathered in one Python integer for each few points and leave as bytes,
so the work for a point is a handful of integer operations.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

M64 = (1 << 64) - 1
#: Prefix, prefix bits, payload bits, offset of the classes of a delta of delta.
CLASSES = ((0b10, 2, 7, 63), (0b110, 3, 9, 255), (0b1110, 4, 12, 2047))


def _bits(v: float) -> int:
    return struct.unpack(">Q", struct.pack(">d", v))[0]


def encode(points: Iterable[tuple[int, float]]) -> bytes:
    """A chunk of points in their order: count, first point raw, then codes. Nothing for no points."""
    points = list(points)
    if not points:
        return b""
    out = bytearray(struct.pack(">Iqd", len(points), *points[0]))
    time, value, step = points[0][0], _bits(points[0][1]), 0
    lead = trail = None
    held = size = 0
    for ts, v in points[1:]:
        now = ts - time
        change, time, step = now - step, ts, now
        if not change:
            code, n = 0, 1
        else:
            for prefix, p, width, offset in CLASSES:
                if -offset <= change <= offset + 1:
                    code, n = prefix << width | change + offset, p + width
                    break
            else:
                code, n = 0b1111 << 64 | change & M64, 68
        held, size = held << n | code, size + n
        bits = _bits(v)
        xor, value = bits ^ value, bits
        if not xor:
            held, size = held << 1, size + 1
        else:
            zeros, tail = min(64 - xor.bit_length(), 31), (xor & -xor).bit_length() - 1
            if lead is not None and zeros >= lead and tail >= trail:
                n = 64 - lead - trail
                held, size = held << n + 2 | 0b10 << n | xor >> trail, size + n + 2
            else:
                lead, trail = zeros, tail
                n = 64 - lead - trail
                held, size = held << n + 13 | (0b11 << 11 | lead << 6 | n & 63) << n | xor >> trail, size + n + 13
        if size >= 512:
            rest = size & 7
            out += (held >> rest).to_bytes(size >> 3, "big")
            held, size = held & (1 << rest) - 1, rest
    if size:
        out += (held << (-size & 7)).to_bytes((size + 7) >> 3, "big")
    return bytes(out)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.size = data, 0, 0, 0

    def take(self, n: int) -> int:
        if self.size < n:
            more = self.data[self.at : self.at + 64]
            self.at += len(more)
            self.held, self.size = self.held << 8 * len(more) | int.from_bytes(more, "big"), self.size + 8 * len(more)
            if self.size < n:
                raise EOFError
        self.size -= n
        out = self.held >> self.size
        self.held &= (1 << self.size) - 1
        return out


def decode(chunk: bytes | None) -> Iterator[tuple[int, float]]:
    """The chunk's points; a chunk cut short gives those that are whole."""
    if not chunk or len(chunk) < 20:
        return
    count, time, first = struct.unpack(">Iqd", chunk[:20])
    if not count:
        return
    yield time, first
    value, step, lead, trail = _bits(first), 0, 0, 0
    read = _Reader(chunk[20:]).take
    try:
        for _ in range(count - 1):
            change = 0
            if read(1):
                for _, _, width, offset in CLASSES:
                    if not read(1):
                        change = read(width) - offset
                        break
                else:
                    change = read(64)
                    change -= (change >> 63) << 64
            step += change
            time = (time + step + (1 << 63) & M64) - (1 << 63)  # steps beyond 64 bits wrap
            if read(1):
                if read(1):
                    lead, n = read(5), read(6) or 64
                    trail = 64 - lead - n
                value ^= read(64 - lead - trail) << trail
            yield time, struct.unpack(">d", struct.pack(">Q", value))[0]
    except EOFError:
        return


CHUNKS = "series_key string, name string, chunk_start bigint, points bigint, min_ts bigint, max_ts bigint, chunk binary"
POINTS = "series_key string, name string, ts bigint, value double"
#: Chunks, and decoded points, that leave in one batch.
OUT_CHUNKS, OUT_POINTS = 1024, 65_536


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def encode_chunks(df: DataFrame, width_ms: int = 86_400_000) -> DataFrame:
    """One chunk for each series and time block.

    Rows meet by series and block and are sorted in Spark, so a task reads the runs
    of equal keys as a stream and holds the points of one run; the width bounds them.
    """
    schema = _schema(CHUNKS)

    def runs(batches):
        key = name = start = None
        ts, values = [], []
        for batch in batches:
            keys, names, starts = (batch.column(i).to_pylist() for i in range(3))
            times, points = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            at = 0
            cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or starts[i] != starts[i - 1]]
            for end in [*cuts, len(keys)] if keys else []:
                if (keys[at], starts[at]) != (key, start):
                    if ts:
                        yield key, name, start, ts, values
                    key, name, start, ts, values = keys[at], names[at], starts[at], [], []
                ts += times[at:end]
                values += points[at:end]
                at = end
        if ts:
            yield key, name, start, ts, values

    def packed(batches):
        held = []
        for key, name, start, ts, values in runs(batches):
            held.append((key, name, start, len(ts), ts[0], ts[-1], encode(zip(ts, values, strict=True))))
            if len(held) >= OUT_CHUNKS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    start = F.expr(f"ts div {int(width_ms)}") * int(width_ms)
    rows = df.select("series_key", "name", start.alias("chunk_start"), "ts", "value", "seq")
    rows = rows.repartition("series_key", "chunk_start").sortWithinPartitions("series_key", "chunk_start", "ts", "seq")
    return rows.select("series_key", "name", "chunk_start", "ts", "value").mapInArrow(packed, CHUNKS)


def decode_chunks(chunks: DataFrame) -> DataFrame:
    """series_key, name, ts, value of all points, OUT_POINTS or one chunk's at a time."""
    schema = _schema(POINTS)

    def points(batches):
        keys, names, times, values = [], [], [], []
        for batch in batches:
            for key, name, chunk in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = list(decode(chunk))
                if not found:
                    continue
                ts, v = zip(*found, strict=True)
                keys += [key] * len(ts)
                names += [name] * len(ts)
                times += ts
                values += v
                if len(keys) >= OUT_POINTS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((keys, names, times, values), schema, strict=True)], schema=schema)
                    keys, names, times, values = [], [], [], []
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((keys, names, times, values), schema, strict=True)], schema=schema)

    return chunks.select("series_key", "name", "chunk").mapInArrow(points, POINTS)
