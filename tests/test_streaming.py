import json

from chronoframe.engine import Engine
from chronoframe.sources import store
from chronoframe.streaming import ingest


def _write(path, number, rows):
    series = [{"name": "m", "labels": [{"name": "h", "value": h}], "samples": [{"timestamp_ms": t, "value": v}]} for h, t, v in rows]
    (path / f"{number}.json").write_text(json.dumps({"time_series": series}) + "\n")


def test_land(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        _write(source, i, [("a", 1000 * i, i), ("b", 1000 * i, 2 * i)])
    stream = ingest.request_stream(spark, str(source), 1)
    q = ingest.land(stream, str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination()
    got = ingest.landed(spark, str(tmp_path / "out"))
    stats = ingest.writer_stats(q, spark, str(tmp_path / "out")).first()
    assert tuple(stats) == (6, 3, 0)
    own = store.Store(spark, str(tmp_path / "out"))
    assert Engine(own).query('sum(m{h=~"a|b"})', 0, 9000).count() == 3
    assert sorted((r["series_key"], r["ts"], r["value"]) for r in got.collect()) == sorted((f"m{{h={h}}}", 1000 * i, float(k * i)) for i in range(3) for h, k in (("a", 1), ("b", 2)))
    assert own.compact() and own.samples().count() == 6


def _run(spark, df, name, mode, checkpoint):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_live(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(4):
        _write(source, i, [("a", 30_000 * i, i)])
    stream = ingest.request_stream(spark, str(source))
    latest = _run(spark, ingest.latest_stream(stream), "latest", "complete", str(tmp_path / "c1"))
    assert [(r["ts"], r["value"]) for r in latest] == [(90_000, 3.0)]
    rolled = _run(spark, ingest.rollup_stream(stream, 60_000), "rolled", "complete", str(tmp_path / "c2"))
    assert sorted((r["ts"], r["sum"], r["count"]) for r in rolled) == [(30_000, 1.0, 2), (90_000, 5.0, 2)]
    rates = _run(spark, ingest.rate_stream(stream), "rates", "complete", str(tmp_path / "c3"))
    assert sum(r["samples"] for r in rates) == 4
    last = _run(spark, ingest.last_samples_stream(stream, 2), "last", "update", str(tmp_path / "c4"))
    assert sorted(r["ts"] for r in last)[-2:] == [60_000, 90_000]


def test_request_stream_keeps_arrival(spark, tmp_path):
    """Equal series and timestamps: the first line of the older file wins."""
    import os

    source = tmp_path / "in"
    source.mkdir()
    for i, name in enumerate(("b", "a")):
        _write(source, name, [("x", 1000, 10 * i + 1), ("x", 1000, 10 * i + 2)])
        os.utime(source / f"{name}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    got = ingest.request_stream(spark, str(source))
    q = got.writeStream.format("memory").queryName("arrived").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("arrived").orderBy("seq").collect()
    assert [r["value"] for r in rows] == [1, 2, 11, 12] and len({r["seq"] for r in rows}) == 4
