import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoframe.engine import Engine
from chronoframe.functions import codec
from chronoframe.functions.sharding import Ring, fnv1a32, ring_hash, shard
from chronoframe.operators import metadata, output, rollup
from chronoframe.sources import generator, requests, store


def test_rollup(make):
    df = make([("m", {}, 1000 * i, i) for i in range(120)])
    got = [tuple(r)[2:] for r in rollup.rollup(df, 60_000).orderBy("ts").collect()]
    assert got == [(30_000, 0, 59, 29.5, 1770, 60), (90_000, 60, 119, 89.5, 5370, 60)]
    odd = make([("m", {}, t, v) for t, v in ((1000, 10), (25_000, 20), (55_000, 30), (65_000, 40), (90_000, 50))])
    assert [r["count"] for r in rollup.rollup(odd, 60_000).orderBy("ts").collect()] == [3, 2]
    assert rollup.rollup(odd, 0).count() == 0 and rollup.rollup(odd.limit(0), 60_000).count() == 0
    nan = rollup.rollup(make([("m", {}, 1, math.nan), ("m", {}, 2, 3)]), 60_000).first()
    assert (nan["min"], nan["max"], nan["count"]) == (3, 3, 2) and math.isnan(nan["sum"])
    assert rollup.rollup(make([("m", {}, -1, 1), ("m", {}, 1, 2)]), 60_000).count() == 1  # truncates towards zero


def test_storage_stats(make, spark, tmp_path):
    df = make([("m", {"i": str(i % 3)}, 40_000_000 * i, (i * 37) % 101) for i in range(50)])
    chunks = codec.encode_chunks(df, 86_400_000).collect()
    got = Engine(df).stats(86_400_000).first()
    size = sum(len(r["chunk"]) for r in chunks)
    assert (got["samples"], got["series"], got["raw_bytes"], got["chunk_bytes"], got["disk_bytes"]) == (50, 3, 800, size, 0)
    assert got["blocks"] == len({40_000_000 * i // 86_400_000 for i in range(50)}) and got["compression_ratio"] == pytest.approx(800 / size)
    store.write(df, str(tmp_path))
    files = sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file() and not f.name.endswith(".crc"))
    assert files > 0 and 0.9 * files <= Engine(store.Store(spark, str(tmp_path))).stats(86_400_000).first()["disk_bytes"] <= 1.1 * files
    empty = Engine(df.limit(0)).stats(86_400_000).first()
    assert (empty["chunk_bytes"], empty["blocks"], empty["compression_ratio"]) == (0, 0, 0)


def test_cascade_equals_direct(make):
    df = make([("m", {"i": str(i % 3)}, 7001 * i, (i * 37) % 101) for i in range(500)])
    a = rollup.cascade(rollup.rollup(df, 60_000), 3_600_000).orderBy("series_key", "ts").collect()
    assert a == rollup.rollup(df, 3_600_000).orderBy("series_key", "ts").collect()
    assert rollup.resolution_for(0, 3_600_000) == 0 and rollup.resolution_for(0, 86_400_000 * 365) == 3_600_000


def test_retention_and_blocks(make):
    df = make([("m", {"h": h}, 1000 * i, i) for i in range(50) for h in "ab"])
    blocks = metadata.blocks(df, 10_000)
    assert blocks.count() == 5 and blocks.agg(F.sum("num_samples")).first()[0] == 100
    assert rollup.retained(blocks, 50_000, 31_000).count() == 4 and rollup.expired(blocks, 50_000, 31_000).count() == 1
    assert metadata.retention_timeline(blocks, 60_000).filter("kind = 'head'").first()["from_ts"] == 49_000


def test_merge_prefers_the_first(make):
    block, recent = make([("m", {}, 1000 * i, 1) for i in range(60)]), make([("m", {}, 1000 * i, 2) for i in range(50, 100)])
    got = rollup.merge_sources(recent, block).orderBy("ts").collect()
    assert [r["ts"] for r in got] == [1000 * i for i in range(100)] and got[55]["value"] == 2


def test_metadata(make):
    e = Engine(make([("cpu", {"host": "a", "region": "us"}, 1, 1), ("cpu", {"host": "a", "region": "us"}, 2, 5), ("mem_total", {"host": "b", "dc": "dc1"}, 1, 1)]))
    assert [r[0] for r in e.labels().collect()] == ["__name__", "dc", "host", "region"]
    assert [r[0] for r in e.label_values("host").collect()] == ["a", "b"] and e.label_values("none").count() == 0
    assert {r["series_key"]: (r["sample_count"], r["last_value"]) for r in e.series().collect()} == {"cpu{host=a,region=us}": (2, 5), "mem_total{dc=dc1,host=b}": (1, 1)}
    assert (e.stats().first()["samples"], e.stats().first()["compression_ratio"]) == (3, 0)
    assert {r["name"]: r["type"] for r in metadata.metric_types(e.source.samples()).collect()} == {"cpu": "gauge", "mem_total": "counter"}
    assert {r[0] for r in metadata.varying_labels(e.query("cpu", 0, 9).unionByName(e.query("mem_total", 0, 9))).collect()} == {"__name__", "dc", "host", "region"}


def test_histogram(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (7.0,), (5000.0,)], "v double")
    h = metadata.latency_histogram(df, F.col("v"))
    assert [tuple(r) for r in h.orderBy("le").collect()] == [(1, 2), (5, 0), (10, 1), (25, 0), (50, 0), (100, 0), (250, 0), (500, 0), (1000, 1)]
    last = metadata.cumulative_histogram(h).orderBy(F.desc("le")).first()
    assert (last["cumulative"], last["sum_ms"]) == (4, 1012)


def test_sharding(spark):
    df = spark.createDataFrame([("metric_0",), ("cpu_usage_percent",), ("",)], "n string")
    assert [r[0] for r in df.select(fnv1a32(F.col("n"))).collect()] == [2310611454, 3701282015, 2166136261]
    names = spark.range(10).select(F.concat(F.lit("metric_"), "id").alias("n"))
    assert names.select(shard(F.col("n"), 3)).distinct().count() >= 2
    ring, more = Ring(["a", "b", "c"]), Ring(["a", "b", "c", "d"])
    keys = [f"key-{i}" for i in range(3000)]
    owners = [ring.owners(k)[0] for k in keys]
    assert all(abs(owners.count(n) - 1000) < 250 for n in "abc")
    assert sum(o != more.owners(k)[0] for o, k in zip(owners, keys, strict=True)) < 0.4 * len(keys)
    assert len(set(ring.owners("x", 2))) == 2 and len(ring.owners("x", 9)) == 3 and Ring([]).owners("x") == []
    got = spark.createDataFrame([(k,) for k in keys[:200]], "k string").select("k", ring.owner_column(F.col("k")), ring_hash(F.col("k"))).collect()
    assert all(r[1] == ring.owners(r[0])[0] and r[2] == Ring.hash(r[0]) for r in got)


def bits(points):
    return [(t, codec._bits(v)) for t, v in points]


CASES = {
    "sin": [(5000 * i, 50 + 10 * math.sin(i / 100)) for i in range(1000)], "const": [(i, 42.0) for i in range(500)], "one": [(7, 1.5)],
    "special": [(i, v) for i, v in enumerate([math.nan, math.inf, -math.inf, 0.0, -0.0, 1.7e308, 5e-324])],
    "gap": [(0, 1.0), (10**9, 2.0)] + [(10**9 + 5000 * i, 2.0) for i in range(1, 9)], "back": [(10, 1.0), (5, 2.0), (-(2**40), 3.0), (2**62, 4.0)],
}


@pytest.mark.parametrize("case", CASES)
def test_codec(case):
    assert bits(codec.decode(codec.encode(CASES[case]))) == bits(CASES[case])


def test_codec_edges():
    assert codec.encode([]) == b"" and list(codec.decode(None)) == [] and list(codec.decode(b"\0\0")) == []
    rng = random.Random(7)
    steady = [(1_700_000_000_000 + 5000 * i, float(100 + (rng.random() < 0.1))) for i in range(10_000)]
    chunk = codec.encode(steady)
    assert 16 * len(steady) / len(chunk) > 10
    short = list(codec.decode(chunk[: len(chunk) // 2]))
    assert short == steady[: len(short)] and len(short) > 1000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**62), 2**62), st.floats()), max_size=60))
def test_codec_any(points):
    assert bits(codec.decode(codec.encode(points))) == bits(points)


def test_codec_frames(make):
    df = make([("m", {"i": str(i % 3)}, 1000 * i, i / 7) for i in range(200)])
    got = codec.decode_chunks(codec.encode_chunks(df, 50_000)).orderBy("series_key", "ts").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in df.select("series_key", "name", "ts", "value").orderBy("series_key", "ts").collect()]


def test_requests(spark):
    good = {"time_series": [{"name": "m", "labels": [{"name": "a", "value": "1"}, {"name": "a", "value": "2"}], "samples": [{"timestamp_ms": 5, "value": 1.5}, {"timestamp_ms": 6, "value": 2}]}, {"name": "not valid", "labels": [], "samples": [{"timestamp_ms": 1, "value": 1}]}]}
    df = spark.createDataFrame([(0, json.dumps(good)), (1, "{broken")], "n int, value string")
    assert [(r["series_key"], r["ts"], r["value"]) for r in requests.parse(df, order="n").orderBy("ts").collect()] == [("m{a=2}", 5, 1.5), ("m{a=2}", 6, 2.0)]


def test_requests_keep_their_order(spark):
    one = lambda v: {"name": "m", "labels": [], "samples": [{"timestamp_ms": 5, "value": v}]}
    texts = [json.dumps({"time_series": [one(1), one(2)]}), json.dumps({"time_series": [one(3)]})]
    for df, order in ((spark.createDataFrame([(7, texts[0]), (9, texts[1])], "n int, value string"), "n"), (spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1), None)):
        got = requests.parse(df, order=order).orderBy("seq").collect()
        assert [r["value"] for r in got] == [1, 2, 3] and len({r["seq"] for r in got}) == 3
        assert Engine(requests.parse(df, order=order)).query("sum(m)", 0, 9).first()["value"] == 1
    together = spark.createDataFrame([(texts, 4)], "value array<string>, n int")
    assert [r["value"] for r in requests.parse(together, order="n").orderBy("seq").collect()] == [1, 2, 3]


def test_output_envelope(make):
    df = make([("m", {"k": k}, t, t / 2) for k in "ab" for t in (1, 2)])
    pieces = output.to_envelope(Engine(df).query("m", 0, 9)).orderBy("at").collect()
    got = json.loads("".join(r["text"] for r in pieces))
    assert got["status"] == "success" and got["data"]["resultType"] == "matrix"
    assert [(s["labels"]["k"], s["values"]) for s in got["data"]["result"]] == [("a", [[1, 0.5], [2, 1.0]]), ("b", [[1, 0.5], [2, 1.0]])]
    empty = output.to_envelope(Engine(df).query("none", 0, 9)).orderBy("at").collect()
    assert json.loads("".join(r["text"] for r in empty))["data"]["result"] == []
    assert json.loads(output.error_envelope(df.sparkSession, 'no "such"').first()["text"]) == {"status": "error", "error": 'no "such"'}


def test_plans_hash(make):
    """Aggregates over duplicates hash; an operand of arithmetic is read twice at most."""
    df = make([("m", {"k": str(i % 3)}, i // 2, i) for i in range(20)])
    plan = lambda q: Engine(df).query(q, 0, 99)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan("sum(m) by (k)") and "HashAggregate" in plan("sum(m) by (k)")
    assert plan("m / max(m)").count("Scan") <= 4 and plan("m / max(m)").count("NestedLoop") == 1
    assert "SortAggregate" not in Engine(df).series()._jdf.queryExecution().executedPlan().toString()


def test_output(make):
    res = Engine(make([("m", {"k": "v"}, 3_600_000, 1.5), ("m", {"k": "v"}, 3_601_000, math.nan)])).query("m", 0, 10**9)
    row = output.to_matrix(res).first()["json"]
    assert row == '{"name":"m","labels":{"__name__":"m","k":"v"},"values":[[3600000,1.5],[3601000,NaN]]}'
    assert tuple(output.to_table(res).orderBy("timestamp").first()) == ("m{k=v}", "01:00:00", "1.5000")
    assert tuple(output.to_csv(res).orderBy("timestamp").first()) == ("m", 3_600_000, "1.500000")


def test_store_prunes(make, spark, tmp_path):
    day = store.DAY
    df = make([("m", {"h": h}, d * day + 5, d) for d in range(4) for h in "ab"] + [("n", {}, 5, 1)])
    store.write(df, str(tmp_path))
    s = store.Store(spark, str(tmp_path))
    got = Engine(s).query('m{h="a"}', day, 2 * day + 10)
    assert sorted((r["ts"], r["series_key"]) for r in got.collect()) == [(day + 5, "m{h=a}"), (2 * day + 5, "m{h=a}")]
    plan = got._jdf.queryExecution().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x and "day#" in x)
    assert "(day#" in scan.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in scan
    read = [f for f in got.inputFiles() if "/samples/" in f]
    assert read and Engine(s).query("m", 0, 9).count() == 2
    assert Engine(s).query("sum(n)", 0, 9).first()["value"] == 1
    assert Engine(s).series().count() == 3 and s.series().count() == 3
    assert s.expire(3 * day, day) == [0, 1] and s.scan("m", 0, 9 * day).count() == 4
    assert sorted(r["series_key"] for r in s.series().collect()) == ["m{h=a}", "m{h=b}"]  # n has no sample left


def test_store_blocks_and_compaction(make, spark, tmp_path):
    day, path = store.DAY, str(tmp_path)
    rows = [("m", {"h": h}, d * day + i, d + i) for d in range(2) for h in "ab" for i in range(5)]
    whole = make(rows)
    for i in range(3):
        store.write(whole.filter(F.col("seq") % 3 == i), path, batch=f"b{i}")
    store.write(whole.filter("seq % 3 = 1"), path, batch="b1")  # the same batch again replaces itself
    s = store.Store(spark, path)
    same = lambda: sorted(tuple(r) for r in s.samples().select("series_key", "ts", "value", "seq").collect())
    before = same()
    assert len(before) == 20 and s.blocks().count() == 6
    (tmp_path / "samples" / "batch=b0" / "name=m" / "day=0" / "part-bad.parquet").write_bytes(b"no parquet")
    assert len(store.Store(spark, path, skip_unreadable=True).samples().collect()) == 20
    (tmp_path / "samples" / "batch=b0" / "name=m" / "day=0" / "part-bad.parquet").unlink()

    # cut short before the new batch is whole: readers see the old ones
    s._mark({"old": ["b0", "b1", "b2"], "new": "compacted-x", "done": False})
    store.write(whole.limit(3), path, "compacted-x")
    assert same() == before
    assert s.compact().startswith("compacted-") and same() == before and not (tmp_path / "_compaction.json").exists()
    assert {r["level"] for r in s.blocks().collect()} == {2} and s.compact() is None
    # cut short after that: readers see the new one, and the next call removes the old ones
    store.write(whole, path, "late")
    s._mark({"old": [b for b in s._batches() if b != "late"], "new": "late", "done": True})
    assert same() == before and s.compact() == "late" and same() == before
    block = s.blocks().filter("min_time < 86400000").first()
    assert s.delete_block(block["block_id"]) and not s.delete_block("late/77") and len(same()) == 10


def test_generator(spark):
    df = generator.generate(spark, 0, 400).cache()
    assert df.count() == 400 * 43 and df.select(F.map_values("labels")).distinct().count() == 8
    assert df.filter("name = 'cpu_percent' and (value < 0 or value > 100)").isEmpty() and df.filter("name like '%ratio' and (value < 0 or value > 1)").isEmpty()
    from pyspark.sql import Window

    fall = F.col("value") < F.lag("value").over(Window.partitionBy("series_key").orderBy("ts"))
    assert df.filter("name like '%_total'").withColumn("fall", fall).filter("fall").isEmpty()
    hours = spark.range(24).select("id", generator.diurnal(F.col("id") * 3_600_000).alias("d"))
    assert hours.orderBy(F.desc("d")).first()["id"] == 14
    assert generator.generate(spark, 0, 5).drop("labels").exceptAll(df.drop("labels")).isEmpty()  # by seed
    # memory drifts up until it is freed; a spike stands out and decays
    before = F.lag("value").over(Window.partitionBy("series_key").orderBy("ts"))
    steps = df.filter("name = 'cpu_percent'").withColumn("rise", F.col("value") - before)
    assert steps.agg(F.max("rise")).first()[0] > 15


def test_bench_patterns(spark):
    from pyspark.sql import Window

    for kind in generator.PATTERNS:
        df = generator.pattern(spark, 3000, kind)
        gap = F.col("ts") - F.lag("ts").over(Window.orderBy("ts"))
        low, high = df.withColumn("gap", gap).agg(F.min("gap"), F.max("gap")).first()
        assert (low, high) == (5000, 5000) if kind != "irregular" else 1000 <= low < 2000 and 30_000 < high <= 31_000
        assert df.count() == 3000 and df.filter("value < 0 or value > 100").isEmpty()
        chunk = codec.encode_chunks(df, 10**12).first()["chunk"]
        assert len(chunk) < 16 * 3000
    assert df.filter("value >= 95").count() in range(10, 60)
    with pytest.raises(ValueError, match="unknown pattern"):
        generator.pattern(spark, 1, "other")
