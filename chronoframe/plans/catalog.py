"""Registry of the engine's queries and their SQL oracles.

Every query is a thin use of the engine over one of the table sources; results
show labels as string columns and floats rounded, so that they compare by value.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.engine import Engine
from chronoframe.functions import codec
from chronoframe.functions.sharding import Ring, fnv1a32, shard
from chronoframe.operators import matchers, metadata, output, rollup
from chronoframe.sources import generator, requests, store, tables

DAY = 86_400_000
T0 = 1_704_067_200_000  # 2024-01-01
#: The whole table, and a part of it for the queries whose feature is the range.
START, END = T0, T0 + 30 * DAY
PART = T0 + 8 * DAY

#: The sources in DuckDB.
RAW = "raw as (select event_type as name, cast(user_id as varchar) as usr, event_type || '{user=' || user_id || '}' as series_key, epoch_us(ts) // 1000 as ts, value, event_id as seq from events)"
BUCKET = f"bucket as (select event_type as name, cast(user_id as varchar) as usr, event_type || '{{user=' || user_id || '}}' as series_key, (epoch_us(ts) // 1000) // {DAY} * {DAY} as ts, round(sum(value), 2) as value from events group by 1, 2, 3, 4)"
COUNTER = "counter as (select event_type || '_total' as name, cast(user_id as varchar) as usr, event_type || '_total{user=' || user_id || '}' as series_key, epoch_us(ts) // 1000 as ts, cast(row_number() over (partition by event_type, user_id order by ts, event_id) %s as double) as value, event_id as seq from events)"
SHIP = "ship as (select l_returnflag as rf, l_linestatus as ls, epoch_us(l_shipdate) // 1000 as ts, l_quantity as value, (l_orderkey * 8 + l_linenumber) * 100 + l_quantity::bigint as seq from lineitem)"
FIRST = "ship1 as (select rf, ls, ts, arg_min(value, seq) as value from ship group by all)"
RATE = "lagged as (select *, lag(value) over (partition by series_key order by ts, seq) as before from src), rates as (select series_key, any_value(name) as name, any_value(usr) as usr, max(ts) as ts, sum(case when before is null then 0 when value >= before then value - before else value end) / ((max(ts) - min(ts)) / 1000.0) as value from lagged group by series_key having count(*) >= 2 and max(ts) > min(ts))"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def shown(df: DataFrame, **labels: str) -> DataFrame:
    """Columns label as given, ts, value rounded."""
    cols = [F.coalesce(F.try_element_at("labels", F.lit(k)), F.lit("")).alias(c) for c, k in labels.items()]
    return df.select(*cols, "ts", F.round("value", 6).alias("value"))


def _text(name: str, source, text: str, labels: dict[str, str], sql: str, start: int = START, end: int = END, match: str = "first") -> None:
    QUERIES[name] = lambda spark, d: shown(Engine(source(spark, d), match).query(text, start, end), **labels)
    SQL[name] = sql


def _between(start: int = START, end: int = END) -> str:
    return f"ts between {start} and {end}"


METRIC_USER = {"metric": "__name__", "usr": "user"}
_raw = lambda where: f"with {RAW} select name as metric, usr, ts, round(value, 6) as value from raw where {where}"
_text("select_all", tables.events_raw, "view", METRIC_USER, _raw(f"name = 'view' and {_between(0, 10**13)}"), 0, 10**13)
_text("match_eq", tables.events_raw, 'view{user="7"}', METRIC_USER, _raw(f"name = 'view' and usr = '7' and {_between()}"))
_text("match_ne", tables.events_raw, 'click{user!="7"}', METRIC_USER, _raw(f"name = 'click' and usr <> '7' and {_between()}"))
_text("match_re", tables.events_raw, 'view{user=~"1.*|2"}', METRIC_USER, _raw(f"name = 'view' and regexp_full_match(usr, '1.*|2') and {_between()}"))
_text("match_nre", tables.events_raw, 'view{user!~"1.*|2"}', METRIC_USER, _raw(f"name = 'view' and not regexp_full_match(usr, '1.*|2') and {_between()}"))
_text("match_multi", tables.events_raw, 'error{user=~"[0-9]",user!="3",user!~"[45]"}', METRIC_USER, _raw(f"name = 'error' and length(usr) = 1 and usr not in ('3', '4', '5') and {_between()}"))
_text("match_absent", tables.events_raw, 'view{host!="a"}', METRIC_USER, _raw("false"))
_text("time_range", tables.events_raw, "purchase", METRIC_USER, _raw(f"name = 'purchase' and {_between(PART, PART + DAY)}"), PART, PART + DAY)
_text("range_selector", tables.events_raw, "signup[1d]", METRIC_USER, _raw(f"name = 'signup' and {_between(PART - 2 * DAY, PART + 12 * DAY)}"), PART, PART + 12 * DAY)
_text("match_re2", tables.events_raw, r'view{user=~"[[:digit:]]\\pN?"}', METRIC_USER, _raw(f"name = 'view' and length(usr) <= 2 and {_between()}"))

_rate_src = f"src as (select * from counter where name = 'view_total' and {_between(START - 2 * DAY)})"
_text("rate", tables.events_counter, "rate(view_total[1d])", METRIC_USER, f"with {COUNTER % ''}, {_rate_src}, {RATE} select name as metric, usr, ts, round(value, 6) as value from rates")
_text("rate_reset", lambda s, d: tables.events_counter(s, d, 5), "rate(view_total[1d])", METRIC_USER, f"with {COUNTER % '% 5'}, {_rate_src}, {RATE} select name as metric, usr, ts, round(value, 6) as value from rates")
_text("rate_vector", tables.events_counter, "rate(click_total)", METRIC_USER, f"with {COUNTER % ''}, src as (select * from counter where name = 'click_total' and {_between()}), {RATE} select name as metric, usr, ts, round(value, 6) as value from rates")

for _op in ("sum", "avg", "min", "max", "count"):
    _text(_op, tables.events_bucket, f"{_op}(view)", {}, f"with {BUCKET} select ts, round(cast({_op}(value) as double), 6) as value from bucket where name = 'view' and {_between()} group by ts")
_text("sum_by", tables.lineitem_ship, "sum(l_quantity) by (returnflag)", {"returnflag": "returnflag"}, f"with {SHIP}, {FIRST} select rf as returnflag, ts, round(sum(value), 6) as value from ship1 group by rf, ts", 0, 10**13)
_text("avg_by_prefix", tables.lineitem_ship, "avg by (linestatus, returnflag) (l_quantity)", {"returnflag": "returnflag", "linestatus": "linestatus"}, f"with {SHIP}, {FIRST} select rf as returnflag, ls as linestatus, ts, round(avg(value), 6) as value from ship1 group by rf, ls, ts", 0, 10**13)
_text("by_name", tables.events_bucket, "max(view) by (__name__)", {"metric": "__name__"}, f"with {BUCKET} select name as metric, ts, round(max(value), 6) as value from bucket where name = 'view' and {_between()} group by name, ts")
_text("by_missing_label", tables.events_bucket, "sum(view) by (host)", {"host": "host"}, f"with {BUCKET} select '' as host, ts, round(sum(value), 6) as value from bucket where name = 'view' and {_between()} group by ts")
_text("nested_agg", tables.lineitem_ship, "max(sum(l_quantity) by (returnflag))", {}, f"with {SHIP}, {FIRST}, s as (select rf, ts, sum(value) as v from ship1 group by rf, ts) select ts, round(max(v), 6) as value from s group by ts", 0, 10**13)
_text("sum_rate_by", tables.events_counter, "sum(rate(view_total[7d])) by (user)", {"usr": "user"}, f"with {COUNTER % ''}, src as (select * from counter where name = 'view_total' and {_between(START - 14 * DAY)}), {RATE} select usr, ts, round(value, 6) as value from rates")
for _name, _q in (("quantile", 0.5), ("quantile_low", 0.07), ("quantile_max", 1)):
    _text(_name, tables.events_raw, f"histogram_quantile({_q}, view)", METRIC_USER, f"with {RAW}, r as (select *, row_number() over (partition by series_key order by value) as rn, count(*) over (partition by series_key) as n, max(ts) over (partition by series_key) as last from raw where name = 'view' and {_between()}) select name as metric, usr, last as ts, round(value, 6) as value from r where rn = greatest(1, least(n, ceil(cast({_q} as double) * n)))")

_text("arith_scalar_right", tables.events_bucket, "view * 100", METRIC_USER, f"with {BUCKET} select name as metric, usr, ts, round(value * 100, 6) as value from bucket where name = 'view' and {_between()}")
_text("arith_scalar_left", tables.events_bucket, "1000 - view", METRIC_USER, f"with {BUCKET} select name as metric, usr, ts, round(1000 - value, 6) as value from bucket where name = 'view' and {_between()}")
_text("arith_div_zero", tables.events_bucket, "view / 0", METRIC_USER, f"with {BUCKET} select name as metric, usr, ts, cast(0 as double) as value from bucket where name = 'view' and {_between()}")
_text("arith_vec_vec", tables.events_bucket, "view + click", METRIC_USER, f"with {BUCKET} select name as metric, usr, ts, round(value, 6) as value from bucket where name = 'view' and {_between()}")
_text("arith_precedence", tables.events_bucket, "(view + 2) * 3 - 4 / 2", METRIC_USER, f"with {BUCKET} select name as metric, usr, ts, round((value + 2) * 3 - 2, 6) as value from bucket where name = 'view' and {_between()}")
_text("arith_one_row", tables.events_bucket, "view / histogram_quantile(1, sum(view))", METRIC_USER, f"with {BUCKET}, v as (select * from bucket where name = 'view' and {_between()}), m as (select max(s) as m from (select sum(value) as s from v group by ts)) select name as metric, usr, ts, round(value / m, 6) as value from v, m")
_text("arith_vec_vec_labels", tables.events_bucket, "view - click", METRIC_USER, f"with {BUCKET} select a.name as metric, a.usr, a.ts, round(a.value - b.value, 6) as value from bucket a join bucket b using (usr, ts) where a.name = 'view' and b.name = 'click' and ts between {START} and {END}", match="labels")
_text("number_literal", tables.events_bucket, "2 * 3 + 1", {}, f"select cast({END} as bigint) as ts, cast(7 as double) as value")
_ranked = "with {b}, r as (select *, row_number() over (partition by ts order by value {way}, series_key) as k from bucket where name = 'view' and {when}) select name as metric, usr, ts, round(value, 6) as value from r where k <= 3"
_text("topk", tables.events_bucket, "topk(3, view)", METRIC_USER, _ranked.format(b=BUCKET, way="desc", when=_between()))
_text("bottomk", tables.events_bucket, "bottomk(3, view)", METRIC_USER, _ranked.format(b=BUCKET, way="asc", when=_between()))
_text("without", tables.lineitem_ship, "sum(l_quantity) without (returnflag)", {"linestatus": "linestatus"}, f"with {SHIP}, {FIRST} select ls as linestatus, ts, round(sum(value), 6) as value from ship1 group by ls, ts", 0, 10**13)


def _rolled(width: int) -> str:
    return f"select series_key, cast({width} as bigint) as resolution_ms, ts // {width} * {width} + {width // 2} as ts, min(value) as min, max(value) as max, round(avg(value), 6) as avg, round(sum(value), 6) as sum, count(*) as count from raw group by 1, 2, 3"


def _round(df: DataFrame) -> DataFrame:
    return df.withColumns({"avg": F.round("avg", 6), "sum": F.round("sum", 6)})


QUERIES["rollup_1m"] = lambda s, d: _round(rollup.rollup(tables.events_raw(s, d), 60_000))
QUERIES["rollup_1h"] = lambda s, d: _round(rollup.rollup(tables.events_raw(s, d), 3_600_000))
QUERIES["rollup_cascade"] = lambda s, d: _round(rollup.cascade(rollup.rollup(tables.events_raw(s, d), 60_000), 3_600_000))
SQL |= {"rollup_1m": f"with {RAW} {_rolled(60_000)}", "rollup_1h": f"with {RAW} {_rolled(3_600_000)}", "rollup_cascade": f"with {RAW} {_rolled(3_600_000)}"}

_BLOCKS = f"with {RAW} select ts // {DAY} * {DAY} as block_start, min(ts) as min_time, max(ts) as max_time, count(*) as num_samples, count(distinct series_key) as num_series, 1 as level from raw group by 1"
NOW = T0 + 30 * DAY


@_query("blocks", _BLOCKS)
def _blocks(spark, d):
    return Engine(tables.events_raw(spark, d)).blocks(DAY)


@_query("retention", f"select * from ({_BLOCKS}) where max_time >= {NOW - 15 * DAY}")
def _retention(spark, d):
    return rollup.retained(_blocks(spark, d), NOW, 15 * DAY)


@_query("retention_timeline", f"select 'block' as kind, min_time as from_ts, max_time as to_ts from ({_BLOCKS}) union all select 'head', max(max_time), {NOW} from ({_BLOCKS})")
def _timeline(spark, d):
    return metadata.retention_timeline(_blocks(spark, d), NOW)


@_query("dedupe_merge", f"with {RAW} select series_key, ts, case when seq % 3 = 0 then -1.0 else value end as value from raw")
def _merge(spark, d):
    df = tables.events_raw(spark, d)
    head = df.filter("seq % 3 = 0").withColumn("value", F.lit(-1.0))
    return rollup.merge_sources(head, df).select("series_key", "ts", "value")


@_query("series_list", f"with {RAW} select series_key, any_value(name) as name, count(*) as sample_count, min(ts) as min_ts, max(ts) as max_ts, arg_max(value, seq) as last_value from raw group by series_key")
def _series(spark, d):
    return Engine(tables.events_raw(spark, d)).series().drop("labels")


@_query("label_names", "select unnest(['__name__', 'linestatus', 'returnflag']) as label")
def _labels(spark, d):
    return Engine(tables.lineitem_ship(spark, d)).labels()


@_query("label_values", "select distinct cast(user_id as varchar) as value from events order by 1")
def _values(spark, d):
    return Engine(tables.events_raw(spark, d)).label_values("user")


@_query("label_values_name", "select distinct event_type as value from events order by 1")
def _names(spark, d):
    return Engine(tables.events_raw(spark, d)).label_values("__name__")


@_query("name_search", "select distinct event_type as name from events where event_type ilike '%I%'")
def _search(spark, d):
    return tables.events_raw(spark, d).filter(matchers.name_contains("I")).select("name").distinct()


_COUNTS = "count(*) as samples, count(distinct series_key) as series, min(ts) as min_ts, max(ts) as max_ts, count(*) * 16 as raw_bytes"


@_query("stats", f"with {RAW} select {_COUNTS} from raw")
def _stats(spark, d):
    return metadata.stats(tables.events_raw(spark, d)).select("samples", "series", "min_ts", "max_ts", "raw_bytes")


@_query("stats_sizes")
def _stats_sizes(spark, d):
    return Engine(tables.events_raw(spark, d)).stats(DAY)


@_query("cluster_stats", f"with {RAW} select count(*) as samples, count(distinct series_key) as series, count(*) * 16 as raw_bytes, cast(0 as bigint) as chunk_bytes, cast(0 as bigint) as disk_bytes, cast(0 as double) as compression_ratio from raw")
def _cluster_stats(spark, d):
    nodes = tables.events_raw(spark, d).withColumn("node", shard(F.col("name"), 3)).groupBy("node").agg(F.count("*").alias("samples"), F.countDistinct("series_key").alias("series"))
    zero = F.lit(0).cast("long")
    return metadata.cluster_stats(nodes.select("node", "samples", "series", (F.col("samples") * 16).alias("raw_bytes"), zero.alias("chunk_bytes"), zero.alias("disk_bytes")))


@_query("result_stats", f"with {RAW} select count(distinct series_key) as series, count(*) as samples from raw where name = 'view' and {_between()}")
def _result_stats(spark, d):
    return metadata.result_stats(Engine(tables.events_raw(spark, d)).query("view", START, END))


@_query("chart_bounds", f"with {RAW} select min(ts) as min_ts, max(ts) as max_ts, min(value) as min_value, max(value) as max_value from raw where name = 'view' and {_between()}")
def _bounds(spark, d):
    return metadata.chart_bounds(Engine(tables.events_raw(spark, d)).query("view", START, END))


_LE = "case " + " ".join(f"when value <= {b} then {b}" for b in metadata.LATENCY_MS[:-1]) + f" else {metadata.LATENCY_MS[-1]} end"
_HIST = f"select b.le, coalesce(h.n, 0) as count from (select unnest({list(metadata.LATENCY_MS)}) as le) b left join (select {_LE} as le, count(*) as n from events group by 1) h using (le)"


@_query("latency_hist", _HIST)
def _hist(spark, d):
    return metadata.latency_histogram(tables.read(spark, d, "events"), F.col("value"))


@_query("latency_hist_cumulative", f"select le, cast(sum(count) over (order by le) as bigint) as cumulative, cast(sum(count * le) over (order by le) as bigint) as sum_ms from ({_HIST})")
def _cumulative(spark, d):
    return metadata.cumulative_histogram(_hist(spark, d))


@_query("last_n_per_series", f"with {RAW}, r as (select *, row_number() over (partition by series_key order by ts desc, seq desc) as k from raw) select series_key, ts, value from r where k <= 3")
def _last(spark, d):
    return metadata.newest_per_series(tables.events_raw(spark, d), 3).select("series_key", "ts", "value")


@_query("recent_feed", f"with {RAW}, r as (select *, row_number() over (partition by series_key order by ts desc, seq desc) as k from raw) select series_key, ts, value from r where k <= 3 order by ts desc, series_key, seq desc limit 50")
def _feed(spark, d):
    return metadata.recent_feed(tables.events_raw(spark, d)).select("series_key", "ts", "value")


@_query("ingest_rate", f"with {RAW} select ts // 3600000 * 3600000 as tick, count(*) as samples from raw group by 1 order by 1 desc limit 120")
def _ingest_rate(spark, d):
    return metadata.ingest_rate(tables.events_raw(spark, d), 3_600_000)


@_query("varying_labels", "select unnest(['linestatus', 'returnflag']) as label")
def _varying(spark, d):
    return metadata.varying_labels(Engine(tables.lineitem_ship(spark, d)).query("l_quantity", 0, 10**13))


@_query("metric_type", "select distinct name, case when name like '%\\_total' escape '\\' then 'counter' else 'gauge' end as type from (select event_type as name from events union all select event_type || '_total' from events)")
def _types(spark, d):
    return metadata.metric_types(tables.events_raw(spark, d).union(tables.events_counter(spark, d)))


@_query("shard_counts", "with recursive h as (select name, 1 as i, 2166136261::bigint as h from (select distinct event_type as name from events) union all select name, i + 1, (xor(h, ascii(substr(name, i, 1))::bigint) * 16777619) % 4294967296 from h where i <= length(name)), f as (select name, h % 3 as shard from h where i = length(name) + 1) select cast(shard as integer) as shard, count(*) as samples from events join f on event_type = name group by 1")
def _shards(spark, d):
    return tables.events_raw(spark, d).groupBy(shard(F.col("name"), 3).alias("shard")).agg(F.count("*").alias("samples"))


@_query("fnv_hash", "with recursive h as (select name, 1 as i, 2166136261::bigint as h from (select distinct event_type as name from events) union all select name, i + 1, (xor(h, ascii(substr(name, i, 1))::bigint) * 16777619) % 4294967296 from h where i <= length(name)) select name, h as hash from h where i = length(name) + 1")
def _fnv(spark, d):
    return tables.events_raw(spark, d).select("name").distinct().select("name", fnv1a32(F.col("name")).alias("hash"))


@_query("ring_owner", "with ring as (select ('0x' || substr(sha256(n || '-' || i), 1, 8))::bigint as h, n from (select unnest(['node-0', 'node-1', 'node-2']) as n), (select unnest(range(16)) as i)), k as (select distinct event_type || '{user=' || user_id || '}' as series_key from events), o as (select series_key, (select arg_min(n, h) from ring where h >= ('0x' || substr(sha256(series_key), 1, 8))::bigint) as n from k) select series_key, coalesce(n, (select arg_min(n, h) from ring)) as owner from o")
def _owner(spark, d):
    return tables.events_raw(spark, d).select("series_key").distinct().select("series_key", Ring(["node-0", "node-1", "node-2"], 16).owner_column(F.col("series_key")).alias("owner"))


@_query("codec_roundtrip", f"with {RAW} select series_key, ts, value from raw")
def _codec(spark, d):
    return codec.decode_chunks(codec.encode_chunks(tables.events_raw(spark, d), 30 * DAY)).select("series_key", "ts", "value")


@_query("codec_sizes")
def _sizes(spark, d):
    chunks = codec.encode_chunks(tables.events_raw(spark, d), 30 * DAY)
    return chunks.groupBy("name").agg(F.sum("points").alias("points"), F.sum(F.length("chunk")).alias("chunk_bytes"), (F.sum(F.col("points") * 16) / F.sum(F.length("chunk"))).alias("ratio"))


@_query("write_requests", f"with {RAW} select series_key, ts, value from raw where name <> 'error'")
def _requests(spark, d):
    df = tables.events_raw(spark, d).withColumn("name", F.when(F.col("name") == "error", "not a name").otherwise(F.col("name")))
    return requests.parse(requests.to_requests(df)).select("series_key", "ts", "value")


@_query("output_table", f"with {RAW} select series_key as series, strftime(make_timestamp(ts * 1000), '%H:%M:%S') as timestamp, printf('%.4f', value) as value from raw where name = 'view' and {_between()}")
def _table(spark, d):
    return output.to_table(Engine(tables.events_raw(spark, d)).query("view", START, END))


@_query("output_csv", f"with {RAW} select name as series, ts as timestamp, printf('%.6f', value) as value from raw where name = 'view' and {_between()}")
def _csv(spark, d):
    return output.to_csv(Engine(tables.events_raw(spark, d)).query("view", START, END))


_MATRIX = f"""with {RAW} select series_key, '{{"name":"' || name || '","labels":{{"__name__":"' || name || '","user":"' || usr || '"}},"values":[' || string_agg('[' || ts || ',' || cast(value as varchar) || ']', ',' order by ts, value) || ']}}' as json from raw where name = 'view' and {_between()} group by series_key, name, usr"""


@_query("output_matrix", _MATRIX)
def _matrix(spark, d):
    return output.to_matrix(Engine(tables.events_raw(spark, d)).query("view", START, END))


@_query("output_envelope", f"""with m as ({_MATRIX}) select '' as at, '{{"status":"success","data":{{"resultType":"matrix","result":[' as text union all select ' ' || series_key, case when series_key = (select min(series_key) from m) then '' else ',' end || json from m union all select '~', ']}}}}'""")
def _envelope(spark, d):
    return output.to_envelope(Engine(tables.events_raw(spark, d)).query("view", START, END))


@_query("generator")
def _generated(spark, d):
    return generator.generate(spark, T0, 100).select("series_key", "ts", "value")


@_query("codec_patterns")
def _patterns(spark, d):
    both = [codec.encode_chunks(generator.pattern(spark, 20_000, k)).groupBy("name").agg(F.sum("points").alias("points"), F.sum(F.length("chunk")).alias("chunk_bytes")) for k in generator.PATTERNS]
    return both[0].union(both[1]).union(both[2])


@_query("exposition", f"with {RAW}, s as (select {_COUNTS} from raw) select '# TYPE chronoframe_' || k || ' gauge' || chr(10) || 'chronoframe_' || k || ' ' || v as line from (unpivot s on samples, series, min_ts, max_ts, raw_bytes into name k value v)")
def _exposition(spark, d):
    return output.exposition(_stats(spark, d))


@_query("exposition_sizes")
def _exposition_sizes(spark, d):
    return output.exposition(_stats_sizes(spark, d))


def _stored(spark: SparkSession, d: str) -> store.Store:
    """The events in a storage layout of their own, written in three batches."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="chronoframe-")
    path = f"{folder}/store-{uuid.uuid4().hex}"
    df = tables.events_raw(spark, d)
    for i in range(3):
        store.write(df.filter(F.col("seq") % 3 == i), path)
    return store.Store(spark, path)


@_query("stored_range", _raw(f"name = 'view' and usr like '1%' and {_between(PART, PART + 2 * DAY)}"))
def _stored_range(spark, d):
    return shown(Engine(_stored(spark, d)).query('view{user=~"1.*"}', PART, PART + 2 * DAY), **METRIC_USER)


@_query("stored_blocks", f"with {RAW} select min(ts) as min_time, max(ts) as max_time, count(*) as num_samples, count(distinct series_key) as num_series, 2 as level from raw group by ts // {DAY}")
def _stored_blocks(spark, d):
    own = _stored(spark, d)
    own.compact()
    return own.blocks().drop("block_id")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
