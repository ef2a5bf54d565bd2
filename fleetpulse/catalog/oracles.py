"""The catalog's queries as DuckDB SQL, written independently of the Spark plans.

Every query of the catalog has a statement here.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import comb, gcd

from fleetpulse.catalog.queries import (
    BOOSTED_TREES,
    DURATION_UNITS,
    FAMILIES,
    FEATURES,
    FLAG_THRESHOLD,
    FORECAST_METRICS,
    LONG_COOLDOWN,
    NOW,
    RANGE_END,
    RANGE_START,
    RETENTION_DAYS,
    SCORE_THRESHOLD,
    SEED,
    TARGET_FPR,
    VAL_SPLIT,
    digits_of,
)
from fleetpulse.schema import IO_METRICS, METRICS, REQUIRED_COLUMNS, SAMPLE_COLUMNS

VIEWS = {
    "samples": """
select event_id as sample_id,
  cast(floor(epoch_us(ts) / 1000000) as bigint) as ts,
  concat('h', cast(user_id % 8 as varchar)) as host,
  least(value, 100.0E0) as cpu_pct,
  cast(cast(json_extract_string(props, '$.k') as int) as double) as mem_pct,
  value * 1.0E5 as disk_read_bps,
  (100 - cast(json_extract_string(props, '$.k') as int)) * 2.0E5 as disk_write_bps,
  value * value * 1.0E2 as net_up_bps,
  ((event_id * 7919) % 1000) * 2.0E4 as net_down_bps,
  (event_id % 21) * 5.0E0 as swap_pct,
  cast(150 + user_id as int) as proc_count,
  case when event_id % 3 = 0 then null
       else 40.0E0 + cast(json_extract_string(props, '$.k') as int) / 2.0E0 end as cpu_temp,
  case when event_type = 'error' then 1 else 0 end as y_true
from events""",
    "scored": "select sample_id, host, ts, y_true, -floor(cpu_pct) / 100.0E0 as score from samples",
    "counters": """
select sample_id, host, ts, (sample_id * 104729) % 50000000 as read_bytes,
  (sample_id * 65537 + 17) % 50000000 as write_bytes,
  (sample_id * 15487 + proc_count * 3) % 50000000 as sent_bytes,
  (sample_id * 31337 + proc_count) % 50000000 as recv_bytes
from samples""",
    "sensors": """
select sample_id, host, ts,
  case when sample_id % 4 = 0 then cpu_temp end as coretemp,
  case when sample_id % 4 = 1 then cpu_temp end as k10temp,
  case when sample_id % 4 = 2 then cpu_temp end as zenpower,
  cpu_temp + 1.0E0 as cpu_thermal
from samples""",
    "gaps": """
select sample_id, ts, case when sample_id % 50 = 7 then null else host end as host,
  case when sample_id % 10 = 3 then null else cpu_pct end as cpu_pct,
  mem_pct, disk_read_bps, disk_write_bps, net_up_bps, net_down_bps, swap_pct,
  case when sample_id % 17 = 5 then null else proc_count end as proc_count, cpu_temp
from samples""",
    "flagged": f"""
select *, -floor(cpu_pct) / 100.0E0 as score, (-floor(cpu_pct) / 100.0E0) < {SCORE_THRESHOLD} as is_anomaly
from samples""",
    "alert_input": f"""
select *, -floor(cpu_pct) / 100.0E0 as score, (-floor(cpu_pct) / 100.0E0) < {FLAG_THRESHOLD} as is_anomaly
from samples""",
}
NEEDS = {"scored": ["samples"], "counters": ["samples"], "sensors": ["samples"], "gaps": ["samples"]}
NEEDS |= {"flagged": ["samples"], "alert_input": ["samples"]}


def snap(value: str, digits: int = 6) -> str:
    return f"(floor(({value}) * 1e{digits} + 0.4999) / 1e{digits})"


def snapped(names: list[str]) -> str:
    return ", ".join(f"{snap(n, digits_of(n))} as {n}" for n in names)


def fixed(value: str, digits: int) -> str:
    return f"printf('%.{digits}f', floor(({value}) * 1e{digits} + 0.5) / 1e{digits})"


def statement(sql: str, views: list[str], ctes: list[tuple[str, str]] = (), recursive: bool = False) -> str:
    needed: list[str] = []
    for view in views:
        needed += [v for v in [*NEEDS.get(view, []), view] if v not in needed]
    parts = [f"{v} as ({VIEWS[v]})" for v in needed] + [f"{name} as ({body})" for name, body in ctes]
    return f"with {'recursive ' if recursive else ''}{', '.join(parts)} {sql}"


ORACLES: dict[str, str] = {}


def oracle(function: Callable[[], str]) -> Callable[[], str]:
    ORACLES[function.__name__] = function()
    return function


SAMPLE_LIST = ", ".join(["sample_id", *SAMPLE_COLUMNS])
HOST_ORDER = "partition by host order by ts, sample_id"

# ---- scans, writes, retention -------------------------------------------------------------------

COMPLETE = " and ".join(f"{c} is not null" for c in REQUIRED_COLUMNS)
MISSING = "concat_ws(',', " + ", ".join(f"case when {c} is null then '{c}' end" for c in REQUIRED_COLUMNS) + ")"


@oracle
def ingest_validate():
    return statement(f"select sample_id, ts, ({COMPLETE}) as accepted, {MISSING} as missing from gaps", ["gaps"])


@oracle
def ingest_counts():
    return statement(f"select {MISSING} as missing, count(*) as n from gaps group by 1", ["gaps"])


@oracle
def store_roundtrip():
    return statement(f"select {SAMPLE_LIST} from gaps where {COMPLETE}", ["gaps"])


@oracle
def scan_range():
    where = f"ts between {RANGE_START} and {RANGE_END} and host = 'h3'"
    return statement(f"select {SAMPLE_LIST} from samples where {where}", ["samples"])


@oracle
def scan_all_hosts():
    return statement(f"select {SAMPLE_LIST} from samples where ts between {RANGE_START} and {RANGE_END}", ["samples"])


@oracle
def scan_last():
    return statement(
        f"select {SAMPLE_LIST} from samples where ts >= (select max(ts) - 7 * 86400 from samples)", ["samples"]
    )


TAGS = """case
  when cpu_pct > 80 and mem_pct > 80 then 'cpu_pct,mem_pct'
  when cpu_pct > 80 then 'cpu_pct'
  when mem_pct > 80 then 'mem_pct'
  when greatest(disk_read_bps, disk_write_bps, net_up_bps, net_down_bps) > 10000000 then
    array_to_string(list_filter([
      case when disk_read_bps > 10000000 then 'disk_read_bps' end,
      case when disk_write_bps > 10000000 then 'disk_write_bps' end,
      case when net_up_bps > 10000000 then 'net_up_bps' end,
      case when net_down_bps > 10000000 then 'net_down_bps' end], lambda x: x is not null), ',')
  else 'general' end"""
CLAUSES = f"""array_to_string(list_filter([
  case when cpu_pct > 80 then 'high CPU (' || {fixed('cpu_pct', 1)} || '%)' end,
  case when mem_pct > 80 then 'high memory (' || {fixed('mem_pct', 1)} || '%)' end,
  case when disk_write_bps > 10000000 then 'high disk write (' || {fixed('disk_write_bps / 1e6', 1)} || ' MB/s)' end,
  case when net_down_bps > 10000000 then 'high network download (' || {fixed('net_down_bps / 1e6', 1)} || ' MB/s)' end],
  lambda x: x is not null), ', ')"""
EXPLANATION = (
    f"'Anomaly score ' || {fixed('score', 3)} || ': ' || "
    f"coalesce(nullif({CLAUSES}, ''), 'unusual pattern detected')"
)
EVENT_LOG = (
    "event_log",
    f"""select md5(sample_id || '|anomaly') as id, ts, 'anomaly' as type, score, {TAGS} as metric_tags,
    {EXPLANATION} as explanation from flagged where is_anomaly
  union all
  select md5(sample_id || '|forecast'), ts, 'forecast', score, 'swap_pct', 'swap is filling'
  from flagged where swap_pct >= 80""",
)


@oracle
def detections_write():
    columns = f"id, ts, type, {snap('score')} as score, metric_tags, explanation"
    return statement(f"select {columns}, {NOW}::bigint as written_at from event_log", ["flagged"], [EVENT_LOG])


@oracle
def detections_rewrite():
    columns = f"id, ts, type, {snap('score')} as score, metric_tags, explanation"
    written = f"case when ts <= {RANGE_END} then {NOW}::bigint else {NOW + 60}::bigint end as written_at"
    return statement(f"select {columns}, {written} from event_log", ["flagged"], [EVENT_LOG])


@oracle
def detections_scan():
    return statement(
        f"""select id, ts, type, {snap('score')} as score, metric_tags, explanation from event_log
        where ts between {RANGE_START} and {RANGE_END} and type = 'anomaly' order by ts desc, id desc""",
        ["flagged"],
        [EVENT_LOG],
    )


CUTOFF = f"({NOW} - {RETENTION_DAYS} * 86400)"


@oracle
def retention_store():
    cutoff = f"{CUTOFF} + 43200"
    return statement(
        f"""select {SAMPLE_LIST}, store, (select count(*) from gaps where {COMPLETE} and ts < {cutoff}) as removed
        from gaps, (values ('batch'), ('stream')) s(store) where {COMPLETE} and ts >= {cutoff}""",
        ["gaps"],
    )


@oracle
def retention_keep():
    return statement(f"select sample_id, host, ts from samples where ts >= {CUTOFF}", ["samples"])


@oracle
def retention_removed():
    return statement(f"select count(*) as removed from samples where ts < {CUTOFF}", ["samples"])


@oracle
def store_stats():
    return statement(
        """select 'samples' as table_name, count(*) as row_count from samples
        union all select 'models', count(*) from events
        union all select 'detections', count(*) from event_log""",
        ["flagged"],
        [EVENT_LOG],
    )


@oracle
def host_stats():
    return statement(
        "select host, count(*) as samples, min(ts) as first_ts, max(ts) as last_ts from samples group by host",
        ["samples"],
    )


@oracle
def registry_latest():
    return """with registry as (
      select cast(event_id as varchar) as model_id, event_type || '_h' || (user_id % 8) as name,
        'IsolationForest' as algo, '1.' || (event_id % 7) as version,
        cast(floor(epoch_us(ts) / 1000000) as bigint) as trained_at, props as meta_json from events)
    select name, model_id, algo, version, trained_at, meta_json,
      cast(json_extract_string(meta_json, '$.k') as int) as meta_k
    from registry
    qualify row_number() over (partition by name order by trained_at desc, model_id desc) = 1"""


@oracle
def export_roundtrip():
    where = f"where ts between {RANGE_START} and {RANGE_END}"
    return statement(
        f"""select {SAMPLE_LIST}, 'csv' as format from samples {where}
        union all select {SAMPLE_LIST}, 'json' from samples {where}""",
        ["samples"],
    )


@oracle
def stream_ingest():
    return statement(f"select {SAMPLE_LIST} from gaps where {COMPLETE}", ["gaps"])


def _rate(counter: str) -> str:
    change = f"({counter} - lag({counter}) over w)"
    elapsed = "(ts - lag(ts) over w)"
    return snap(f"case when {elapsed} > 0 then greatest(0.0, {change}::double / {elapsed}) else 0.0 end")


RATES = ", ".join(f"{_rate(c)} as {c}_rate" for c in ("read_bytes", "write_bytes", "sent_bytes", "recv_bytes"))


@oracle
def counter_rates():
    return statement(f"select sample_id, host, ts, {RATES} from counters window w as ({HOST_ORDER})", ["counters"])


@oracle
def counter_rates_stream():
    return statement(
        f"select sample_id, host, ts, {RATES}, false as late from counters window w as ({HOST_ORDER})", ["counters"]
    )


@oracle
def fill_defaults():
    filled = ", ".join(f"coalesce({m}, 0) as {m}" for m in [*METRICS, "proc_count"])
    return statement(f"select sample_id, host, ts, {filled}, cpu_temp from gaps", ["gaps"])


@oracle
def sensor_coalesce():
    reading = "coalesce(coretemp, k10temp, zenpower, cpu_thermal)"
    return statement(
        f"select sample_id, host, ts, {reading} as cpu_temp, {reading} as cpu_temp_of_map from sensors", ["sensors"]
    )


# ---- time and text ------------------------------------------------------------------------------


@oracle
def parse_duration_text():
    units = "[" + ", ".join(f"'{u}'" for u in DURATION_UNITS) + "]"
    number = f"case {units}[sample_id % {len(DURATION_UNITS)} + 1]"
    factors = " ".join(
        f"when '{u}' then {f}"
        for u, f in (("s", 1), ("m", 60), ("h", 3600), ("d", 86400), ("w", 604800), ("", 1), (" H", 3600))
    )
    return statement(
        f"""select sample_id,
        ' ' || cast(mem_pct as int) || {units}[sample_id % {len(DURATION_UNITS)} + 1] || ' ' as text,
        cast(mem_pct as bigint) * {number} {factors} end as seconds from samples""",
        ["samples"],
    )


@oracle
def format_duration_text():
    return statement(
        """select sample_id, seconds, case
          when seconds < 60 then seconds || 's'
          when seconds < 3600 then (seconds // 60) || 'm'
          when seconds < 86400 then (seconds // 3600) || 'h'
            || case when seconds % 3600 >= 60 then ' ' || (seconds % 3600 // 60) || 'm' else '' end
          else (seconds // 86400) || 'd'
            || case when seconds % 86400 >= 3600 then ' ' || (seconds % 86400 // 3600) || 'h' else '' end
          end as text
        from (select sample_id, cast(floor(disk_read_bps / 50.0) as bigint) as seconds from samples)""",
        ["samples"],
    )


@oracle
def epoch_convert():
    """New York is five hours behind UTC on every day of the tables, which are all in January."""
    at = "make_timestamp(ts * 1000000)"
    return statement(
        f"""select sample_id, {at} as utc, {at} - interval 5 hour as local, ts as epoch from samples""",
        ["samples"],
    )


# ---- features -----------------------------------------------------------------------------------


def _lags(m: str) -> list[str]:
    return [f"lag({m}, {k}) over w as {m}_lag{k}" for k in (1, 2, 3, 5)]


def _rolling(m: str) -> list[str]:
    out = []
    for tag, rows in (("s", 5), ("l", 30)):
        frame = f"over ({HOST_ORDER} rows between {rows - 1} preceding and current row)"
        out += [f"avg({m}) {frame} as {m}_rmean_{tag}", f"stddev_samp({m}) {frame} as {m}_rstd_{tag}"]
    return out


def _slope(m: str) -> list[str]:
    frame = f"over ({HOST_ORDER} rows between 9 preceding and current row)"
    place = f"row_number() over ({HOST_ORDER})"
    return [f"case when {place} < 10 then 0.0 else regr_slope({m}, rn) {frame} end as {m}_slope"]


def _burst(m: str) -> list[str]:
    frame = f"over ({HOST_ORDER} rows between 9 preceding and current row)"
    return [f"max({m}) {frame} / (avg({m}) {frame} + 1e-6) as {m}_burst"]


def _family(columns: list[str]) -> str:
    names = [c.rsplit(" as ", 1)[1] for c in columns]
    numbered = f"(select *, row_number() over ({HOST_ORDER}) as rn from samples)"
    inner = f"select sample_id, {', '.join(columns)} from {numbered} window w as ({HOST_ORDER})"
    return f"select sample_id, {snapped(names)} from ({inner})"


@oracle
def feat_lags():
    return statement(_family([c for m in METRICS for c in _lags(m)]), ["samples"])


@oracle
def feat_rolling():
    return statement(_family([c for m in METRICS for c in _rolling(m)]), ["samples"])


@oracle
def feat_slope():
    return statement(_family([c for m in METRICS for c in _slope(m)]), ["samples"])


@oracle
def feat_burst():
    return statement(_family([c for m in IO_METRICS for c in _burst(m)]), ["samples"])


def _ordered(source: str) -> tuple[str, str]:
    return ("ordered", f"select *, row_number() over ({HOST_ORDER}) as rn from {source}")


ORDERED = _ordered("samples")
EMA_NAMES = [n for m in METRICS for n in FAMILIES["feat_ema"](m)]
EMA = (
    "ema",
    "select host, rn, sample_id, "
    + ", ".join(f"{m} as {m}_ema1, {m} as {m}_ema3" for m in METRICS)
    + " from ordered where rn = 1 union all select o.host, o.rn, o.sample_id, "
    + ", ".join(
        f"0.9e0 * e.{m}_ema1 + 0.1e0 * o.{m}, 0.7e0 * e.{m}_ema3 + 0.3e0 * o.{m}" for m in METRICS
    )
    + " from ema e join ordered o on o.host = e.host and o.rn = e.rn + 1",
)


@oracle
def feat_ema():
    return statement(f"select sample_id, {snapped(EMA_NAMES)} from ema", ["samples"], [ORDERED, EMA], recursive=True)


NATIVE = [c for m in METRICS for c in (*_lags(m), *_rolling(m), *_slope(m))] + [c for m in IO_METRICS for c in _burst(m)]
FEATURE_CTES = [
    ORDERED,
    EMA,
    ("native", f"select sample_id, host, ts, {', '.join(METRICS)}, {', '.join(NATIVE)} from ordered window w as ({HOST_ORDER})"),
    (
        "feats",
        "select n.sample_id, n.host, n.ts, "
        + ", ".join(f"coalesce({'e' if n in EMA_NAMES else 'n'}.{n}, 0.0) as {n}" for n in FEATURES)
        + " from native n join ema e on e.sample_id = n.sample_id and e.host = n.host",
    ),
]


def _on_features(sql: str, extra: list[tuple[str, str]] = ()) -> str:
    return statement(sql, ["samples"], [*FEATURE_CTES, *extra], recursive=True)


@oracle
def features_all():
    return _on_features(f"select sample_id, host, ts, {snapped(FEATURES)} from feats")


@oracle
def features_all_hot_hosts():
    return ORACLES["features_all"]


@oracle
def features_stream():
    return ORACLES["features_all"]


LONG = ("long", f"select sample_id, feature, value from (unpivot feats on {', '.join(FEATURES)} into name feature value value)")
NAMES = "(select unnest([" + ", ".join(f"'{n}'" for n in FEATURES) + "]) as feature, unnest(range(88)) as idx)"
STATS = (
    "stats",
    "select feature, avg(value) as mean, case when var_pop(value) <= count(*) * 2.220446049250313e-16 * var_pop(value) "
    "+ pow(count(*) * avg(value) * 2.220446049250313e-16, 2) then 1.0 else sqrt(var_pop(value)) end as scale "
    "from long group by feature",
)


@oracle
def scaler_fit():
    wide = "feature like '%\\_bps%' escape '\\' and not ends_with(feature, '_burst')"
    columns = ", ".join(f"case when {wide} then {snap(c, 2)} else {snap(c, 6)} end as {c}" for c in ("mean", "scale"))
    return _on_features(
        f"select cast(idx as int) as idx, feature, {columns} from stats join {NAMES} using (feature)", [LONG, STATS]
    )


@oracle
def scaler_apply():
    return _on_features(
        "select sample_id, "
        + ", ".join(f"max(case when feature = '{n}' then z end) as {n}" for n in FEATURES)
        + f" from (select sample_id, feature, {snap('(value - mean) / scale')} as z from long join stats using (feature))"
        " group by sample_id",
        [LONG, STATS],
    )


@oracle
def feature_catalog():
    return _on_features(
        "select cast(idx as int) as idx, feature, count(*) filter (abs(value) > 1e-6) as nonzero_rows "
        f"from long join {NAMES} using (feature) group by all",
        [LONG],
    )


# ---- detection ----------------------------------------------------------------------------------


@oracle
def chrono_split():
    return statement(
        f"""select sample_id, host, ts,
          case when row_number() over (order by ts, sample_id) <= floor((select count(*) from samples) * (1 - {VAL_SPLIT}e0))
          then 'train' else 'validation' end as side from samples""",
        ["samples"],
    )


def _hash(text: str) -> str:
    return f"cast('0x' || substr(md5({text}), 1, 13) as bigint)"


def _drawn(trees: int, size: int, source: str = "samples") -> str:
    """A row is looked at by a binomial number of trees, on a circle from a drawn start by a drawn step; the smallest keys are drawn."""
    steps = [b for b in range(1, trees + 1) if gcd(b, trees) == 1]
    ways = [float(comb(trees, i)) for i in range(trees)]
    share = f"least(1e0, {4 * size}::double / (select count(*) from {source}))"
    draws = f"""(select list_transform(range(0, {trees}), lambda k: list_sum(list_transform(range(0, k + 1),
        lambda i: list_extract({ways}::double[], i + 1) * pow(p, i) * pow(1 - p, {trees} - i))) * (1::bigint << 52)) from (select {share} as p))"""
    hashed = lambda what: _hash(f"'{SEED}|{what}|' || sample_id")
    return f"""select tree_id, rank, sample_id from (
      select *, cast(row_number() over (partition by tree_id order by {_hash(f"'{SEED}|key|' || tree_id || '|' || sample_id")}, sample_id) as int) as rank
      from (
        select sample_id, cast((begin_ + turn * step) % {trees} as int) as tree_id from (
          select sample_id, {hashed('start')} % {trees} as begin_, list_extract({steps}, {hashed('step')} % {len(steps)} + 1) as step,
            unnest(range(0, len(list_filter({draws}, lambda d: floor(d) <= {_hash(f"'{SEED}|' || sample_id")})))) as turn
          from {source}))) where rank <= {size}"""


@oracle
def forest_sample():
    return statement(_drawn(100, 256), ["samples"])


@oracle
def forest_sample_dealt():
    return statement(_drawn(8, 32), ["samples"])


def _hash_share(what: str) -> str:
    return f"({_hash(f"'{SEED}|{what}|' || tree_id || '|' || node_id")} / (1::bigint << 52))"


def _grown(trees: int, size: int, height: int, points: str, width: int, source: str = "samples") -> list[tuple[str, str]]:
    """CTEs that grow trees over `points` (sample_id, point) level by level: `nodes` has one row per node, lists count from 1."""
    ends = lambda end, over="": "[" + ", ".join(f"{end}(point[{i + 1}]){over}" for i in range(width)) + "]"
    varying = "[" + ", ".join(f"case when low[{i + 1}] < high[{i + 1}] then {i + 1} end" for i in range(width)) + "]"
    split = f"""
      select *, case when cut >= high[axis] then low[axis] else cut end as threshold from (
        select *, low[axis] + {_hash_share('cut')} * (high[axis] - low[axis]) as cut from (
          select *, case when size > 1 and depth < {height} then
            axes[cast(floor({_hash_share('feature')} * len(axes)) as int) + 1] end as axis from (
              select *, list_filter({varying}, lambda i: i is not null) as axes from %s)))"""
    own = " over (partition by tree_id, node_id)"
    placed = f"(select *, count(*){own} as size, {ends('min', own)} as low, {ends('max', own)} as high from grown)"
    once = f"""(select tree_id, node_id, min(depth) as depth, count(*) as size, {ends('min')} as low, {ends('max')} as high
      from grown group by tree_id, node_id)"""
    return [
        ("drawn", _drawn(trees, size, source)),
        ("grown", f"""
          select tree_id, 0 as node_id, 0 as depth, point from drawn join ({points}) using (sample_id)
          union all
          select tree_id, 2 * node_id + case when point[axis] <= threshold then 1 else 2 end, depth + 1, point
          from ({split % placed}) where axis is not null"""),
        ("nodes", split % once),
    ]


INNER = "case when axis is not null then cast({} as int) end as {}"
NODES = f"""select tree_id, node_id, {INNER.format('axis - 1', 'feature')}, {snap('threshold', 2)} as threshold,
  {INNER.format('2 * node_id + 1', '"left"')}, {INNER.format('2 * node_id + 2', '"right"')}, cast(size as int) as size, depth from nodes"""
METRIC_POINTS = f"select sample_id, [{', '.join(METRICS)}] as point from samples"
WHOLE = "[" + ", ".join(f"floor({n} * 1e{digits_of(n)} + 0.4999)" for n in FEATURES) + "]"


@oracle
def forest_fit_metrics():
    return statement(NODES, ["samples"], _grown(8, 32, 5, METRIC_POINTS, len(METRICS)), recursive=True)


@oracle
def forest_fit():
    points = ("points", f"select sample_id, {WHOLE} as point from feats")
    return _on_features(NODES, [points, *_grown(100, 256, 8, "select * from points", len(FEATURES))])


USUAL = "case when {0} <= 1 then 0e0 when {0} = 2 then 1e0 else 2 * (ln({0} - 1) + 0.5772156649015329e0) - 2 * ({0} - 1.0e0) / {0} end"
PATH = f"cast(floor((depth + {USUAL.format('size')}) * 4294967296e0 + 0.4999) as bigint)"  # whole multiples of 2**-32


def _model(sql: str, sided: str, before: Sequence[tuple[str, str]] = (), extra: Sequence[tuple[str, str]] = ()) -> str:
    """A model learnt from the rows of `sided` whose host ends in |train and calibrated on those in |validation; the windows of
    each side start anew. `scores` (side, sample_id, score) has all other sides, and `cut` the threshold."""
    ctes = [
        *before,
        ("sided", sided),
        _ordered("sided"),
        *FEATURE_CTES[1:],
        ("points", f"select sample_id, string_split(host, '|')[2] as side, {WHOLE} as point from feats"),
        ("learned", "select sample_id from points where side = 'train'"),
        *_grown(100, 256, 8, "select sample_id, point from points where side = 'train'", len(FEATURES), "learned"),
        ("tests", "select sample_id, side, point from points where side <> 'train'"),
        ("coords", f"select sample_id, side, unnest(range(1, {len(FEATURES) + 1})) as axis, unnest(point) as value from tests"),
        ("walk", """
          select sample_id, side, cast(tree_id as int) as tree_id, 0 as node_id from tests, range(100) t(tree_id)
          union all
          select w.sample_id, w.side, w.tree_id, 2 * w.node_id + case when c.value <= n.threshold then 1 else 2 end
          from walk w join nodes n on w.tree_id = n.tree_id and w.node_id = n.node_id
            join coords c on c.sample_id = w.sample_id and c.side = w.side and c.axis = n.axis"""),
        ("scores", f"""
          select side, sample_id, -pow(2, -(sum({PATH}) / 4294967296e0) / 100 / ({USUAL.format('any_value(biggest)')})) as score
          from walk join (select *, max(size) over () as biggest from nodes) using (tree_id, node_id)
          where axis is null group by side, sample_id"""),
        ("cut", f"select quantile_cont(score, {TARGET_FPR}) as threshold from scores where side = 'validation'"),
        *extra,
    ]
    return statement(sql, ["samples"], ctes, recursive=True)


PLACED = ("placed", "select *, row_number() over (order by ts, sample_id) as place, count(*) over () as n from samples")


def _trained(sql: str, parts: dict[str, str]) -> str:
    """A model of all rows (first 80 % to learn, the rest to calibrate); `parts`: name of a further side and which rows it has."""
    learned = f"case when place <= floor(n * {1 - VAL_SPLIT}) then '|train' else '|validation' end"
    sided = [
        f"select * exclude (place, n) replace (host || {learned} as host) from placed",
        *[f"select * replace (host || '|{side}' as host) from samples where {which}" for side, which in parts.items()],
    ]
    return _model(sql, " union all ".join(sided), [PLACED])


@oracle
def train_summary():
    sides = "(select count(*) from points where side = '{}')"
    return _trained(
        f"""select {sides.format('train')} as train_samples, {sides.format('validation')} as val_samples,
          {snap('threshold')} as threshold, cast({len(FEATURES)} as int) as features from cut""",
        {},
    )


@oracle
def forest_score():
    return _trained(
        f"select sample_id, s.host, s.ts, {snap('score')} as score from scores join samples s using (sample_id) where side = 'all'",
        {"all": "true"},
    )


@oracle
def forest_score_metrics():
    walk = f"""
      select sample_id, [{', '.join(METRICS)}] as point, cast(tree_id as int) as tree_id, 0 as node_id
      from samples, range(8) t(tree_id)
      union all
      select sample_id, point, tree_id, 2 * node_id + case when point[axis] <= threshold then 1 else 2 end
      from walk join nodes using (tree_id, node_id) where axis is not null"""
    score = f"-pow(2, -(sum({PATH}) / 4294967296e0) / 8 / ({USUAL.format('any_value(biggest)')}))"
    return statement(
        f"""select sample_id, {snap(score, 9)} as score
        from walk join (select *, max(size) over () as biggest from nodes) using (tree_id, node_id)
        where axis is null group by sample_id""",
        ["samples"],
        [*_grown(8, 32, 5, METRIC_POINTS, len(METRICS)), ("walk", walk)],
        recursive=True,
    )


def _path(size: int, depth: int) -> str:
    if size <= 2:
        return f"{depth + (1 if size == 2 else 0)}.0e0"
    return f"({depth} + 2 * (ln({size - 1}) + 0.5772156649015329e0) - 2 * {size - 1}.0e0 / {size})"


@oracle
def forest_score_fixed():
    first = f"case when cpu_pct <= 90 then {_path(240, 1)} when mem_pct <= 50 then {_path(15, 2)} else {_path(1, 2)} end"
    second = f"case when mem_pct <= 97 then {_path(254, 1)} else {_path(2, 1)} end"
    score = f"-pow(2, -(({first} + {second}) / 2) / {_path(256, 0)})"
    return statement(f"select sample_id, {snap(score, 9)} as score from samples", ["samples"])


@oracle
def predict_contamination():
    return statement(
        """select sample_id, cast(case when score < (select quantile_cont(score, 0.05) from scored) then -1 else 1 end as int)
        as label from scored""",
        ["scored"],
    )


@oracle
def calibrate_threshold():
    return statement(
        f"""select {snap('threshold')} as threshold, (select count(*) from fine) as rows,
          (select count(*) from fine where score < threshold) as below
        from (select quantile_cont(score, {TARGET_FPR}) as threshold from fine)""",
        ["samples"],
        [("fine", "select -cpu_pct / 100.0e0 as score from samples")],
    )


@oracle
def calibrate_by_host():
    return statement(
        f"""select host, {snap('any_value(threshold)')} as threshold, count(*) as rows, count(*) filter (score < threshold) as below
        from rows_ join (select host, quantile_cont(score, {TARGET_FPR}) as threshold from rows_ group by host) using (host)
        group by host""",
        ["samples"],
        [("rows_", "select host, -cpu_pct / 100.0e0 as score from samples")],
    )


@oracle
def threshold_predict():
    return statement(f"select sample_id, score < {SCORE_THRESHOLD} as is_anomaly from scored", ["scored"])


@oracle
def anomaly_tags():
    return statement(f"select sample_id, ts, {TAGS} as metric_tags from flagged where is_anomaly", ["flagged"])


@oracle
def anomaly_explain():
    return statement(
        f"""select sample_id, host, ts, {snap('score')} as score, {TAGS} as metric_tags, {EXPLANATION} as explanation
        from flagged where is_anomaly""",
        ["flagged"],
    )


@oracle
def detect_summary():
    share = snap("100.0e0 * count(*) filter (is_anomaly) / nullif(count(*), 0)")
    return statement(
        f"select count(*) as samples, count(*) filter (is_anomaly) as anomalies, {share} as anomaly_pct from flagged",
        ["flagged"],
    )


@oracle
def detect_batch():
    return _trained(
        f"""select sample_id, host, ts, {snap('score')} as score, {TAGS} as metric_tags, {EXPLANATION} as explanation
        from scores join samples using (sample_id) where side = 'range' and score < (select threshold from cut)""",
        {"range": f"ts between {RANGE_START} and {RANGE_END}"},
    )


@oracle
def detect_streaming():
    return _trained(
        f"""select sample_id, s.host, s.ts, {snap('score')} as score, score < (select threshold from cut) as is_anomaly, false as late
        from scores join samples s using (sample_id) where side = 'all'""",
        {"all": "true"},
    )


@oracle
def model_roundtrip():
    """Every sample of the range is scored by both models, and alike."""
    return statement(
        f"""select count(*) as rows, count(*) filter (sample_id is null) as differences
          from samples where ts between {RANGE_START} and {RANGE_END}""",
        ["samples"],
    )


# ---- evaluation ---------------------------------------------------------------------------------

CONFUSION = (
    "confusion",
    """select count(*) filter (is_anomaly and y_true = 1) as tp, count(*) filter (is_anomaly and y_true = 0) as fp,
      count(*) filter (not is_anomaly and y_true = 0) as tn, count(*) filter (not is_anomaly and y_true = 1) as fn
    from flagged""",
)


def _share(part: str, whole: str) -> str:
    return snap(f"coalesce(cast({part} as double) / nullif({whole}, 0), 0.0)")


@oracle
def fpr_tpr_at():
    return statement(
        f"select {_share('fp', 'fp + tn')} as fpr, {_share('tp', 'tp + fn')} as tpr from confusion",
        ["flagged"],
        [CONFUSION],
    )


@oracle
def prec_recall_at():
    return statement(
        f"select {_share('tp', 'tp + fp')} as precision, {_share('tp', 'tp + fn')} as recall from confusion",
        ["flagged"],
        [CONFUSION],
    )


# Rank form of the area: average ranks of the positives, ties sharing their mean rank.
AUC = (
    "area",
    """select coalesce((sum(mean_rank) filter (y_true = 1) - p * (p + 1) / 2.0e0) / nullif(p * n, 0), 0.0) as auc
    from (select y_true, rank() over (order by -score) + (count(*) over (partition by score) - 1) / 2.0e0 as mean_rank,
      cast(count(*) filter (y_true = 1) over () as double) as p, cast(count(*) filter (y_true = 0) over () as double) as n
      from scored) group by p, n""",
)


@oracle
def classification_report():
    return statement(
        f"""select {_share('tp + tn', 'tp + fp + tn + fn')} as accuracy, {_share('tp', 'tp + fp')} as precision,
        {_share('tp', 'tp + fn')} as recall, {_share('fp', 'fp + tn')} as fpr, {snap('auc')} as auc
        from confusion, area""",
        ["flagged", "scored"],
        [CONFUSION, AUC],
    )


@oracle
def roc_auc():
    return statement(f"select {snap('auc')} as auc from area", ["scored"], [AUC])


def _cumulative(scores: str) -> tuple[str, str]:
    return (
        "cumulative",
        f"""select score, pos, neg, sum(pos) over (order by score) as tp, sum(neg) over (order by score) as fp,
          sum(pos) over () as p, sum(neg) over () as n,
          row_number() over (order by score) as place, count(*) over () as places,
          lead(pos) over (order by score) as next_pos, lead(neg) over (order by score) as next_neg
        from (select score, count(*) filter (y_true = 1) as pos, count(*) filter (y_true = 0) as neg
          from {scores} group by score)""",
    )


ROC_POINTS = f"""select {snap('fp / n')} as fpr, {snap('tp / p')} as tpr, {snap('-score')} as threshold from cumulative"""
ROC_ORIGIN = "union all select 0.0::double, 0.0::double, null::double"


@oracle
def roc_curve():
    keep = "where place = 1 or place = places or next_pos <> pos or next_neg <> neg"
    return statement(f"{ROC_POINTS} {keep} {ROC_ORIGIN}", ["scored"], [_cumulative("scored")])


@oracle
def roc_curve_fine():
    fine = ("fine", "select y_true, -disk_read_bps / 1e7 as score from samples")
    return statement(f"{ROC_POINTS} {ROC_ORIGIN}", ["samples"], [fine, _cumulative("fine")])


@oracle
def pr_curve():
    return statement(
        f"""select {snap('tp / (tp + fp)')} as precision, {snap('tp / p')} as recall, {snap('-score')} as threshold
        from cumulative union all select 1.0::double, 0.0::double, null::double""",
        ["scored"],
        [_cumulative("scored")],
    )


RUNS = (
    "runs",
    f"""select sample_id, host, ts as start_ts, detected_ts, detected_ts - ts as lead_time from (
      select sample_id, host, ts, y_true - lag(y_true, 1, 0) over w as step,
        first_value(case when is_anomaly then ts end ignore nulls)
          over ({HOST_ORDER} rows between current row and 99 following) as detected_ts
      from flagged window w as ({HOST_ORDER})) where step = 1""",
)


@oracle
def lead_time_runs():
    return statement("select * from runs", ["flagged"], [RUNS])


@oracle
def lead_time():
    return statement(
        f"""select {snap('coalesce(avg(lead_time), 0.0)')} as mean_lead_time,
        {snap('coalesce(median(lead_time), 0.0)')} as median_lead_time from runs""",
        ["flagged"],
        [RUNS],
    )


@oracle
def score_histogram():
    return statement(
        f"""select y_true, bin, {snap('low + bin * width')} as bin_low, count(*) as n,
          {snap('count(*) / (total * width)')} as density
        from (select s.y_true, low, width, total, cast(least(floor((score - low) / width), 49) as int) as bin
          from scored s join (select y_true, min(score) as low, (max(score) - min(score)) / 50 as width, count(*) as total
            from scored group by y_true) r on r.y_true = s.y_true)
        group by y_true, bin, low, width, total""",
        ["scored"],
    )


def _injected(source: str, types: int) -> str:
    """`source` with the metrics of one row in twenty overwritten, by one of the first `types` kinds, and `chosen` for those rows."""
    kinds = {
        "cpu_pct": (0, 90, 10),
        "mem_pct": (1, 85, 15),
        "disk_read_bps": (2, 10**8, 9 * 10**8),
        "disk_write_bps": (2, 10**8, 9 * 10**8),
        "net_up_bps": (3, 10**8, 9 * 10**8),
        "net_down_bps": (3, 10**8, 9 * 10**8),
        "swap_pct": (4, 80, 20),
    }
    columns = []
    for m in METRICS:
        kind, low, span = kinds[m]
        bits = _hash(f"'{SEED}|{m}|' || sample_id")
        drawn = f"{low}.0e0 + {span}.0e0 * ({bits} / 4503599627370496.0e0)"
        columns.append(f"case when chosen and kind = {kind} then {drawn} else {m} end as {m}")
    pick = _hash(f"'{SEED}|pick|' || sample_id")
    kind = _hash(f"'{SEED}|kind|' || sample_id")
    return f"""select * replace ({', '.join(columns)}) from (
      select *, {kind} % {types} as kind,
        row_number() over (order by {pick}, sample_id) <= floor((select count(*) from {source}) * 0.05e0) as chosen
      from {source})"""


@oracle
def inject_anomalies():
    return statement(
        f"select sample_id, cast(chosen as int) as y_true, {snapped(METRICS)} from ({_injected('samples', 5)})", ["samples"]
    )


def _evaluated(sql: str, extra: Sequence[tuple[str, str]]) -> str:
    """The back-test: `flagged` has the scored rows of the last fifth, injected anomalies being the ones to find."""
    past = f"floor(n * {1 - VAL_SPLIT})"
    learned = f"case when place <= floor({past} * {1 - VAL_SPLIT}) then '|train' else '|validation' end"
    sided = f"""select * exclude (place, n) replace (host || {learned} as host) from placed where place <= {past}
      union all select * exclude (kind, chosen) replace (host || '|test' as host) from test"""
    before = [
        PLACED,
        ("recent", f"select * exclude (place, n) from placed where place > {past}"),
        ("test", _injected("recent", 4)),
    ]
    flagged = """select t.sample_id, t.host, t.ts, cast(t.chosen as int) as y_true, s.score, s.score < (select threshold from cut) as is_anomaly
      from test t join scores s on s.sample_id = t.sample_id and s.side = 'test'"""
    return _model(sql, sided, before, [("flagged", flagged), ("scored", "select * from flagged"), *extra])


@oracle
def evaluation_report():
    return _evaluated(
        f"""select (select count(*) from flagged) as test_samples, {snap('(select threshold from cut)')} as threshold,
          {_share('tp + tn', 'tp + fp + tn + fn')} as accuracy, {_share('tp', 'tp + fp')} as precision, {_share('tp', 'tp + fn')} as recall,
          {_share('fp', 'fp + tn')} as fpr, {snap('auc')} as auc,
          {snap('(select coalesce(avg(lead_time), 0.0) from runs)')} as mean_lead_time,
          {snap('(select coalesce(median(lead_time), 0.0) from runs)')} as median_lead_time
        from confusion, area""",
        [CONFUSION, AUC, RUNS],
    )


@oracle
def evaluation_tables():
    keep = "where place = 1 or place = places or next_pos <> pos or next_neg <> neg"
    return _evaluated(
        f"""select 'roc' as curve, {snap('fp / n')} as x, {snap('tp / p')} as y, {snap('-score')} as threshold from cumulative {keep}
        union all select 'roc', 0.0::double, 0.0::double, null::double
        union all select 'pr', {snap('tp / p')}, {snap('tp / (tp + fp)')}, {snap('-score')} from cumulative
        union all select 'pr', 0.0::double, 1.0::double, null::double""",
        [_cumulative("scored")],
    )


# ---- forecasts ----------------------------------------------------------------------------------

LABELLED = (
    "labelled",
    "select sample_id, host, ts, "
    + ", ".join(FORECAST_METRICS)
    + ", "
    + ", ".join(
        f"(min(case when {m} >= {t} then ts end) over ({HOST_ORDER} rows between current row and unbounded following)"
        f" - ts) / 60.0e0 as ttt_{m}"
        for m, t in FORECAST_METRICS.items()
    )
    + " from samples",
)
TRAINING = (
    "training",
    " union all ".join(
        f"select sample_id, host, ts, '{m}' as metric, {m} as x, ttt_{m} as y from labelled where ttt_{m} is not null"
        for m in FORECAST_METRICS
    ),
)
# Textbook least squares from centred sums; the spread is taken from the residuals themselves.
FITS = (
    "fits",
    """select host, metric, slope, intercept, n, (select sqrt(avg(pow(t.y - intercept - slope * t.x, 2)))
      from training t where t.host = f.host and t.metric = f.metric) as residual_std
    from (select host, metric, case when min(x) < max(x) then regr_slope(y, x) else 0.0 end as slope,
      case when min(x) < max(x) then regr_intercept(y, x) else avg(y) end as intercept, count(*) as n
      from training group by host, metric) f""",
)
FIT_CTES = [LABELLED, TRAINING, FITS]
PREDICTED = (
    "predicted",
    """select sample_id, v.host, v.ts, v.metric, intercept + slope * x as time_to_threshold_minutes,
      greatest(0.0, intercept + slope * x - 1.96 * residual_std) as confidence_lower,
      intercept + slope * x + 1.96 * residual_std as confidence_upper
    from ("""
    + " union all ".join(f"select sample_id, host, ts, '{m}' as metric, {m} as x from samples" for m in FORECAST_METRICS)
    + ") v join fits f on f.host = v.host and f.metric = v.metric",
)


@oracle
def ttt_label():
    columns = ", ".join(f"{snap(f'ttt_{m}')} as ttt_{m}" for m in FORECAST_METRICS)
    return statement(f"select sample_id, host, ts, {columns} from labelled", ["samples"], [LABELLED])


@oracle
def forecast_linear_fit():
    return statement(
        f"select host, metric, {snap('slope')} as slope, {snap('intercept')} as intercept, n from fits",
        ["samples"],
        FIT_CTES,
    )


@oracle
def forecast_residual_std():
    return statement(f"select host, metric, {snap('residual_std')} as residual_std from fits", ["samples"], FIT_CTES)


@oracle
def forecast_multi_metric():
    return statement(
        f"""select host, metric, {snap('slope')} as slope, {snap('intercept')} as intercept,
        {snap('residual_std')} as residual_std, n from fits where n >= 2""",
        ["samples"],
        FIT_CTES,
    )


@oracle
def forecast_linear_two():
    """Normal equations of two regressors, solved by Cramer's rule."""
    sums = {"s11": ("x1", "x1"), "s12": ("x1", "x2"), "s22": ("x2", "x2"), "s1y": ("x1", "y"), "s2y": ("x2", "y")}
    centred = ", ".join(f"sum(({a} - m{a}) * ({b} - m{b})) as {name}" for name, (a, b) in sums.items())
    known = "known", "select cpu_pct as x1, mem_pct as x2, ttt_cpu_pct as y from labelled where ttt_cpu_pct is not null"
    means = "means", "select avg(x1) as mx1, avg(x2) as mx2, avg(y) as my from known"
    slopes = "slopes", f"""
      select (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) as b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) as b2,
        any_mx1 as mx1, any_mx2 as mx2, any_my as my
      from (select {centred}, any_value(mx1) as any_mx1, any_value(mx2) as any_mx2, any_value(my) as any_my from known, means)"""
    line = "my + b1 * ({} - mx1) + b2 * ({} - mx2)"
    spread = "spread", f"select stddev_pop(y - ({line.format('x1', 'x2')})) as sd from known, slopes"
    guess = "guess", f"select sample_id, {line.format('cpu_pct', 'mem_pct')} as p, sd from labelled, slopes, spread"
    return statement(
        f"""select sample_id, {snap('p', 4)} as time_to_threshold_minutes,
          {snap('greatest(0, p - 1.96 * sd)', 4)} as confidence_lower, {snap('p + 1.96 * sd', 4)} as confidence_upper from guess""",
        ["samples"],
        [LABELLED, known, means, slopes, spread, guess],
    )


def _eliminated(metric: str) -> list[tuple[str, str]]:
    """Normal equations of all metrics for one label, by elimination in order; a metric that those before it explain is left out."""
    k, label = len(METRICS), f"ttt_{metric}"
    every = ", ".join(f"{m} as v{i + 1}" for i, m in enumerate(METRICS))
    centre = ", ".join(f"avg(v{i + 1}) as m{i + 1}" for i in range(k))
    product = lambda i, j: f"avg((v{i} - m{i}) * (v{j} - m{j}))"
    rows = ", ".join(
        "[" + ", ".join([*[product(i, j) for j in range(1, k + 1)], f"avg((v{i} - m{i}) * (y - my))"]) + "]" for i in range(1, k + 1)
    )
    means = ", ".join(f"any_value(m{i + 1})" for i in range(k))
    unit = f"list_transform(a, lambda r, i: list_transform(r, lambda v, j: v / (s[i] * case when j <= {k} then s[j] else 1 end)))"
    # One step of elimination: all other rows lose their share of the pivot's row, unless the pivot is left out.
    step = """case when u[p][p] <= 1e-9 then u else list_transform(u, lambda r, i:
        case when i = p then r else list_transform(r, lambda v, j: v - r[p] / u[p][p] * u[p][j]) end) end"""
    kept = "case when u[i][i] > 1e-9 and list_contains(used, i) then u[i][KK] / u[i][i] / s[i] else 0 end".replace("KK", str(k + 1))
    guess = " + ".join(f"b[{i + 1}] * ({m} - mv[{i + 1}])" for i, m in enumerate(METRICS))
    tag = metric
    return [
        (f"known_{tag}", f"select {every}, {label} as y from labelled_all where {label} is not null"),
        (f"means_{tag}", f"select {centre}, avg(y) as my from known_{tag}"),
        (f"gram_{tag}", f"select [{rows}] as a, [{means}] as mv, any_value(my) as my from known_{tag}, means_{tag}"),
        (f"scaled_{tag}", f"""select {unit} as u, s, mv, my from (
          select *, list_transform(range(1, {k + 1}), lambda i: sqrt(a[i][i])) as s from gram_{tag})"""),
        (f"steps_{tag}", f"""select 1 as p, u, []::int[] as used from scaled_{tag}
          union all select p + 1, {step}, case when u[p][p] > 1e-9 then list_append(used, p) else used end from steps_{tag} where p <= {k}"""),
        (f"solved_{tag}", f"""select list_transform(range(1, {k + 1}), lambda i: {kept}) as b, mv, my
          from (select * from steps_{tag} where p = {k + 1}), scaled_{tag} t(u0, s, mv, my)"""),
        (f"guess_{tag}", f"select sample_id, {label} as y, my + {guess} as p from labelled_all, solved_{tag}"),
        (f"told_{tag}", f"""select sample_id, '{metric}' as metric, p, (select stddev_pop(y - p) from guess_{tag} where y is not null) as sd
          from guess_{tag}"""),
    ]


@oracle
def forecast_gbt_fit():
    """Boosting on histograms, tree by tree and level by level; cells with equal parts of all metrics go together."""
    k, bins, unit = len(METRICS), 32, 1.0 / 1024
    ends = ", ".join(f"min({m}) as lo{i}, max({m}) as hi{i}" for i, m in enumerate(METRICS))
    parts = ", ".join(
        f"case when hi{i} > lo{i} then greatest(0, least({bins - 1}, floor(({m} - lo{i}) / (hi{i} - lo{i}) * {bins}.0e0)))::int else 0 end"
        for i, m in enumerate(METRICS)
    )
    ctes = [
        LABELLED,
        ("rows_", f"select l.sample_id, {', '.join('s.' + m for m in METRICS)}, l.ttt_cpu_pct as y from labelled l join samples s using (sample_id)"),
        ("ends", f"select {ends} from rows_ where y is not null"),
        ("dealt", f"select sample_id, y, [{parts}] as p from rows_, ends"),
        ("plain", f"select p, count(y) as n, coalesce(sum(floor(y / {unit!r}e0 + 0.5)::bigint), 0)::bigint as s from dealt group by p"),
        ("base", "select floor(sum(s)::double / sum(n) + 0.5)::bigint as start from plain"),
        ("cells0", "select p, n, s - n * start as s, 0::bigint as v, 1 as node from plain, base"),
    ]
    last = "cells0"
    for tree in range(BOOSTED_TREES):
        for level in range(3):
            at = f"{tree}_{level}"
            ctes += [
                (f"h{at}", f"""select node, f, p[f + 1] as b, sum(n) as n, sum(s) as s
                  from (select node, p, n, s, unnest(range(0, {k})) as f from {last} where n > 0 and node >= {2**level}) group by all"""),
                (f"g{at}", f"""select *, sum(n) over (partition by node, f) as nt, sum(s) over (partition by node, f) as st,
                  sum(n) over w as nl, sum(s) over w as sl from h{at} window w as (partition by node, f order by b)"""),
                (f"b{at}", f"""select node, f, b from (
                  select *, sl::double * sl::double / nl + (st - sl)::double * (st - sl)::double / (nt - nl) as gain,
                    st::double * st::double / nt as no_cut from g{at} where nl < nt)
                  where gain > no_cut qualify row_number() over (partition by node order by gain desc, f, b) = 1"""),
                (f"cells{at}", f"""select c.* replace (case when b.node is null then c.node when c.p[b.f + 1] <= b.b then 2 * c.node
                  else 2 * c.node + 1 end as node) from {last} c left join b{at} b on b.node = c.node and c.node >= {2**level}"""),
            ]
            last = f"cells{at}"
        ctes += [
            (f"v{tree}", f"select node, floor(0.1e0 * sum(s)::double / sum(n) + 0.5)::bigint as own from {last} where n > 0 group by node"),
            (f"cells{tree + 1}", f"""select p, n, s - n * own as s, v + own as v, 1 as node from {last} join v{tree} using (node)"""),
        ]
        last = f"cells{tree + 1}"
    ctes += [
        ("guess", f"select sample_id, y, (start + v) * {unit!r}e0 as p from dealt join {last} using (p), base"),
        ("spread", "select stddev_pop(y - p) as sd from guess"),
    ]
    return statement(
        f"""select sample_id, {snap('p', 4)} as time_to_threshold_minutes, {snap('greatest(0, p - 1.96 * sd)', 4)} as confidence_lower,
          {snap('p + 1.96 * sd', 4)} as confidence_upper from guess, spread""",
        ["samples"],
        [(f"{name} as materialized" if name.startswith("cells") else name, body) for name, body in ctes],
    ).replace("as materialized as (", "as materialized (")


@oracle
def forecast_linear_features():
    every = ("labelled_all", f"select l.sample_id, {', '.join('s.' + m for m in METRICS)}, {', '.join('ttt_' + m for m in FORECAST_METRICS)}"
             " from labelled l join samples s using (sample_id)")
    ctes = [LABELLED, every, *[c for m in FORECAST_METRICS for c in _eliminated(m)]]
    told = " union all ".join(f"select * from told_{m}" for m in FORECAST_METRICS)
    return statement(
        f"""select sample_id, metric, {snap('p', 4)} as time_to_threshold_minutes,
          {snap('greatest(0, p - 1.96 * sd)', 4)} as confidence_lower, {snap('p + 1.96 * sd', 4)} as confidence_upper from ({told})""",
        ["samples"],
        ctes,
        recursive=True,
    )


FORECAST_SNAPPED = ", ".join(
    f"{snap(c)} as {c}" for c in ("time_to_threshold_minutes", "confidence_lower", "confidence_upper")
)


@oracle
def forecast_predict():
    return statement(
        f"select sample_id, host, metric, {FORECAST_SNAPPED} from predicted", ["samples"], [*FIT_CTES, PREDICTED]
    )


@oracle
def forecast_critical():
    return statement(
        f"""select sample_id, metric, {snap('time_to_threshold_minutes')} as time_to_threshold_minutes from predicted
        where time_to_threshold_minutes < 24 * 60""",
        ["samples"],
        [*FIT_CTES, PREDICTED],
    )


def _duration_text(minutes: str) -> str:
    s = f"cast(trunc(({minutes}) * 60) as bigint)"
    return f"""case when {s} < 60 then {s} || 's' when {s} < 3600 then ({s} // 60) || 'm'
      when {s} < 86400 then ({s} // 3600) || 'h' || case when {s} % 3600 >= 60 then ' ' || ({s} % 3600 // 60) || 'm' else '' end
      else ({s} // 86400) || 'd' || case when {s} % 86400 >= 3600 then ' ' || ({s} % 86400 // 3600) || 'h' else '' end end"""


@oracle
def forecast_table():
    t = "time_to_threshold_minutes"
    return statement(
        f"""select host, metric, {_duration_text(t)} as time_text,
          '±' || ({_duration_text('(confidence_upper - confidence_lower) / 2')}) as confidence_text,
          case when {t} < 60 then 'red' when {t} < 1440 then 'yellow' else 'green' end as urgency
        from predicted where sample_id in (select sample_id from samples
          qualify row_number() over (partition by host order by ts desc, sample_id desc) = 1)""",
        ["samples"],
        [*FIT_CTES, PREDICTED],
    )


# ---- alerts -------------------------------------------------------------------------------------


def _hits(source: str, rules: list[tuple[str, str, str, str]]) -> str:
    return " union all ".join(
        f"select sample_id, host, ts, {i}::int as rule_order, '{name}' as rule, '{severity}' as severity, "
        f"{message} as message from {source} where {condition}"
        for i, (name, severity, condition, message) in enumerate(rules)
    )


def _over(metric: str, limit: float) -> str:
    return f"'{metric} exceeded threshold: ' || {fixed(metric, 1)} || ' >= {limit}'"


ANOMALY = ("anomaly_detected", "critical", "is_anomaly", f"'Anomaly detected (score=' || {fixed('score', 3)} || ')'")
ALL_RULES = [
    ("cpu_high", "warning", "cpu_pct >= 90", _over("cpu_pct", 90.0)),
    ("mem_high", "warning", "mem_pct >= 90", _over("mem_pct", 90.0)),
    ("swap_high", "warning", "swap_pct >= 80", _over("swap_pct", 80.0)),
    ANOMALY,
    ("busy_disk", "info", "disk_read_bps >= 2e7", "'disk busy on ' || host"),
]


@oracle
def rule_threshold():
    rules = [("temp_high", "critical", "cpu_temp >= 80", _over("cpu_temp", 80.0))]
    return statement(_hits("samples", rules), ["samples"])


@oracle
def rule_anomaly():
    return statement(_hits("alert_input", [ANOMALY]), ["alert_input"])


@oracle
def rule_forecast():
    rules = [
        (f"{m}_soon", "warning", f"ttt_{m} < 60", f"'{m} will reach threshold in ' || {fixed(f'ttt_{m} / 60', 1)} || 'h'")
        for m in FORECAST_METRICS
    ]
    return statement(_hits("labelled", rules), ["samples"], [LABELLED])


@oracle
def alerts_raw():
    return statement(_hits("alert_input", ALL_RULES), ["alert_input"])


def _cooldown(seconds: int, extra: str = "") -> str:
    """Walk each host and rule from one fired alert to the first one at least `seconds` later."""
    numbered = (
        "numbered",
        "select *, row_number() over (partition by host, rule order by ts, sample_id, rule_order) as place from hits",
    )
    walk = (
        "walk",
        f"""select host, rule, place, ts, case when ts >= {seconds} then ts else 0 end as fired_at, ts >= {seconds} as fires
          from numbered where place = 1
        union all
        select n.host, n.rule, n.place, n.ts, case when n.ts - w.fired_at >= {seconds} then n.ts else w.fired_at end,
          n.ts - w.fired_at >= {seconds}
        from walk w join numbered n on n.host = w.host and n.rule = w.rule and n.place = w.place + 1""",
    )
    return statement(
        f"""select n.sample_id, n.host, n.ts, n.rule_order, n.rule, n.severity, n.message{extra}
        from numbered n join walk w on n.host = w.host and n.rule = w.rule and n.place = w.place where w.fires""",
        ["alert_input"],
        [("hits", _hits("alert_input", ALL_RULES)), numbered, walk],
        recursive=True,
    )


@oracle
def alerts_cooldown():
    return _cooldown(60)


@oracle
def alerts_long_cooldown():
    return _cooldown(LONG_COOLDOWN)


@oracle
def alerts_stream():
    return _cooldown(LONG_COOLDOWN, ", false as late")


# ---- dashboard tables ---------------------------------------------------------------------------

HISTORY = (
    "history",
    """select host, ts, sample_id, row_number() over (partition by host order by ts, sample_id) as position,
      cpu_pct as cpu, mem_pct as mem, disk_read_bps / 1e6 as disk_read, disk_write_bps / 1e6 as disk_write,
      net_up_bps / 1e6 as net_up, net_down_bps / 1e6 as net_down
    from (select * from samples qualify row_number() over (partition by host order by ts desc, sample_id desc) <= 100)""",
)
SERIES = ["cpu", "mem", "disk_read", "disk_write", "net_up", "net_down"]


@oracle
def history_last_n():
    columns = ", ".join(f"{snap(s)} as {s}" for s in SERIES)
    return statement(f"select host, ts, sample_id, position, {columns} from history", ["samples"], [HISTORY])


@oracle
def latest_sample():
    return statement(
        f"""select host, sample_id, ts, {', '.join(METRICS)} from samples
        qualify row_number() over (partition by host order by ts desc, sample_id desc) = 1""",
        ["samples"],
    )


@oracle
def metric_status():
    return statement(
        """select sample_id,
          case when is_anomaly then 'red' when cpu_pct >= 90 then 'yellow' when cpu_pct >= 80 then 'orange' else 'green' end as cpu_status,
          case when mem_pct >= 90 then 'yellow' when mem_pct >= 80 then 'orange' else 'green' end as mem_status,
          case when swap_pct >= 80 then 'orange' else 'green' end as swap_status
        from alert_input""",
        ["alert_input"],
    )


NEWEST = ("newest", "select *, row_number() over (order by ts desc, id desc) as position from event_log")
STATE = "case when (select bool_or(type = 'anomaly') from newest where position <= 3) then 'red' else 'yellow' end"


@oracle
def recent_alerts():
    return statement(
        f"""select cast(position as int) as position, ts, type, explanation,
          case when type = 'anomaly' then 'red' else 'yellow' end as style, {STATE} as panel_state
        from newest where position <= 10""",
        ["flagged"],
        [EVENT_LOG, NEWEST],
    )


@oracle
def alert_state():
    return statement(
        f"select case when (select count(*) from newest) = 0 then 'green' else {STATE} end as panel_state",
        ["flagged"],
        [EVENT_LOG, NEWEST],
    )


@oracle
def trend_levels():
    level = "case when low = high then 4 else least(cast(trunc((v - low) / (high - low) * 8) as int), 8) end"
    series = " union all ".join(f"select host, position, '{s}' as series, {s} as v from history" for s in SERIES)
    return statement(
        f"""select host, series, string_agg({level}, ',' order by position) as levels from (
          select *, min(v) over (partition by host, series) as low, max(v) over (partition by host, series) as high
          from ({series})) group by host, series""",
        ["samples"],
        [HISTORY],
    )


@oracle
def metric_histogram():
    long = " union all ".join(f"select host, '{m}' as metric, {m} as v from samples" for m in METRICS)
    return statement(
        f"""select host, metric, cast(least(floor((v - low) / ((high - low) / 10)), 9) as int) as bin, count(*) as n
        from (select *, min(v) over (partition by host, metric) as low, max(v) over (partition by host, metric) as high
          from ({long})) where high > low group by all""",
        ["samples"],
    )
