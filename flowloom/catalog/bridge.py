"""Views over the given tables that stand in for flows, packets and metric tables.

Each view is one list of SQL expressions used by both engines; only the two time expressions
differ.  Whole tables are read, nothing is filtered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom import schemas as S
from flowloom.catalog.registry import cte
from flowloom.operators.contracts import required
from flowloom.plans.base import base_table, base_table_dashed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- raw flows: one event is one flow; its epoch seconds are read as milliseconds --------------
_EVENT = {
    "event_id": "event_id", "user_id": "user_id", "event_type": "event_type", "value": "value",
    "k": "cast(regexp_extract(props, '([0-9]+)', 1) as bigint)", "stime": "{seconds}",
    "millis": "{millis}", "dom": "day(ts)",
}
_FLOW = {
    "row_id": "event_id",
    "src_ip": "concat('10.0.0.', cast(user_id as {text}))",
    "dst_ip": "concat('10.1.0.', cast(k % 20 as {text}))",
    "src_port": "cast(1024 + user_id % 4 as int)",
    "dst_port": "cast(case k % 4 when 0 then 53 when 1 then 80 when 2 then 443 else 8080 end as int)",
    "protocol": "cast(case when event_id % 101 = 0 then null when event_id % 10 < 6 then 6 "
                "when event_id % 10 < 9 then 17 else 1 end as int)",
    "stime": "stime",
    "ltime": "stime + 10 * k",
    "duration_ms": "10 * k",
    "src_ip_bytes": "case when event_id % 211 = 0 then null "
                    "else cast(round(value * 100) as bigint) end",
    "dst_ip_bytes": "cast(case when event_id % 7 = 0 then 0 else 40 * (1 + k % 9) + k end as bigint)",
    "src_pkts": "cast(case when event_id % 97 = 0 then 0 else 1 + event_id % 9 end as bigint)",
    "dst_pkts": "cast(case when event_id % 7 = 0 then 0 else 1 + k % 9 end as bigint)",
    "connection_state": "case k % 13 when 0 then 'S0' when 1 then 'SF' when 2 then 'REJ' "
                        "when 3 then 'OTH' when 4 then 'RSTO' when 5 then '' end",
    "requested_service": "case k % 11 when 0 then 'dns' when 1 then 'http' when 2 then '-' "
                         "when 3 then 'ssl' when 4 then '' end",
    "application_name": "case k % 5 when 0 then 'DNS' when 1 then 'HTTP.Google' when 2 then 'TLS' "
                        "when 3 then 'Unknown' end",
    "dns_query": "case k % 3 when 0 then 'example.org' when 1 then '' end",
    "dns_rejected": "case k % 4 when 0 then true when 1 then false end",
    "dns_rd": "case k % 6 when 0 then true when 1 then false end",
    "http_status_code": "cast(case k % 7 when 0 then 200 when 1 then 404 else -1 end as int)",
    "label": "case event_type when 'signup' then 'scanning' when 'purchase' then 'ddos' "
             "when 'error' then 'backdoor' else 'normal' end",
    "source_file": "concat('f', cast(cast(floor((dom - 1) / 10) as int) as {text}))",
}
# packets: one event is one packet between a user and a service, every third one a reply
_PACKET = {
    "row_id": "event_id", "ts": "stime",
    "src_ip": "case when event_id % 3 = 0 then {b} else {a} end",
    "dst_ip": "case when event_id % 3 = 0 then {a} else {b} end",
    "src_port": "cast(case when event_id % 3 = 0 then 443 else 5000 end as int)",
    "dst_port": "cast(case when event_id % 3 = 0 then 5000 else 443 end as int)",
    "protocol": "cast(case when k % 2 = 0 then 6 else 17 end as int)",
    "bytes": "cast(round(value * 100) as bigint)",
}
_ENDS = {"a": "concat('10.0.0.', cast(user_id as {text}))",
         "b": "concat('10.1.0.', cast(k % 2 as {text}))"}

_SPARK = {"text": "string", "seconds": "unix_seconds(cast(ts as timestamp))",
          "millis": "unix_millis(cast(ts as timestamp))"}
_DUCK = {"text": "varchar", "seconds": "epoch_us(ts) // 1000000", "millis": "epoch_us(ts) // 1000"}


def _exprs(spec: dict[str, str], engine: dict[str, str]) -> list[str]:
    ends = {k: v.format(**engine) for k, v in _ENDS.items()}
    return [f"{e.format(**engine, **ends)} as {n}" for n, e in spec.items()]


def _select(spec: dict[str, str], source: str) -> str:
    return f"select {', '.join(_exprs(spec, _DUCK))} from {source}"


cte("ev", _select(_EVENT, "events"))
cte("raw", _select(_FLOW, "ev"), "ev")
cte("packets", _select(_PACKET, "ev"), "ev")

cte("base", """
select row_id, source_file,
  coalesce(nullif(src_ip, ''), '0.0.0.0') as src_ip, coalesce(nullif(dst_ip, ''), '0.0.0.0') as dst_ip,
  coalesce(src_port, 0) as src_port, coalesce(dst_port, 0) as dst_port,
  case when protocol is null then 'None' when protocol = 6 then 'tcp' when protocol = 17 then 'udp'
    else 'Other' end as proto,
  stime, ltime, coalesce(duration_ms, 0) / 1000.0e0 as dur, coalesce(dns_query, '') as dns_query,
  case when dns_rejected is null then '-' when dns_rejected then 'T' else 'F' end as dns_rejected,
  case when dns_rd is null then '-' when dns_rd then 'T' else 'F' end as "dns_RD",
  case when connection_state is not null and connection_state <> '' then
    case when connection_state in ('S0', 'SF', 'REJ', 'OTH') then connection_state else 'Other' end
    when src_pkts > 0 and dst_pkts = 0 then 'S0' when src_pkts > 0 and dst_pkts > 0 then 'SF'
    else 'OTH' end as conn_state,
  case when requested_service is not null and requested_service <> '' then
    case when requested_service in ('-', 'dns', 'http') then requested_service else 'Other' end
    when application_name is null or application_name = '' then 'None'
    when lower(application_name) like '%dns%' then 'dns'
    when lower(application_name) like '%http%' then 'http'
    when lower(application_name) in ('unknown', 'unrated') then '-' else 'Other' end as service,
  http_status_code, src_ip_bytes, dst_ip_bytes, src_pkts, dst_pkts, label
from raw""", "raw")

_REQ = " and ".join(f"{c} is not null" for c in S.REQUIRED)
cte("req", f"select * from base where {_REQ}", "base")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_exprs(_EVENT, _SPARK))


def raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr(*_exprs(_FLOW, _SPARK))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr(*_exprs(_PACKET, _SPARK))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_table(raw_flows(spark, sf_dir))


def complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base flows with every required field."""
    return required(base(spark, sf_dir), S.REQUIRED)


def base_dashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_table_dashed(raw_flows(spark, sf_dir))


# --- metric tables: line items averaged per (dataset, model, metric, iteration) ----------------
DATASETS = ["D0", "D1", "D2"]
BASELINE = "D0"
ITERATIONS = 20


def _pick(expr: str, values: list[str]) -> str:
    whens = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values))
    return f"case {expr} {whens} end"


_METRIC = {
    "dataset": _pick("l_partkey % 3", DATASETS),
    "model": _pick("l_suppkey % 7", S.MODELS),
    "metric": _pick("(l_orderkey + l_partkey) % 12", S.METRICS),
    "iteration": f"cast((l_orderkey + l_linenumber) % {ITERATIONS} as int) + 1",
    "score": "(l_discount * 5 + l_tax * 2 + l_quantity / 100.0e0) "
             "* (1 + l_partkey % 3 * (0.02e0 + l_suppkey % 7 / 100.0e0)) * 6 / 7.0e0",
}
_SCALE = "case when metric in ('TP', 'TN', 'FP', 'FN') then 1000.0e0 else 1.0e0 end"
cte("metric_rows", _select(_METRIC, "lineitem"))
cte("metrics_long",
    f"select dataset, model, metric, iteration, round(avg(score) * {_SCALE}, 10) as value "
    "from metric_rows group by dataset, model, metric, iteration", "metric_rows")


def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(*_exprs(_METRIC, _SPARK))
    scale = F.when(F.col("metric").isin(S.COUNT_METRICS), 1000.0).otherwise(1.0)
    return (rows.groupBy("dataset", "model", "metric", "iteration")
            .agg((F.avg("score")).alias("m"))
            .select("dataset", "model", "metric", "iteration",
                    F.round(F.col("m") * scale, 10).alias("value")))


# --- predictions: every line item is one scored case -------------------------------------------
_SCORED = {
    "truth": "cast(case when l_quantity > 30 then 1 else 0 end as int)",
    "score": "round(l_discount * 4 + l_tax + l_quantity / 80.0e0, 5)",
    "s1": "l_discount * 10", "s2": "l_tax * 10",
    "truth3": "cast(case when l_returnflag = 'A' then 0 when l_returnflag = 'N' then 1 else 2 end as int)",
    "guess3": "cast((l_linenumber + case when l_returnflag = 'A' then 0 when l_returnflag = 'N' "
              "then 1 else 2 end) % 3 as int)",
}
cte("scored", _select(_SCORED, "lineitem"))
cte("predicted", "select *, cast(case when score >= 0.6 then 1 else 0 end as int) as guess "
    "from scored", "scored")


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(*_exprs(_SCORED, _SPARK))
    return rows.withColumn("guess", F.when(F.col("score") >= 0.6, 1).otherwise(0))


# --- model table: numeric flow features and a binary target -------------------------------------
MODEL_FEATURES = ["src_ip_bytes", "dst_ip_bytes", "src_pkts", "dst_pkts", "http_status_code",
                  "dst_port", "dur", "sum", "max", "mean", "min", "stddev"]
_SIG = "src_ip_bytes dst_ip_bytes src_pkts dst_pkts".split()
_SUM = "(" + " + ".join(f"cast({c} as double)" for c in _SIG) + ")"
_VAR = " + ".join(f"power(cast({c} as double) - {_SUM} / 4.0e0, 2)" for c in _SIG)
SIGNAL_SQL = (f"{_SUM} as sum, case when {_SUM} is not null then cast(greatest({', '.join(_SIG)}) as double) end as max, "
              f"{_SUM} / 4.0e0 as mean, case when {_SUM} is not null then cast(least({', '.join(_SIG)}) as double) end as min, "
              f"sqrt(({_VAR}) / 4.0e0) as stddev")
cte("model_table",
    f"select row_id, {', '.join(f'cast({c} as double) as {c}' for c in MODEL_FEATURES[:7])}, "
    f"{SIGNAL_SQL}, cast(case when lower(label) = 'normal' then 0 else 1 end as int) as category, "
    "label from req", "req")


def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.functions import normalize, signal

    rows = complete(spark, sf_dir)
    v = signal.signal(*[F.col(c) for c in _SIG])
    return rows.select(
        "row_id", *[F.col(c).cast("double").alias(c) for c in MODEL_FEATURES[:7]],
        *[e.alias(n) for n, e in signal.stats(v).items()],
        normalize.binary_category(F.col("label")).alias("category"), "label")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
