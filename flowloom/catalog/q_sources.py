"""Scans, sinks, flow projections and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom import schemas as S
from flowloom.catalog import bridge as B
from flowloom.catalog.registry import query
from flowloom.functions import normalize as N
from flowloom.operators import contracts as C
from flowloom.operators.flows import assemble_flows
from flowloom.session import shared_path
from flowloom.sources import files as I

_BASE_COLS = ["row_id", "source_file", *S.BASE.fieldNames()]
_BASE_SQL = ", ".join(f'"{c}"' for c in _BASE_COLS)
_FILE_SCHEMA = T.StructType([T.StructField("row_id", T.LongType()), *S.BASE.fields])


def _with_ids(df):
    return df.select(*_BASE_COLS)


# an empty text cell of a CSV file reads back as missing
@query("scan_flows", "select {} from base".format(
    _BASE_SQL.replace('"dns_query"', "nullif(dns_query, '') as dns_query")), ("base",))
def scan_flows(spark, sf):
    path = shared_path(spark, "scan")
    schema = T.StructType([T.StructField("row_id", T.LongType()),
                           T.StructField("source_file", T.StringType()), *S.BASE.fields])
    _with_ids(B.base(spark, sf)).write.option("header", True).csv(path)
    return I.read_stage(spark, path, schema)


@query("scan_folder", "select source_file, count(*) as n_rows, sum(dst_ip_bytes) as dst_bytes "
       "from base group by source_file", ("base",))
def scan_folder(spark, sf):
    path = shared_path(spark, "folder")
    I.write_stage(_with_ids(B.base(spark, sf)), path, fmt="csv")
    df = I.read_folder(spark, path, ".csv", _FILE_SCHEMA).drop("source_file")
    return (df.groupBy(I.leaf_folder().alias("source_file"))
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("dst_ip_bytes").alias("dst_bytes")))


@query("label_from_path", "select row_id, label from base where label <> 'backdoor'", ("base",))
def label_from_path(spark, sf):
    path = shared_path(spark, "captures")
    folders = {"normal": "Normal", "scanning": "Scanning", "ddos": "DDos"}  # others: no mapping
    rows = B.base(spark, sf).select(
        "row_id", F.coalesce(N.coded(F.col("label"), folders), F.lit("Firmware")).alias("folder"))
    rows.write.partitionBy("folder").parquet(path)
    return I.label_from_path(spark.read.parquet(path), S.FOLDER_LABELS).select("row_id", "label")


@query("write_stage", "select source_file, count(*) as n_rows from base group by source_file",
       ("base",))
def write_stage(spark, sf):
    path = shared_path(spark, "stage")
    I.write_stage(_with_ids(B.base(spark, sf)), path)
    return spark.read.parquet(path).groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows"))


def _half_done(spark, sf):
    base = _with_ids(B.base(spark, sf))
    path = shared_path(spark, "done")
    first = base.agg(F.min("source_file").alias("source_file"))
    I.write_stage(base.join(F.broadcast(first), "source_file", "left_semi"), path)
    return base, spark.read.parquet(path)


_PENDING = "from base where source_file <> (select min(source_file) from base)"


@query("skip_existing", f"select row_id, source_file {_PENDING}", ("base",))
def skip_existing(spark, sf):
    return I.pending(*_half_done(spark, sf)).select("row_id", "source_file")


@query("skip_existing_anti", f"select distinct source_file {_PENDING}", ("base",))
def skip_existing_anti(spark, sf):
    base, done = _half_done(spark, sf)
    return base.select("source_file").distinct().join(done, "source_file", "left_anti")


@query("skip_bad_files", "select 'read' as status, count(distinct source_file) as n_files, count(*) as n_rows from base "
       "union all select 'unreadable', 1, 0 union all select 'empty', 1, 0", ("base",))
def skip_bad_files(spark, sf):
    path = shared_path(spark, "tolerant")
    rows = _with_ids(B.base(spark, sf)).select("row_id", "src_ip", "source_file")
    rows.repartition("source_file").write.partitionBy("source_file").parquet(f"{path}/good")
    rows.drop("source_file").limit(0).coalesce(1).write.parquet(f"{path}/empty")
    # a damaged file among the good ones: text where parquet is expected
    B.table(spark, sf, "region").selectExpr("cast(r_name as string)").coalesce(1).write.text(f"{path}/bad")
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("src_ip", T.StringType())])
    good, report = I.read_checked(spark, path, schema)
    kept = good.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_rows"))
    return (report.join(kept, "file_path", "left").groupBy("status")
            .agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")))


_MODEL_COLS = ", ".join(["row_id", *B.MODEL_FEATURES])
_MODEL_ROUND = {c: 4 for c in ("mean", "stddev")}
_MODEL_SQL = ", ".join(f"round({c}, 4) as {c}" if c in _MODEL_ROUND else c
                       for c in ["row_id", *B.MODEL_FEATURES])


@query("load_normalized", f"select {_MODEL_SQL.replace(', dur', '')}, category from model_table",
       ("model_table",))
def load_normalized(spark, sf):
    path = shared_path(spark, "model")
    table = B.model_table(spark, sf)
    table.withColumns({c: F.round(c, d) for c, d in _MODEL_ROUND.items()}).drop(
        "category").write.parquet(path)
    cfg = I.DatasetConfig("flows", path, "label", "binary_normal", ("dur",), "parquet")
    return I.load_normalized(spark, cfg)


_PRINTED = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]
_PRINT_TEXT = " || ".join(f"coalesce(length({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in _PRINTED)


@query("dataset_fingerprint", f"""with d as (select sha256({_PRINT_TEXT}) as d from lineitem)
select count(*) as n_rows, sum(('0x' || substr(d, 1, 15))::bigint::hugeint)::varchar as digest_a,
  sum(('0x' || substr(d, 16, 15))::bigint::hugeint)::varchar as digest_b from d""")
def dataset_fingerprint(spark, sf):
    return I.fingerprint(B.table(spark, sf, "lineitem"), _PRINTED)


# --- packets to flows ---------------------------------------------------------------------------
FLOW_GAP = 120000


FLOWS_SQL = f"""
with k as (select *, case when (src_ip, src_port) <= (dst_ip, dst_port) then src_ip else dst_ip end as a_ip,
    case when (src_ip, src_port) <= (dst_ip, dst_port) then src_port else dst_port end as a_port,
    case when (src_ip, src_port) <= (dst_ip, dst_port) then dst_ip else src_ip end as b_ip,
    case when (src_ip, src_port) <= (dst_ip, dst_port) then dst_port else src_port end as b_port
  from packets),
g as (select *, case when ts - lag(ts) over w < {FLOW_GAP} then 0 else 1 end as fresh from k
  window w as (partition by a_ip, a_port, b_ip, b_port, protocol order by ts, row_id)),
s as (select *, sum(fresh) over (partition by a_ip, a_port, b_ip, b_port, protocol
  order by ts, row_id rows between unbounded preceding and current row) as session from g),
d as (select *, first_value(src_ip) over f as first_ip, first_value(src_port) over f as first_port
  from s window f as (partition by a_ip, a_port, b_ip, b_port, protocol, session
    order by ts, row_id rows between unbounded preceding and unbounded following))
select first_ip as src_ip, case when first_ip = a_ip and first_port = a_port then b_ip else a_ip end as dst_ip,
  first_port as src_port, case when first_ip = a_ip and first_port = a_port then b_port else a_port end as dst_port,
  protocol, min(ts) as stime, max(ts) as ltime, (max(ts) - min(ts)) / 1000.0e0 as dur,
  count(*) filter (where src_ip = first_ip and src_port = first_port) as src_pkts,
  count(*) filter (where not (src_ip = first_ip and src_port = first_port)) as dst_pkts,
  coalesce(sum(bytes) filter (where src_ip = first_ip and src_port = first_port), 0) as src_ip_bytes,
  coalesce(sum(bytes) filter (where not (src_ip = first_ip and src_port = first_port)), 0) as dst_ip_bytes
from d group by a_ip, a_port, b_ip, b_port, protocol, session, first_ip, first_port"""


@query("flow_assembly", FLOWS_SQL, ("packets",))
def flow_assembly(spark, sf):
    out = assemble_flows(B.packets(spark, sf), gap_ms=FLOW_GAP)
    return out.select("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "stime", "ltime",
                      "dur", "src_pkts", "dst_pkts", "src_ip_bytes", "dst_ip_bytes")


@query("flow_id", "select row_id, concat_ws('-', src_ip, dst_ip, cast(src_port as varchar), "
       "cast(dst_port as varchar), proto) as flow_id from base", ("base",))
def flow_id(spark, sf):
    c = F.col
    key = N.flow_key(c("src_ip"), c("dst_ip"), c("src_port"), c("dst_port"), c("proto"))
    return B.base(spark, sf).select("row_id", key.alias("flow_id"))


@query("flow_basic_export", """select src_ip, dst_ip, src_port, dst_port, protocol,
  stime as bidirectional_first_seen_ms, ltime as bidirectional_last_seen_ms,
  src_pkts + dst_pkts as bidirectional_packets, src_ip_bytes + dst_ip_bytes as bidirectional_bytes,
  src_pkts as src2dst_packets, src_ip_bytes as src2dst_bytes, dst_pkts as dst2src_packets,
  dst_ip_bytes as dst2src_bytes from raw""", ("raw",))
def flow_basic_export(spark, sf):
    c = F.col
    return B.raw_flows(spark, sf).select(
        "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
        c("stime").alias("bidirectional_first_seen_ms"),
        c("ltime").alias("bidirectional_last_seen_ms"),
        (c("src_pkts") + c("dst_pkts")).alias("bidirectional_packets"),
        (c("src_ip_bytes") + c("dst_ip_bytes")).alias("bidirectional_bytes"),
        c("src_pkts").alias("src2dst_packets"), c("src_ip_bytes").alias("src2dst_bytes"),
        c("dst_pkts").alias("dst2src_packets"), c("dst_ip_bytes").alias("dst2src_bytes"))


@query("flow_six_features", """select row_id, dst_port,
  case when src_pkts > 0 and dst_pkts = 0 then 0 when src_pkts > 0 and dst_pkts > 0 then 1 else 2
    end as conn_state, src_pkts, protocol as proto, src_ip_bytes, dst_ip_bytes from raw""",
       ("raw",))
def flow_six_features(spark, sf):
    state = N.state_from_packets(F.col("src_pkts"), F.col("dst_pkts"), two_way="S1")
    return B.raw_flows(spark, sf).select(
        "row_id", "dst_port", N.coded(state, S.STATE_CODES_ALT).alias("conn_state"), "src_pkts",
        F.col("protocol").alias("proto"), "src_ip_bytes", "dst_ip_bytes")


# --- projections and cleaning ---------------------------------------------------------------------
@query("base_table", f"select {_BASE_SQL} from base", ("base",))
def base_table(spark, sf):
    return _with_ids(B.base(spark, sf))


@query("required_fields", f"select {_BASE_SQL} from req", ("req",))
def required_fields(spark, sf):
    return _with_ids(B.complete(spark, sf))


@query("skip_bad_rows", """select row_id, try_cast(replace(dns_text, 'x', '') as int) as n,
  dns_text like '%y%' as bad from (select row_id,
    case when row_id % 17 = 0 then concat(cast(row_id as varchar), 'y')
    else concat(cast(row_id as varchar), 'x') end as dns_text from base)""", ("base",))
def skip_bad_rows(spark, sf):
    """Good rows keep their value, bad ones go to the side table; both are returned, marked."""
    text = F.concat(F.col("row_id").cast("string"),
                    F.when(F.col("row_id") % 17 == 0, "y").otherwise("x"))
    rows = B.base(spark, sf).withColumn("text", F.regexp_replace(text, "x", ""))
    good, bad = C.split_bad_rows(rows, {"n": F.expr("try_cast(text as int)")})
    return (good.select("row_id", "n", F.lit(False).alias("bad"))
            .unionByName(bad.select("row_id", F.lit(None).cast("int").alias("n"),
                                    F.lit(True).alias("bad"))))


@query("drop_nulls_model", "select row_id, proto, conn_state, service, src_ip_bytes, label from base "
       "where proto is not null and conn_state is not null and service is not null "
       "and src_ip_bytes is not null and label is not null", ("base",))
def drop_nulls_model(spark, sf):
    cols = ["proto", "conn_state", "service", "src_ip_bytes", "label"]
    return C.required(B.base(spark, sf).select("row_id", *cols), cols)


@query("fill_sentinels", """select row_id, coalesce(nullif(dns_query, ''), '-') as dns_query,
  coalesce(nullif(connection_state, ''), 'OTH') as state, coalesce(nullif(src_pkts, 0), -1) as src_pkts,
  coalesce(nullif(src_ip, ''), '0.0.0.0') as src_ip from raw""", ("raw",))
def fill_sentinels(spark, sf):
    c = F.col
    return B.raw_flows(spark, sf).select(
        "row_id", N.falsy_default(c("dns_query"), "-").alias("dns_query"),
        N.falsy_default(c("connection_state"), "OTH").alias("state"),
        N.falsy_default(c("src_pkts"), -1).alias("src_pkts"),
        N.falsy_default(c("src_ip"), "0.0.0.0").alias("src_ip"))


def _column_query(name, column, sql):
    @query(name, f"select row_id, {sql} as {name} from raw", ("raw",))
    def run(spark, sf):
        return B.raw_flows(spark, sf).select("row_id", column(F.col).alias(name))


_KEEP = "case when {c} is null or {c} = '' then 'None' when {c} in ({v}) then {c} else 'Other' end"
_PKT = ("case when coalesce(src_pkts, 0) > 0 and coalesce(dst_pkts, 0) = 0 then {a} "
        "when coalesce(src_pkts, 0) > 0 and coalesce(dst_pkts, 0) > 0 then {b} else {c} end")
_STATE_VOCAB = _KEEP.format(c="connection_state", v="'S0', 'SF', 'REJ', 'OTH'")
_SERVICE_VOCAB = _KEEP.format(c="requested_service", v="'-', 'dns', 'http'")
_DERIVED = (f"case when connection_state <> '' then {_STATE_VOCAB} else "
            + _PKT.format(a="'S0'", b="'SF'", c="'OTH'") + " end")


def _register_columns():
    def derived(c):
        return N.derive_conn_state(c("connection_state"), c("src_pkts"), c("dst_pkts"))

    _column_query("proto_to_str", lambda c: N.proto_name(c("protocol")),
                  "case when protocol is null then 'None' when protocol = 6 then 'tcp' "
                  "when protocol = 17 then 'udp' else 'Other' end")
    _column_query("dns_bool", lambda c: N.flag_text(c("dns_rejected")),
                  "case when dns_rejected is null then '-' when dns_rejected then 'T' else 'F' end")
    _column_query("dns_bool_int", lambda c: N.flag_int(c("dns_rd")), "coalesce(cast(dns_rd as int), 0)")
    _column_query("normalize_conn_state", lambda c: N.conn_state_vocab(c("connection_state")), _STATE_VOCAB)
    _column_query("normalize_service", lambda c: N.service_vocab(c("requested_service")), _SERVICE_VOCAB)
    _column_query("derive_conn_state", derived, _DERIVED)
    _column_query("derive_service", lambda c: N.derive_service(c("requested_service"),
                                                     c("application_name")),
                  f"case when requested_service <> '' then {_SERVICE_VOCAB} "
                  "when application_name is null or application_name = '' then 'None' "
                  "when lower(application_name) like '%dns%' then 'dns' "
                  "when lower(application_name) like '%http%' then 'http' "
                  "when lower(application_name) in ('unknown', 'unrated') then '-' "
                  "else 'Other' end")
    _column_query("state_number", lambda c: N.coded(derived(c), S.STATE_CODES, -1),
                  f"case {_DERIVED} when 'S0' then 1 when 'SF' then 2 when 'REJ' then 3 "
                  "when 'OTH' then 0 when 'None' then -2 else -1 end")
    _column_query("proto_number", lambda c: N.coded(N.proto_name(c("protocol")), S.PROTO_CODES, -1),
                  "case when protocol is null then -1 when protocol in (6, 17) then protocol "
                  "else 0 end")
    _column_query("conn_state_code_alt", lambda c: N.coded(N.state_from_packets(c("src_pkts"), c("dst_pkts"), "S1"),
                          S.STATE_CODES_ALT), _PKT.format(a=0, b=1, c=2))
    _column_query("binary_label", lambda c: N.binary_category(c("label")),
                  "case when lower(label) = 'normal' then 0 else 1 end")
    _column_query("anomaly_flag", lambda c: F.when(F.when(c("dst_pkts") > 4, 1).otherwise(-1) == 1, 0).otherwise(1),
                  "case when dst_pkts > 4 then 0 else 1 end")
    _column_query("ms_to_seconds", lambda c: N.ms_to_seconds(c("duration_ms")), "duration_ms / 1000.0e0")


_register_columns()


@query("normalize_frame", "select row_id, src_pkts, dst_pkts, category from model_table",
       ("model_table",))
def normalize_frame(spark, sf):
    rows = B.model_table(spark, sf).select("row_id", "src_pkts", "dst_pkts", "dur", "label")
    return I.normalize_frame(rows, I.DatasetConfig("flows", "", "label", "binary_normal",
                                                   ("dur", "stime")))


@query("drop_leak_columns", "select row_id, stime, src_pkts from base", ("base",))
def drop_leak_columns(spark, sf):
    rows = B.base(spark, sf).select("row_id", "stime", "ltime", "src_pkts", "label")
    return I.drop_leaks(rows, ("ltime", "type"))


@query("select_features", "select src_ip_bytes, dst_ip_bytes, src_pkts, dst_pkts, proto, label "
       "from base", ("base",))
def select_features(spark, sf):
    return B.base(spark, sf).select("src_ip_bytes", "dst_ip_bytes", "src_pkts", "dst_pkts",
                                    "proto", "label")


@query("align_columns", "select row_id, src_pkts, 0 as proto_icmp, label from base", ("base",))
def align_columns(spark, sf):
    return C.align(B.base(spark, sf), ["row_id", "src_pkts", "proto_icmp", "label"])


@query("multiclass_label", "select row_id, case lower(l) when 'normal' then 0 when 'backdoor' then 1 "
       "when 'ddos' then 3 when 'scanning' then 6 end as category from (select row_id, "
       "case when row_id % 23 = 0 then 'Worm' else upper(label) end as l from base)", ("base",))
def multiclass_label(spark, sf):
    label = F.when(F.col("row_id") % 23 == 0, "Worm").otherwise(F.upper("label"))
    return B.base(spark, sf).select(
        "row_id", N.coded(F.lower(label), S.CLASS_CODES).alias("category"))


@query("unmatched_labels", "select distinct upper(event_type) as label from events "
       "where lower(event_type) not in ('normal', 'backdoor', 'dos', 'ddos', 'injection', 'mitm', "
       "'scanning', 'ransomware', 'password', 'xss')")
def unmatched_labels(spark, sf):
    rows = B.table(spark, sf, "events").select(F.upper("event_type").alias("label"))
    return rows.where(N.coded(F.lower("label"), S.CLASS_CODES).isNull()).distinct()


@query("class_code_alt", "select row_id, case label when 'normal' then 0 when 'ddos' then 2 "
       "when 'scanning' then 4 end as class from base", ("base",))
def class_code_alt(spark, sf):
    folder = N.coded(F.col("label"), {"normal": "Normal", "ddos": "NormalDdos",
                                      "scanning": "NormalScanning", "backdoor": "NormalBackdoor"})
    return B.base(spark, sf).select(
        "row_id", N.coded(folder, S.FOLDER_CLASS_CODES).alias("class"))


@query("filter_labels", "select row_id, label from base where label in ('ddos', 'normal')",
       ("base",))
def filter_labels(spark, sf):
    return B.base(spark, sf).where(F.col("label").isin("ddos", "normal")).select("row_id", "label")


@query("split_by_class", "select category, count(*) as n_rows, sum(src_pkts) as src_pkts "
       "from model_table group by category", ("model_table",))
def split_by_class(spark, sf):
    return (B.model_table(spark, sf).groupBy("category")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("src_pkts").alias("src_pkts")))


@query("vocab_contract", """select 'proto' as field, count(*) filter (where proto not in
  ('tcp', 'udp', 'Other', 'None')) as violations from base union all
select 'dns_rejected', count(*) filter (where dns_rejected not in ('T', 'F', '-')) from base union all
select 'conn_state', count(*) filter (where conn_state not in ('S0', 'SF', 'REJ', 'OTH', 'Other', 'None')) from base
union all select 'service', count(*) filter (where service not in ('-', 'dns', 'http', 'Other', 'None')) from base""",
       ("base",))
def vocab_contract(spark, sf):
    return C.vocabulary_violations(B.base(spark, sf), S.CONTRACT_VOCAB, S.BASE.fieldNames())


@query("vocab_drift", """select 'connection_state' as field, connection_state as value, count(*) as n
  from raw where connection_state <> '' and connection_state not in ('S0', 'SF', 'REJ', 'OTH') group by 2
union all select 'requested_service', requested_service, count(*) from raw
  where requested_service <> '' and requested_service not in ('-', 'dns', 'http') group by 2
union all select 'protocol', cast(protocol as varchar), count(*) from raw
  where protocol not in (6, 17) group by 2""", ("raw",))
def vocab_drift(spark, sf):
    return C.vocabulary_drift(B.raw_flows(spark, sf), C.RAW_VOCAB)


@query("signed_to_index", "select row_id, case when label = 'normal' then 0 else 1 end as category "
       "from base", ("base",))
def signed_to_index(spark, sf):
    rows = B.base(spark, sf).select("row_id", "label")
    benign = rows.where(F.col("label") == "normal").withColumn("category", F.lit(0))
    attack = rows.where(F.col("label") != "normal").withColumn("category", F.lit(1))
    return benign.unionByName(attack).drop("label")
