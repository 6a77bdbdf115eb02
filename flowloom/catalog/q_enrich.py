"""Windows, damped statistics and the enriched tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom import schemas as S
from flowloom.catalog import bridge as B
from flowloom.catalog.registry import cte, query
from flowloom.operators.contracts import required
from flowloom.operators.counters import file_order, running_bytes, running_count
from flowloom.operators.damped import Stat, bin_carry, damped
from flowloom.operators.prefix import SLICE, spread, time_slices
from flowloom.plans import enrich as E


def safe(df: DataFrame) -> DataFrame:
    """Column names any SQL dialect takes unquoted."""
    return df.toDF(*[c.replace(".", "_").replace("-", "_") for c in df.columns])


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def _sliced(spark, sf):
    source = E.add_pair(time_slices(B.complete(spark, sf)))
    return spread(source), source


_PAST = "(b.stime, b.row_id) <= (a.stime, a.row_id)"


def _decay(lam: float) -> str:
    return f"exp(-{lam}e0 * (a.stime - b.stime) / 1000.0e0)"


def _weight(lam: float) -> str:
    return f"sum({_decay(lam)})"


def _mean(lam: float, x: str) -> str:
    return f"sum(b.{x} * {_decay(lam)}) / sum({_decay(lam)})"


cte("timed", """select *, src_ip_bytes + dst_ip_bytes as flow_bytes, least(src_ip, dst_ip) as lo,
  greatest(src_ip, dst_ip) as hi,
  coalesce(stime - lag(stime) over (partition by least(src_ip, dst_ip), greatest(src_ip, dst_ip)
    order by stime, row_id), 0) as gap from req""", "req")
cte("damped_src", f"""select a.row_id, {_weight(0.01)} as w001, {_weight(0.1)} as w01,
  {_weight(1.0)} as w1, {_weight(3.0)} as w3, {_mean(0.01, 'flow_bytes')} as m001,
  sqrt(greatest(0, sum(b.flow_bytes * b.flow_bytes * {_decay(0.1)}) / {_weight(0.1)}
    - power({_mean(0.1, 'flow_bytes')}, 2))) as sd01
  from timed a join timed b on a.src_ip = b.src_ip and {_PAST} group by a.row_id""", "timed")
cte("damped_dir", f"""select a.row_id, {_weight(0.01)} as w001, {_weight(0.1)} as w01,
  {_weight(1.0)} as w1, {_mean(0.1, 'src_ip_bytes')} as m01
  from timed a join timed b on a.src_ip = b.src_ip and a.dst_ip = b.dst_ip and {_PAST}
  group by a.row_id""", "timed")
cte("damped_jit", f"""select a.row_id, {_mean(1.0, 'gap')} as m1
  from timed a join timed b on a.lo = b.lo and a.hi = b.hi and {_PAST} group by a.row_id""",
    "timed")
cte("counted", """select *,
  count(*) over (partition by source_file, src_ip order by stime, row_id
    rows between unbounded preceding and current row) as n_src,
  count(*) over (partition by source_file, dst_ip order by stime, row_id
    rows between unbounded preceding and current row) as n_dst,
  cast(sum(src_ip_bytes + dst_ip_bytes) over (partition by dst_ip order by stime, row_id
    rows between unbounded preceding and current row) as bigint) as tnbp from req""", "req")


@query("n_in_conn_src", "select row_id, n_src as n_in_conn_src from counted", ("counted",))
def n_in_conn_src(spark, sf):
    rows, source = _sliced(spark, sf)
    return running_count(rows, ["source_file", "src_ip"], "n_in_conn_src", source).select(
        "row_id", "n_in_conn_src")


@query("n_in_conn_dst", "select row_id, n_dst as n_in_conn_dst from counted", ("counted",))
def n_in_conn_dst(spark, sf):
    rows, source = _sliced(spark, sf)
    return running_count(rows, ["source_file", "dst_ip"], "n_in_conn_dst", source).select(
        "row_id", "n_in_conn_dst")


@query("tnbp_dst", "select row_id, tnbp as tnbp_dst from counted", ("counted",))
def tnbp_dst(spark, sf):
    rows, source = _sliced(spark, sf)
    total = F.col("src_ip_bytes") + F.col("dst_ip_bytes")
    return running_bytes(rows, "dst_ip", total, "tnbp_dst", source).select("row_id", "tnbp_dst")


@query("bot_counters", """select row_id,
  count(*) over (partition by src_ip order by stime, row_id
    rows between unbounded preceding and current row) as n_src_session,
  count(*) over (partition by dst_ip order by stime, row_id
    rows between unbounded preceding and current row) as n_dst_session from base""", ("base",))
def bot_counters(spark, sf):
    source = time_slices(B.base(spark, sf))
    rows = running_count(spread(source), ["src_ip"], "n_src_session", source)
    rows = running_count(rows, ["dst_ip"], "n_dst_session", source)
    return rows.select("row_id", "n_src_session", "n_dst_session")


_W, _M = 5, 3  # digits kept of weights and of means


@query("damped_h", f"""select row_id, round(w001, {_W}) as "H_L0_01_weight",
  round(w01, {_W}) as "H_L0_1_weight", round(w1, {_W}) as "H_L1_weight",
  round(w3, {_W}) as "H_L3_weight", round(m001, {_M}) as "H_L0_01_mean" from damped_src""",
       ("damped_src",))
def damped_h(spark, sf):
    rows, source = _sliced(spark, sf)
    out = safe(E.source_damped(rows, source).select(
        "row_id", *[F.col(f"`{s.name}`") for s in E.H_STATS]))
    return rounded(out, {c: _M if c.endswith("mean") else _W for c in out.columns[1:]})


@query("damped_mi_dir", f"""select row_id, round(w001, {_W}) as "MI_dir_L0_01_weight",
  round(w01, {_W}) as "MI_dir_L0_1_weight", round(w1, {_W}) as "MI_dir_L1_weight",
  round(m01, {_M}) as "MI_dir_L0_1_mean" from damped_dir""", ("damped_dir",))
def damped_mi_dir(spark, sf):
    rows, source = _sliced(spark, sf)
    out = safe(E.direction_damped(rows, source).select(
        "row_id", *[F.col(f"`{s.name}`") for s in E.MI_STATS]))
    return rounded(out, {c: _M if c.endswith("mean") else _W for c in out.columns[1:]})


@query("damped_hh_jit", f'select row_id, round(m1, {_M}) as "HH_jit_L1_mean" from damped_jit',
       ("damped_jit",))
def damped_hh_jit(spark, sf):
    rows, _ = _sliced(spark, sf)
    return rounded(E.jitter_damped(rows).select("row_id", "HH_jit_L1_mean"),
                   {"HH_jit_L1_mean": _M})


@query("damped_std", f"select row_id, round(sd01, {_M}) as h_l0_1_std from damped_src",
       ("damped_src",))
def damped_std(spark, sf):
    rows, source = _sliced(spark, sf)
    total = F.col("src_ip_bytes") + F.col("dst_ip_bytes")
    out = damped(rows, ["src_ip"], total, [Stat("h_l0_1_std", 0.1, "std")], source=source)
    return rounded(out.select("row_id", "h_l0_1_std"), {"h_l0_1_std": _M})


# the carry seen directly: what earlier bins still weigh at the start of each (key, bin)
@query("bucket_carry", """
select a.src_ip, a.bin, round(sum(exp(-0.1e0 * (a.bin * 400000 - b.stime) / 1000.0e0)), 5) as carry
from (select distinct src_ip, stime // 400000 as bin from req) a
join req b on a.src_ip = b.src_ip and b.stime < a.bin * 400000
group by a.src_ip, a.bin""", ("req",))
def bucket_carry(spark, sf):
    rows, source = _sliced(spark, sf)
    out = bin_carry(rows, ["src_ip"], F.lit(1.0), [Stat("w", 0.1, "weight")], source=source)
    first = F.min("bin").over(Window.partitionBy("src_ip"))
    # a bin has one cell per slice; what lies before the bin is what its first slice finds
    cells = out.groupBy("src_ip", "bin").agg(F.min_by("_c_w0", SLICE).alias("carry"))
    return (cells.withColumn("first", first).where("bin > first")
            .select("src_ip", "bin", F.round("carry", 5).alias("carry")))


# files that overlap in time, one after the other: the rule row by row, per key
_FILES = ("concat('p', cast(row_id % 3 as varchar))", "concat('p', cast(row_id % 3 as string))")
cte("in_files", f"""select *, row_number() over (order by file_no, stime, row_id) as pos from req join (
  select part, row_number() over (order by arg_min(stime, row_id), part) as file_no from (
    select *, {_FILES[0]} as part from base) group by part) on part = {_FILES[0]}""", "req", "base")


def _row_by_row(name: str, keys: str, value: str, lams: list[float]) -> None:
    fades = [f"case when n.stime > r.stime then exp(-{lam}e0 * (n.stime - r.stime) / 1000.0e0) else 1.0e0 end" for lam in lams]
    x = "cast(n.stime - r.stime as double)" if value == "step" else f"cast(n.{value} as double)"
    first = "0.0e0" if value == "step" else f"cast({value} as double)"
    sums = ", ".join(f"w{i} * {f} + 1, s{i} * {f} + {x}" for i, f in enumerate(fades))
    cte(name, f"""with recursive n as (select *, row_number() over (partition by {keys} order by pos) as nth from (
        select *, src_ip_bytes + dst_ip_bytes as flow_bytes, least(src_ip, dst_ip) as lo, greatest(src_ip, dst_ip) as hi
        from in_files)),
      r({keys}, nth, stime, row_id, {', '.join(f'w{i}, s{i}' for i in range(len(lams)))}) as (
        select {keys}, nth, stime, row_id, {', '.join(f'1.0e0, {first}' for _ in lams)} from n where nth = 1
        union all
        select {', '.join('n.' + k for k in keys.split(', '))}, n.nth, n.stime, n.row_id, {sums}
        from r join n on n.nth = r.nth + 1 and {' and '.join(f'n.{k} = r.{k}' for k in keys.split(', '))})
      select * from r""", "in_files")


_row_by_row("file_h", "src_ip", "flow_bytes", [0.01, 0.1, 1.0, 3.0])
_row_by_row("file_mi", "src_ip, dst_ip", "src_ip_bytes", [0.01, 0.1, 1.0])
_row_by_row("file_jit", "lo, hi", "step", [1.0])


@query("damped_file_sequence", f"""select row_id, round(h.w0, {_W}) as "H_L0_01_weight", round(h.w1, {_W}) as "H_L0_1_weight",
  round(h.w2, {_W}) as "H_L1_weight", round(h.w3, {_W}) as "H_L3_weight", round(h.s0 / h.w0, {_M}) as "H_L0_01_mean",
  round(m.w0, {_W}) as "MI_dir_L0_01_weight", round(m.w1, {_W}) as "MI_dir_L0_1_weight", round(m.w2, {_W}) as "MI_dir_L1_weight",
  round(m.s1 / m.w1, {_M}) as "MI_dir_L0_1_mean", round(j.s0 / j.w0, {_M}) as "HH_jit_L1_mean"
  from file_h h join file_mi m using (row_id) join file_jit j using (row_id)""", ("file_h", "file_mi", "file_jit"))
def damped_file_sequence(spark, sf):
    """State that runs on over files that overlap in time, so that clocks go back."""
    base = B.base(spark, sf).withColumn("source_file", F.expr(_FILES[1]))
    flows = required(base, S.REQUIRED)
    out = safe(E.file_damped(E.by_file(flows, file_order(base))).select(
        "row_id", *[F.col(f"`{s.name}`") for s in [*E.H_STATS, *E.MI_STATS, *E.JITTER_STATS]]))
    return rounded(out, {c: _M if c.endswith("mean") else _W for c in out.columns[1:]})


@query("file_order", """select source_file, first_time,
  row_number() over (order by first_time nulls last, source_file) as file_no from
  (select source_file, arg_min(stime, row_id) as first_time from base group by source_file)""",
       ("base",))
def file_order_query(spark, sf):
    return file_order(B.base(spark, sf))


_STATE = ("case conn_state when 'S0' then 1 when 'SF' then 2 when 'REJ' then 3 when 'OTH' then 0 "
          "when 'None' then -2 else -1 end")
_PROTO = "case proto when 'tcp' then 6 when 'udp' then 17 when 'Other' then 0 else -1 end"
cte("enriched", f"""select c.row_id, c.source_file, proto, conn_state, service, dns_rejected,
  src_ip_bytes, dst_ip_bytes, src_pkts, dst_pkts, http_status_code, dst_port, stime, ltime, dur,
  cast(tnbp as double) as "TnBPDstIP", {B.SIGNAL_SQL}, n_dst as "N_IN_Conn_P_DstIP",
  n_src as "N_IN_Conn_P_SrcIP", {_STATE} as state_number, {_PROTO} as proto_number,
  h.w001 as "H_L0_01_weight", h.w01 as "H_L0_1_weight", h.w1 as "H_L1_weight",
  h.w3 as "H_L3_weight", h.m001 as "H_L0_01_mean", d.w001 as "MI_dir_L0_01_weight",
  d.w01 as "MI_dir_L0_1_weight", d.w1 as "MI_dir_L1_weight", d.m01 as "MI_dir_L0_1_mean",
  j.m1 as "HH_jit_L1_mean", label
  from counted c join damped_src h on c.row_id = h.row_id join damped_dir d on c.row_id = d.row_id
  join damped_jit j on c.row_id = j.row_id""", "counted", "damped_src", "damped_dir", "damped_jit")
SAFE_ENRICHED = [c.replace(".", "_") for c in S.ENRICHED]
ENRICHED_DIGITS = {c.replace(".", "_"): _M if c.endswith("mean") else _W
                   for c in S.DAMPED_COLUMNS} | {"mean": 4, "stddev": 4}
_ENRICHED_OUT = ", ".join(
    f'round("{c}", {ENRICHED_DIGITS[c]}) as "{c}"' if c in ENRICHED_DIGITS else f'"{c}"'
    for c in SAFE_ENRICHED)


def enriched(spark, sf) -> DataFrame:
    return safe(E.enrich(B.base(spark, sf), keep=("row_id", "source_file")))


@query("enrich_zeek", f"select row_id, {_ENRICHED_OUT} from enriched", ("enriched",))
def enrich_zeek(spark, sf):
    return rounded(enriched(spark, sf).drop("source_file"), ENRICHED_DIGITS)


# --- the wavelet / entropy variants ------------------------------------------------------------
_V = [f"cast({c} as double)" for c in ("src_ip_bytes", "dst_ip_bytes", "src_pkts", "dst_pkts")]
_T = "(" + " + ".join(f"({x} + 1e-6)" for x in _V) + ")"
_R = [f"round_even({x}, 0)" for x in _V]


def _mult(r: str) -> str:
    return "(" + " + ".join(f"case when {r} = {o} then 1 else 0 end" for o in _R) + ")"


WAVELET_SQL = {
    "MI_dir_L5_weight": "case when " + " + ".join(_V) + " is not null then "
                        "greatest(0, ln(4.0e0) - ("
                        + " + ".join(f"ln(cast({_mult(r)} as double))" for r in _R) + ") / 4) end",
    "HH_L3_weight": "-(" + " + ".join(f"(({x} + 1e-6) / {_T}) * ln(({x} + 1e-6) / {_T})"
                                      for x in _V) + ")",
    "HH_L0_01_weight": " + ".join(
        f"case when {x} = 0 then 0.0e0 else power({x} / {_T}, 0.01e0) end" for x in _V),
    "HpHp_L0_01_weight": " + ".join(f"{x} * {x}" for x in _V),
    "HpHp_L0_01_mean": f"({' + '.join(_V)}) / 2.0e0",
    "HpHp_L0_01_std": "0.0e0",
    "HpHp_L0_01_magnitude": f"abs(({' + '.join(_V)}) / 2.0e0)",
}
_PKT_STATE = ("case when src_pkts > 0 and dst_pkts = 0 then 'S0' "
              "when src_pkts > 0 and dst_pkts > 0 then 'SF' else 'OTH' end")
_PKT_CODE = ("case when src_pkts > 0 and dst_pkts = 0 then 1 "
             "when src_pkts > 0 and dst_pkts > 0 then 2 else 0 end")


def _dashed_cte(where: str) -> str:
    return f"""select row_id, source_file, src_ip, dst_ip,
  coalesce(protocol, 0) as protocol, stime, coalesce(dns_query, '') as dns_query,
  coalesce(cast(dns_rejected as int), 0) as dns_rejected, coalesce(cast(dns_rd as int), 0) as "dns_RD",
  coalesce(connection_state, 'OTH') as state, coalesce(requested_service, '-') as service,
  coalesce(http_status_code, -1) as http_status_code, src_ip_bytes, dst_ip_bytes, src_pkts,
  dst_pkts, coalesce(dst_port, 0) as dst_port, label from raw {where}"""


def _dashed_counts(scope: str) -> str:
    frame = "order by stime, row_id rows between unbounded preceding and current row"
    return (f'count(*) over (partition by {scope}src_ip {frame}) as "N_IN_Conn_P_SrcIP", '
            f'count(*) over (partition by {scope}dst_ip {frame}) as "N_IN_Conn_P_DstIP"')


_WAVELETS = ", ".join(f'{e} as "{n}"' for n, e in WAVELET_SQL.items())


def _dashed_all(source: str, scope: str) -> str:
    return f"""select row_id, state, service, http_status_code, src_ip_bytes as src_bytes,
  dst_ip_bytes, dst_port, {_PKT_STATE} as conn_state, src_pkts, protocol as proto, {_WAVELETS},
  {_dashed_counts(scope)}, {_PKT_CODE} as state_number, protocol as proto_number, stime,
  {B.SIGNAL_SQL}, dns_query, dns_rejected, "dns_RD", label from {source}"""


cte("dashed", _dashed_cte(""), "raw")
cte("dashed_req", "select * from dashed where src_ip_bytes is not null and "
    "dst_ip_bytes is not null and src_pkts is not null and dst_pkts is not null", "dashed")
cte("dashed_enriched", _dashed_all("dashed_req", "source_file, "), "dashed_req")
cte("dashed_unfiltered", _dashed_all("dashed", "source_file, "), "dashed")
cte("dashed_session", _dashed_all("dashed", ""), "dashed")
_DASHED_DIGITS = {"MI_dir_L5_weight": 6, "HH_L3_weight": 6, "HH_L0_01_weight": 6, "mean": 4,
                  "stddev": 4}


def _out(columns: list[str]) -> str:
    names = [c.replace(".", "_").replace("-", "_") for c in columns]
    return "row_id, " + ", ".join(
        f'round("{c}", {_DASHED_DIGITS[c]}) as "{c}"' if c in _DASHED_DIGITS else f'"{c}"'
        for c in names)


def _dashed_round(df: DataFrame) -> DataFrame:
    out = safe(df)
    return rounded(out, {c: d for c, d in _DASHED_DIGITS.items() if c in out.columns})


@query("enrich_dashed", f"select {_out(S.ENRICHED_DASHED)} from dashed_enriched",
       ("dashed_enriched",))
def enrich_dashed(spark, sf):
    return _dashed_round(E.enrich_dashed(B.base_dashed(spark, sf), keep=("row_id",)))


@query("enrich_unfiltered", f"select {_out(S.ENRICHED_UNFILTERED)} from dashed_unfiltered",
       ("dashed_unfiltered",))
def enrich_unfiltered(spark, sf):
    return _dashed_round(E.enrich_unfiltered(B.base_dashed(spark, sf), keep=("row_id",)))


@query("bot_features", f"select {_out(S.COUNTER_TABLE)} from dashed_session", ("dashed_session",))
def bot_features(spark, sf):
    return _dashed_round(E.counter_table(B.base_dashed(spark, sf), keep=("row_id",)))
