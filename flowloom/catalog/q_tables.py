"""Aggregations, joins, metrics, reports and significance tests."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from flowloom import schemas as S
from flowloom.catalog import bridge as B
from flowloom.catalog.q_enrich import safe
from flowloom.catalog.registry import cte, query
from flowloom.functions import tails
from flowloom.functions.tails import t_quantile
from flowloom.operators import groupfeats as G
from flowloom.operators import metrics as M
from flowloom.operators import report as R
from flowloom.operators import stats as T


# --- aggregations ----------------------------------------------------------------------------------
@query("class_counts", "select label, count(*) as n from base group by label order by n desc, label",
       ("base",))
def class_counts(spark, sf):
    return (B.base(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "label"))


@query("stream_cardinality", "select count(distinct src_ip) as n_src, count(distinct concat(src_ip, '|', "
       "dst_ip)) as n_pairs from req", ("req",))
def stream_cardinality(spark, sf):
    req = B.complete(spark, sf)
    return req.agg(F.countDistinct("src_ip").alias("n_src"),
                   F.countDistinct("src_ip", "dst_ip").alias("n_pairs"))


_LIVE = ["src_ip_bytes", "dst_ip_bytes", "src_pkts", "dst_pkts", "dur"]


@query("nonzero_profile", " union all ".join(
    f"select '{c}' as feature, count(*) filter (where {c} <> 0) as n_live from base" for c in _LIVE)
    + " union all select 'proto_tcp', count(*) filter (where proto = 'tcp') from base"
      " union all select 'service_dns', count(*) filter (where service = 'dns') from base", ("base",))
def nonzero_profile(spark, sf):
    live = {c: F.col(c) != 0 for c in _LIVE} | {"proto_tcp": F.col("proto") == "tcp",
                                               "service_dns": F.col("service") == "dns"}
    counts = B.base(spark, sf).agg(*[F.count(F.when(c, 1)).alias(n) for n, c in live.items()])
    return counts.unpivot([], list(live), "feature", "n_live")


_BIN = """least(cast(floor((x - lo) / (hi - lo) * {b}.0e0) as bigint), {b} - 1)"""


def _hist_sql(b: int) -> str:
    return f"""(select flow_id, -(sum(p * ln(p)) + ({b} - count(*)) * max(p0 * ln(p0))) as e from (
  select flow_id, (sum(c) / cast(n4 as double) / (width / {b}) + 1e-10) / (1 / (width / {b}) + {b} * 1e-10) as p,
    1e-10 / (1 / (width / {b}) + {b} * 1e-10) as p0 from (
    select *, case when j < {b} - 1 and x >= lo + (j + 1) * step then j + 1 else j end as k from (
      select *, case when x < lo + i * step then i - 1 else i end as j from (
        select *, hi - lo as width, (hi - lo) / {b}.0e0 as step, {_BIN.format(b=b)} as i from cells)))
  group by flow_id, k, n4, width) group by flow_id)"""


cte("grouped", "select concat_ws('-', src_ip, proto) as flow_id, src_ip_bytes, dst_ip_bytes, label, stime, "
    "row_id from req", "req")
cte("gsize", """select flow_id, n, label, greatest(n, 4) as n4,
  case when n < 4 then least(lo, 0) else lo end as lo0, case when n < 4 then greatest(hi, 0) else hi end as hi0
  from (select flow_id, count(*) as n, cast(min(src_ip_bytes) as double) as lo,
    cast(max(src_ip_bytes) as double) as hi, arg_min(label, (stime, row_id)) as label
    from grouped group by flow_id)""", "grouped")
cte("cells", """select v.flow_id, x, c, n4, case when lo0 = hi0 then lo0 - 0.5 else lo0 end as lo,
  case when lo0 = hi0 then hi0 + 0.5 else hi0 end as hi from (
    select flow_id, cast(src_ip_bytes as double) as x, count(*) as c from grouped group by 1, 2
    union all select flow_id, 0.0e0, 4 - n from gsize where n < 4) v
  join gsize g on v.flow_id = g.flow_id""", "grouped", "gsize")
cte("haar2", """with p as (select a.flow_id, row_number() over (partition by a.flow_id order by stime, row_id) - 1
    as pos, cast(src_ip_bytes as double) as v, n from grouped a join gsize g on a.flow_id = g.flow_id),
  l1 as (select flow_id, pos // 2 as pos, n, sum(v) * case when count(*) = 1 and n >= 4 then 2 else 1 end
    / sqrt(2.0e0) as v from p group by flow_id, pos // 2, n)
  select flow_id, pos // 2 as pos, sum(v) * case when count(*) = 1 and n >= 4 then 2 else 1 end
    / sqrt(2.0e0) as v from l1 group by flow_id, pos // 2, n""", "grouped", "gsize")
_NLOGN = "sum(c * ln(cast(c as double)))"
cte("gmi", f"""with j as (select flow_id, src_ip_bytes as a, dst_ip_bytes as b, count(*) as c from grouped group by 1, 2, 3),
  s as (select flow_id, {_NLOGN} as ij, sum(c) as n from j group by 1),
  x as (select flow_id, {_NLOGN} as i from (select flow_id, a, sum(c) as c from j group by 1, 2) group by 1),
  y as (select flow_id, {_NLOGN} as j from (select flow_id, b, sum(c) as c from j group by 1, 2) group by 1)
  select s.flow_id, greatest(0, (ij - i - y.j) / cast(n as double) + ln(cast(n as double))) as mi
  from s join x on s.flow_id = x.flow_id join y on s.flow_id = y.flow_id""", "grouped")


def _grouped(spark, sf):
    req = B.complete(spark, sf)
    return req.withColumn("flow_id", F.concat_ws("-", "src_ip", "proto"))


def _r(df, digits=4):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


@query("flow_group_features", f"""select g.flow_id, round(mi, 4) as "MI_dir_L5_weight",
  round(h8.e, 4) as "HH_L3_weight", round(h100.e, 4) as "HH_L0_01_weight", round(w.w, 2) as "HpHp_L0_01_weight",
  round(w.m, 4) as "HpHp_L0_01_mean", round(w.s, 4) as "HpHp_L0_01_std", round(sqrt(w.w), 4) as "HpHp_L0_01_magnitude",
  g.label from gsize g join gmi on g.flow_id = gmi.flow_id join {_hist_sql(8)} h8 on g.flow_id = h8.flow_id
  join {_hist_sql(100)} h100 on g.flow_id = h100.flow_id
  join (select flow_id, sum(v * v) as w, avg(v) as m, stddev_pop(v) as s from haar2 group by 1) w
    on g.flow_id = w.flow_id""", ("gsize", "gmi", "cells", "haar2"))
def flow_group_features(spark, sf):
    out = safe(G.flow_group_features(_grouped(spark, sf)))
    return _r(out).withColumn("HpHp_L0_01_weight", F.round("HpHp_L0_01_weight", 2))


@query("mi_discrete", "select flow_id, round(mi, 6) as mi from gmi", ("gmi",))
def mi_discrete(spark, sf):
    out = G.mutual_information(_grouped(spark, sf), "flow_id", "src_ip_bytes", "dst_ip_bytes")
    return out.select("flow_id", F.round("MI-dir-L5-weight", 6).alias("mi"))


@query("hist_entropy", f"select h8.flow_id, round(h8.e, 5) as e8, round(h100.e, 5) as e100 from {_hist_sql(8)} h8 "
       f"join {_hist_sql(100)} h100 on h8.flow_id = h100.flow_id", ("cells",))
def hist_entropy(spark, sf):
    out = safe(G.flow_group_features(_grouped(spark, sf)))
    return out.select("flow_id", F.round("HH_L3_weight", 5).alias("e8"),
                      F.round("HH_L0_01_weight", 5).alias("e100"))


@query("haar_group", "select flow_id, round(avg(v), 4) as m, round(stddev_pop(v), 4) as s, count(*) as n_coef "
       "from haar2 group by flow_id", ("haar2",))
def haar_group(spark, sf):
    from flowloom.operators.counters import running_count
    from flowloom.operators.prefix import spread, time_slices

    source = time_slices(_grouped(spark, sf))
    sizes = source.groupBy("flow_id").agg(F.count(F.lit(1)).alias("n"))
    placed = running_count(spread(source), ["flow_id"], "pos", source).join(sizes, "flow_id")
    signal = placed.select("flow_id", (F.col("pos") - 1).alias("pos"),
                           F.col("src_ip_bytes").cast("double").alias("v"), "n")
    coef = G.haar_level(G.haar_level(signal, "flow_id"), "flow_id")
    return _r(coef.groupBy("flow_id").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"),
                                          F.count(F.lit(1)).alias("n_coef")))


# --- joins -----------------------------------------------------------------------------------------
@query("dim_lookup", """select row_id, label, case label when 'normal' then 0 when 'backdoor' then 1
  when 'ddos' then 3 when 'scanning' then 6 end as class, proto_code from (select *,
  case proto when 'tcp' then 6 when 'udp' then 17 when 'Other' then 0 else -1 end as proto_code from base)""",
       ("base",))
def dim_lookup(spark, sf):
    """Fixed code tables as broadcast dimensions: ten and four rows."""
    def dim(codes, key, value):
        return F.broadcast(spark.createDataFrame(list(codes.items()), f"{key} string, {value} int"))

    base = B.base(spark, sf).select("row_id", "label", "proto")
    return (base.join(dim(S.CLASS_CODES, "label", "class"), "label", "left")
            .join(dim(S.PROTO_CODES, "proto", "proto_code"), "proto", "left")
            .select("row_id", "label", "class", "proto_code"))


cte("summary", "select dataset, model, metric, avg(value) as mean, coalesce(stddev_samp(value), 0) as std, "
    "count(value) as n from metrics_long group by dataset, model, metric", "metrics_long")


def _summary(spark, sf):
    return R.metric_summary(B.metrics_long(spark, sf), ("dataset", "model", "metric"))


_CROSS = "select model, metric, " + ", ".join(
    f"round(max(mean) filter (where dataset = '{d}'), 6) as \"{d}\"" for d in B.DATASETS) \
    + " from summary group by model, metric"


@query("cross_dataset_table", _CROSS, ("summary",))
def cross_dataset_table(spark, sf):
    return _r(R.cross_dataset(_summary(spark, sf), B.DATASETS), 6)


_PAIRS = [("D0", "D1"), ("D0", "D2"), ("D1", "D2")]
cte("pairs", " union all ".join(
    f"select '{a} vs {b}' as comparison, x.model, x.metric, x.iteration, x.value as x, y.value as y, "
    f"y.value - x.value as diff from metrics_long x join metrics_long y on x.model = y.model "
    f"and x.metric = y.metric and x.iteration = y.iteration and x.dataset = '{a}' and y.dataset = '{b}'"
    for a, b in _PAIRS), "metrics_long")


def _pairs(spark, sf):
    return T.pair(B.metrics_long(spark, sf), _PAIRS)


@query("paired_iterations", "select comparison, model, metric, iteration, x, y from pairs", ("pairs",))
def paired_iterations(spark, sf):
    return _pairs(spark, sf).select("comparison", "model", "metric", "iteration", "x", "y")


def _change(name: str, better: str, where: str = "") -> str:
    gain = "b.mean - a.mean" if better == "lower" else "a.mean - b.mean"
    return (f"select a.dataset, a.model, a.metric, round(case when a.dataset = '{B.BASELINE}' then 0 "
            f"else ({gain}) / b.mean * 100 end, 4) as pct from summary a join summary b "
            f"on a.model = b.model and a.metric = b.metric and b.dataset = '{B.BASELINE}' {where}")


def _pct(df):
    return df.select("dataset", "model", "metric", F.round("pct", 4).alias("pct"))


@query("baseline_join", "select a.dataset, a.model, a.metric, round(a.mean, 6) as mean, round(b.mean, 6) as base_mean "
       f"from summary a join summary b on a.model = b.model and a.metric = b.metric and b.dataset = '{B.BASELINE}'",
       ("summary",))
def baseline_join(spark, sf):
    rows = _summary(spark, sf)
    base = rows.where(F.col("dataset") == B.BASELINE).select(
        "model", "metric", F.round("mean", 6).alias("base_mean"))
    return rows.join(base, ["model", "metric"]).select(
        "dataset", "model", "metric", F.round("mean", 6).alias("mean"), "base_mean")


@query("pct_change", _change("pct", "higher"), ("summary",))
def pct_change(spark, sf):
    return _pct(R.against_baseline(_summary(spark, sf), B.BASELINE))


@query("improvement", _change("pct", "higher", "where a.metric = 'MCC'"), ("summary",))
def improvement(spark, sf):
    rows = _summary(spark, sf).where(F.col("metric") == "MCC")
    return _pct(R.against_baseline(rows, B.BASELINE))


@query("time_change", _change("pct", "lower", "where a.metric in ('train_time', 'predict_time')"), ("summary",))
def time_change(spark, sf):
    rows = _summary(spark, sf).where(F.col("metric").isin("train_time", "predict_time"))
    return _pct(R.against_baseline(rows, B.BASELINE, lower_is_better=True))


# --- metric tables -----------------------------------------------------------------------------------
_T975 = "case n when 1 then 0 " + " ".join(
    f"when {n} then {t_quantile(0.975, n - 1)!r}" for n in range(2, 41)) + " end"


@query("metric_summary", f"""select dataset, model, metric, round(mean, 6) as mean, round(std, 6) as std,
  round(mean - {_T975} * std / sqrt(n), 5) as ci95_low, round(mean + {_T975} * std / sqrt(n), 5) as ci95_high, n
  from summary""", ("summary",))
def metric_summary(spark, sf):
    out = R.metric_summary(B.metrics_long(spark, sf), ("dataset", "model", "metric"))
    return out.select("dataset", "model", "metric", F.round("mean", 6).alias("mean"),
                      F.round("std", 6).alias("std"), F.round("ci95_low", 5).alias("ci95_low"),
                      F.round("ci95_high", 5).alias("ci95_high"), "n")


@query("per_dataset_table", f"""select dataset, model, metric, round(mean, 6) as mean, round(std, 6) as std,
  round(mean - {_T975} * std / sqrt(n), 5) as ci95_low, round(mean + {_T975} * std / sqrt(n), 5) as ci95_high, n
  from summary""", ("summary",))
def per_dataset_table(spark, sf):
    return _summary(spark, sf).select(
        "dataset", "model", "metric", F.round("mean", 6).alias("mean"),
        F.round("std", 6).alias("std"), F.round("ci95_low", 5).alias("ci95_low"),
        F.round("ci95_high", 5).alias("ci95_high"), "n")


_SUP = ", ".join(f"'{m}'" for m in S.SUPERVISED_MODELS)
_CNT = ", ".join(f"'{m}'" for m in S.COUNT_METRICS)


@query("metric_sem_table", f"""select dataset, model, metric,
  round(case when metric in ({_CNT}) then trunc(round(mean, 9)) else mean end, 6) as mean,
  round(case when metric in ({_CNT}) then trunc(round(std / sqrt(n), 9)) when model in ({_SUP}) then std
    else std / sqrt(n) end, 6) as error, n from summary""", ("summary",))
def metric_sem_table(spark, sf):
    return _r(R.metric_sem(B.metrics_long(spark, sf)), 6)


@query("clip_error", "select dataset, model, metric, round(least(std / sqrt(n), 1 - mean), 6) as error "
       "from summary", ("summary",))
def clip_error(spark, sf):
    rows = _summary(spark, sf)
    err = R.clip_error(F.col("mean"), F.col("std") / F.sqrt("n"))
    return rows.select("dataset", "model", "metric", F.round(err, 6).alias("error"))


@query("fold_means", "select dataset, model, metric, round(avg(value), 6) as mean from metrics_long "
       "group by dataset, model, metric", ("metrics_long",))
def fold_means(spark, sf):
    rows = B.metrics_long(spark, sf)
    return rows.groupBy("dataset", "model", "metric").agg(F.round(F.avg("value"), 6).alias("mean"))


_Q = ["low", "q1", "median", "q3", "high"]


@query("box_stats", "select dataset, model, metric, " + ", ".join(
    f"round(quantile_cont(value, {i / 4}), 6) as {n}" for i, n in enumerate(_Q))
    + " from metrics_long group by dataset, model, metric", ("metrics_long",))
def box_stats(spark, sf):
    return _r(R.box_stats(B.metrics_long(spark, sf)), 6)


@query("long_table_profile", "select count(*) as n_rows, count(distinct metric) as n_metrics, "
       "count(distinct model) as n_models, count(distinct dataset) as n_datasets from metrics_long",
       ("metrics_long",))
def long_table_profile(spark, sf):
    return R.profile(B.metrics_long(spark, sf))


_WIDE = [(m, model) for model in S.MODELS for m in S.METRICS]


def _wide_name(metric: str, model: str) -> str:
    return f"{metric}_{model}".replace(" ", "_").replace("-", "_")


@query("wide_from_metrics", "select dataset, iteration, " + ", ".join(
    f"max(value) filter (where metric = '{m}' and model = '{k}') as \"{_wide_name(m, k)}\"" for m, k in _WIDE)
    + " from metrics_long group by dataset, iteration", ("metrics_long",))
def wide_from_metrics(spark, sf):
    out = R.wide(B.metrics_long(spark, sf))
    return out.toDF(*[c.replace(" ", "_").replace("-", "_") for c in out.columns])


@query("results_long", "select dataset, iteration, model, metric, value from metrics_long", ("metrics_long",))
def results_long(spark, sf):
    """Wide files of each dataset, stacked back into the long table."""
    wide = R.wide(B.metrics_long(spark, sf))
    frames = {d: wide.where(F.col("dataset") == d).drop("dataset") for d in B.DATASETS}
    return R.stack_results({**frames, "absent": None}).select(
        "dataset", "iteration", "model", "metric", "value")


@query("split_metric_key", "select distinct concat(metric, '_', model) as key, metric, model from metric_rows "
       "union all select distinct concat('eval_', l_returnflag), 'eval', l_returnflag from lineitem",
       ("metric_rows",))
def split_metric_key(spark, sf):
    known = B.metrics_long(spark, sf).select(F.concat_ws("_", "metric", "model").alias("key"))
    other = B.table(spark, sf, "lineitem").select(
        F.concat(F.lit("eval_"), "l_returnflag").alias("key"))
    metric, model = R.split_key(F.col("key"))
    return known.unionByName(other).distinct().select("key", metric.alias("metric"),
                                                      model.alias("model"))


@query("stability", "select dataset, model, round(std, 6) as mcc_std from summary where metric = 'MCC'",
       ("summary",))
def stability(spark, sf):
    rows = _summary(spark, sf).where(F.col("metric") == "MCC")
    return rows.select("dataset", "model", F.round("std", 6).alias("mcc_std"))


@query("melt_compare", "select comparison, model, metric, iteration, 'x' as origin, x as value from pairs "
       "union all select comparison, model, metric, iteration, 'y', y from pairs", ("pairs",))
def melt_compare(spark, sf):
    rows = T.pair(B.metrics_long(spark, sf), _PAIRS)
    return rows.unpivot(["comparison", "model", "metric", "iteration"], ["x", "y"], "origin", "value")


@query("metric_by_model", "select model, " + ", ".join(
    f"round(max(mean) filter (where dataset = '{d}'), 6) as \"mean_{d}\", "
    f"round(max(std) filter (where dataset = '{d}'), 6) as \"std_{d}\"" for d in ("D0", "D1"))
    + " from summary where metric = 'f1_score' group by model", ("summary",))
def metric_by_model(spark, sf):
    rows = _summary(spark, sf).where(F.col("metric") == "f1_score")
    out = rows.groupBy("model").pivot("dataset", ["D0", "D1"]).agg(
        F.first("mean").alias("mean"), F.first("std").alias("std"))
    return out.select("model", *[F.round(f"{d}_{s}", 6).alias(f"{s}_{d}")
                                 for d in ("D0", "D1") for s in ("mean", "std")])


@query("time_table", "select dataset, model, metric, round(mean, 6) as mean from summary "
       "where metric in ('train_time', 'predict_time')", ("summary",))
def time_table(spark, sf):
    rows = _summary(spark, sf).where(F.col("metric").isin("train_time", "predict_time"))
    return rows.select("dataset", "model", "metric", F.round("mean", 6).alias("mean"))


# --- classification metrics ----------------------------------------------------------------------------
cte("conf", """select count(*) filter (where truth = 1 and guess = 1) as tp,
  count(*) filter (where truth = 0 and guess = 0) as tn, count(*) filter (where truth = 0 and guess = 1) as fp,
  count(*) filter (where truth = 1 and guess = 0) as fn from predicted""", "predicted")
cte("confd", "select cast(tp as double) as tp, cast(tn as double) as tn, cast(fp as double) as fp, "
    "cast(fn as double) as fn from conf", "conf")
_MCC = "(tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))"


@query("confusion", 'select tp as "TP", tn as "TN", fp as "FP", fn as "FN" from conf', ("conf",))
def confusion(spark, sf):
    return M.confusion(B.predicted(spark, sf))


@query("accuracy", "select round((tp + tn) / (tp + tn + fp + fn), 6) as accuracy from confd", ("confd",))
def accuracy(spark, sf):
    return M.scores(B.predicted(spark, sf)).select(F.round("accuracy", 6).alias("accuracy"))


@query("scores_binary", "select round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, "
       "round(2 * tp / (2 * tp + fp + fn), 6) as f1_score from confd", ("confd",))
def scores_binary(spark, sf):
    out = M.scores(B.predicted(spark, sf), average="binary")
    return _r(out.select("precision", "recall", "f1_score"), 6)


@query("scores_macro", "select round((tp / (tp + fp) + tn / (tn + fn)) / 2, 6) as precision, "
       "round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) as recall, "
       "round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) as f1_score from confd",
       ("confd",))
def scores_macro(spark, sf):
    return _r(M.scores(B.predicted(spark, sf)).select("precision", "recall", "f1_score"), 6)


cte("classes3", """select class, sum(support) as support, sum(predicted) as predicted, sum(tp) as tp from (
  select truth3 as class, 1 as support, 0 as predicted, case when truth3 = guess3 then 1 else 0 end as tp from predicted
  union all select guess3, 0, 1, 0 from predicted) group by class""", "predicted")


@query("mcc", f"""select round({_MCC}, 6) as mcc, (select round((sum(tp) * sum(support)
    - sum(cast(support as double) * predicted)) / sqrt((power(sum(support), 2) - sum(power(predicted, 2)))
    * (power(sum(support), 2) - sum(power(support, 2)))), 6) from classes3) as mcc3 from confd""",
       ("confd", "classes3"))
def mcc(spark, sf):
    rows = B.predicted(spark, sf)
    two = M.scores(rows).select(F.round("MCC", 6).alias("mcc"), F.lit(1).alias("k"))
    three = M.scores(rows, [], "truth3", "guess3").select(F.round("MCC", 6).alias("mcc3"),
                                                         F.lit(1).alias("k"))
    return two.join(three, "k").drop("k")  # one row each


_AUC = """select (sum(rk) filter (where hit = 1) - cast(count(*) filter (where hit = 1) as double)
    * (count(*) filter (where hit = 1) + 1) / 2) / (cast(count(*) filter (where hit = 1) as double)
    * count(*) filter (where hit = 0)) as auc from (select hit, rank() over (order by s)
    + (count(*) over (partition by s) - 1) / 2.0e0 as rk from ({rows}))"""


@query("rank_auc", "select round(auc, 6) as auc from ("
       + _AUC.format(rows="select truth as hit, score as s from predicted") + ")", ("predicted",))
def rank_auc(spark, sf):
    return M.auc(B.predicted(spark, sf)).select(F.round("auc", 6).alias("auc"))


@query("auc_score", " union all ".join(
    f"select {k} as class, round(auc, 6) as auc from ("
    + _AUC.format(rows=f"select truth as hit, score as s from predicted where truth3 = {k}") + ")"
    for k in range(3)), ("predicted",))
def auc_score(spark, sf):
    out = M.auc(B.predicted(spark, sf), ["truth3"])
    return out.select(F.col("truth3").alias("class"), F.round("auc", 6).alias("auc"))


@query("auc_label", "select round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) as auc from confd", ("confd",))
def auc_label(spark, sf):
    return M.auc_label(B.predicted(spark, sf)).select(F.round("auc", 6).alias("auc"))


_OVR = {0: "score", 1: "s1", 2: "s2"}


@query("auc_ovr_macro", "select round(avg(auc), 6) as auc from (" + " union all ".join(
    _AUC.format(rows=f"select case when truth3 = {k} then 1 else 0 end as hit, {s} as s from predicted")
    for k, s in _OVR.items()) + ")", ("predicted",))
def auc_ovr_macro(spark, sf):
    return _r(M.auc_ovr_macro(B.predicted(spark, sf), _OVR, "truth3"), 6)


@query("classification_report", """select class, round(coalesce(tp / nullif(cast(predicted as double), 0), 0), 6) as precision,
  round(coalesce(tp / nullif(cast(support as double), 0), 0), 6) as recall,
  round(2.0e0 * tp / (predicted + support), 6) as f1_score, support from classes3""", ("classes3",))
def classification_report(spark, sf):
    out = M.per_class(B.predicted(spark, sf), [], "truth3", "guess3")
    return _r(out.select("class", "precision", "recall", "f1_score", "support"), 6)


@query("composite_score", "select round((tp / (tp + fp) + tp / (tp + fn) + 2 * tp / (2 * tp + fp + fn)) / 3, 6) as score, "
       "round((tp / (tp + fp) + tp / (tp + fn) + 2 * tp / (2 * tp + fp + fn)) * 0.33, 6) as score_old from confd",
       ("confd",))
def composite_score(spark, sf):
    s = M.scores(B.predicted(spark, sf), average="binary")
    p = [F.col(c) for c in ("precision", "recall", "f1_score")]
    return s.select(F.round(M.composite(*p), 6).alias("score"),
                    F.round(M.composite(*p, 0.33), 6).alias("score_old"))


@query("trial_table", """select trial, model, round(value, 6) as value, row_number() over (partition by model
  order by value desc, trial) = 1 as best from (select iteration as trial, model, avg(value) as value from metrics_long
  where metric = 'f1_score' group by iteration, model)""", ("metrics_long",))
def trial_table(spark, sf):
    from flowloom.plans.tuning import mark_best

    rows = B.metrics_long(spark, sf).where(F.col("metric") == "f1_score")
    trials = rows.groupBy(F.col("iteration").alias("trial"), "model").agg(
        F.avg("value").alias("value"))
    return _r(mark_best(trials), 6)


@query("best_trial", """select model, trial, round(value, 6) as value from (select *, row_number() over (partition by model
  order by value desc, trial) as place from (select iteration as trial, model, avg(value) as value from metrics_long
  where metric = 'f1_score' group by iteration, model)) where place = 1""", ("metrics_long",))
def best_trial(spark, sf):
    from flowloom.plans.tuning import best_trials

    rows = B.metrics_long(spark, sf).where(F.col("metric") == "f1_score")
    trials = rows.groupBy(F.col("iteration").alias("trial"), "model").agg(
        F.avg("value").alias("value"))
    return _r(best_trials(trials), 6)


# --- significance ----------------------------------------------------------------------------------------
_GROUP = "comparison, model, metric"
cte("signed", f"""select {_GROUP}, sum(case when diff > 0 then r else 0 end) as w_plus,
  sum(case when diff < 0 then r else 0 end) as w_minus, count(*) as n from (select *,
    rank() over (partition by {_GROUP} order by abs(diff)) + (count(*) over (partition by {_GROUP}, abs(diff)) - 1) / 2.0e0 as r
    from pairs where diff <> 0) group by {_GROUP}""", "pairs")
cte("friedman_t", """with b as (select *, count(*) over (partition by model, metric, iteration) as k from metrics_long),
  r as (select *, rank() over (partition by model, metric, iteration order by value)
    + (count(*) over (partition by model, metric, iteration, value) - 1) / 2.0e0 as r,
    power(count(*) over (partition by model, metric, iteration, value), 2) - 1 as tie from b where k = 3),
  s as (select model, metric, dataset, sum(r) as s, count(*) as n, sum(tie) as tie from r group by 1, 2, 3)
  select model, metric, max(n) as n, (12.0e0 / (max(n) * 3 * 4) * sum(s * s) - 3 * max(n) * 4)
    / (1 - sum(tie) / (max(n) * 3.0e0 * 8)) as chi2 from s group by model, metric""", "metrics_long")
cte("paired_test", f"select {_GROUP}, count(*) as n, -avg(diff) / (stddev_samp(diff) / sqrt(count(*))) as t "
    f"from pairs group by {_GROUP}", "pairs")


# upper tail of the normal distribution; fixed values: coefficients of the published double-precision form (Hart 1968)
_TAIL_TOP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
             221.213596169931, 220.206867912376)
_TAIL_BOTTOM = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
                637.333633378831, 793.826512519948, 440.413735824752)


def _horner(coefficients, x: str) -> str:
    out = f"{coefficients[0]!r}e0"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}e0)"
    return out


def _sf_sql(x: str) -> str:
    far = f"abs({x}) + 0.65e0"
    for k in (4, 3, 2, 1):
        far = f"abs({x}) + {k} / ({far})"
    up = (f"exp(-{x} * {x} / 2) * case when abs({x}) < 7.07106781186547e0 then {_horner(_TAIL_TOP, f'abs({x})')} / "
          f"{_horner(_TAIL_BOTTOM, f'abs({x})')} else 1 / ({far}) / 2.506628274631e0 end")
    return f"case when {x} < 0 then 1 - {up} else {up} end"


def _t_sql(most: int) -> str:
    """Two-sided tail of t by the finite series for each number of degrees of freedom."""
    cases = []
    for df in range(1, most + 1):
        term, terms = 1.0, []
        for k in range(1, (df + 1) // 2 if df % 2 else df // 2 + 1):
            power = 2 * k - 1 if df % 2 else 2 * k - 2
            terms.append(f"{term!r}e0 * power(cos(th), {power})")
            term *= 2 * k / (2 * k + 1) if df % 2 else (2 * k - 1) / (2 * k)
        series = " + ".join(terms) or "0.0e0"
        inside = f"2 / pi() * (th + sin(th) * ({series}))" if df % 2 else f"sin(th) * ({series})"
        cases.append(f"when {df} then 1 - ({inside})")
    return f"case n - 1 {' '.join(cases)} end"


def _shapiro_weights(most: int) -> str:
    """Weights of ordered values of the W test for every sample size, by the published rule."""
    from statistics import NormalDist

    rows = []
    for n in range(3, most + 1):
        m = [NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
        s, u = sum(x * x for x in m), 1 / math.sqrt(n)
        ends = [math.sqrt(0.5)] if n == 3 else [sum(c * u ** k for k, c in enumerate(tails._A_LAST)) + m[-1] / math.sqrt(s)]
        if n > 5:
            ends.append(sum(c * u ** k for k, c in enumerate(tails._A_NEXT)) + m[-2] / math.sqrt(s))
        k = len(ends)
        phi = (s - 2 * sum(x * x for x in m[-k:])) / (1 - 2 * sum(e * e for e in ends)) if n > 3 else 1.0
        a = [x / math.sqrt(phi) for x in m]
        for i, e in enumerate(ends):
            a[i], a[n - 1 - i] = -e, e
        rows += [f"({n}, {i + 1}, {x!r}e0)" for i, x in enumerate(a)]
    return ", ".join(rows)


def _at(coefficients, x: str) -> str:
    return " + ".join(f"{c!r}e0 * power({x}, {k})" for k, c in enumerate(coefficients))


cte("ways", f"""with recursive w(n, s, c) as (select 0, 0, 1.0e0 union all
  select n + 1, s + u * (n + 1), sum(c) from w cross join (values (0), (1)) t(u) where n < {B.ITERATIONS}
  group by n, s + u * (n + 1)) select * from w""")
cte("signed_t", f"""select {_GROUP}, sum(t * t - 1) as ties from (select *,
  count(*) over (partition by {_GROUP}, abs(diff)) as t from pairs where diff <> 0) group by {_GROUP}""", "pairs")
cte("wilcoxon_all", f"""with g as (select distinct {_GROUP} from pairs),
  s as (select {_GROUP}, coalesce(w_plus, 0) as w_plus, coalesce(w_minus, 0) as w_minus, coalesce(n, 0) as n,
    coalesce(ties, 0) as ties from g left join signed using ({_GROUP}) left join signed_t using ({_GROUP})),
  z as (select *, abs(w_plus - n * (n + 1) / 4.0e0) / sqrt((n * (n + 1.0e0) * (2 * n + 1) - ties / 2.0e0) / 24) as z from s),
  e as (select {_GROUP}, 2 * sum(c) / power(2, any_value(s.n)) as p from s join ways on ways.n = s.n
    and ways.s <= least(w_plus, w_minus) where ties = 0 group by {_GROUP})
  select z.*, round(case when n = 0 then 1 when ties = 0 then least(1, e.p) else 2 * ({_sf_sql('z')}) end, 8) as wilcoxon_p
  from z left join e using ({_GROUP})""", "pairs", "signed", "signed_t", "ways")
cte("shapiro_all", f"""with w(n, i, a) as (values {_shapiro_weights(B.ITERATIONS)}),
  r as (select *, row_number() over (partition by {_GROUP} order by diff) as i, count(*) over (partition by {_GROUP}) as n,
    diff - avg(diff) over (partition by {_GROUP}) as d from pairs),
  v as (select {_GROUP}, any_value(r.n) as n, min(diff) as lo, max(diff) as hi,
    least(1, power(sum(a * diff), 2) / nullif(sum(d * d), 0)) as w from r left join w on w.n = r.n and w.i = r.i group by {_GROUP}),
  y as (select *, ln(1 - w) as y, ({_at(tails._SMALL_GAMMA, 'n')}) as gamma from v where n > 3 and w < 1 and lo < hi),
  z as (select *, case when n <= 11 then (-ln(gamma - y) - ({_at(tails._SMALL_MEAN, 'n')})) / exp({_at(tails._SMALL_SD, 'n')})
    else (y - ({_at(tails._LARGE_MEAN, 'ln(n)')})) / exp({_at(tails._LARGE_SD, 'ln(n)')}) end as z
    from y where n > 11 or y < gamma)
  select v.*, case when v.lo = v.hi then 1 when v.n < 3 then null
    when v.n = 3 then greatest(0, 6 / pi() * (asin(sqrt(v.w)) - asin(sqrt(0.75e0)))) when v.w >= 1 then 1
    when z.z is null then 0 else {_sf_sql('z.z')} end as shapiro_p
  from v left join z using ({_GROUP})""", "pairs")
cte("t_all", f"""select *, {_t_sql(B.ITERATIONS - 1)} as t_p from (select *, atan(abs(t) / sqrt(n - 1.0e0)) as th from paired_test)""",
    "paired_test")


@query("wilcoxon_w", f"select {_GROUP}, w_plus, w_minus, n from signed", ("signed",))
def wilcoxon_w(spark, sf):
    return T.signed_ranks(_pairs(spark, sf)).drop("ties")


@query("wilcoxon", f"select {_GROUP}, w_plus, w_minus, n, ties, wilcoxon_p from wilcoxon_all", ("wilcoxon_all",))
def wilcoxon(spark, sf):
    return T.wilcoxon(_pairs(spark, sf)).withColumn("wilcoxon_p", F.round("wilcoxon_p", 8))


@query("shapiro", f"select {_GROUP}, round(shapiro_p, 6) as shapiro_p from shapiro_all", ("shapiro_all",))
def shapiro(spark, sf):
    return T.shapiro(_pairs(spark, sf)).withColumn("shapiro_p", F.round("shapiro_p", 6))


@query("friedman", "select model, metric, n, round(chi2, 6) as chi2, round(exp(-chi2 / 2), 8) as friedman_p "
       "from friedman_t", ("friedman_t",))
def friedman(spark, sf):
    out = T.friedman(B.metrics_long(spark, sf), B.DATASETS)
    return out.withColumns({"chi2": F.round("chi2", 6), "friedman_p": F.round("friedman_p", 8)})


@query("paired_t", f"select {_GROUP}, n, round(t, 6) as t from paired_test", ("paired_test",))
def paired_t(spark, sf):
    return T.paired_t(_pairs(spark, sf)).select(*T.GROUP, "n", F.round("t", 6).alias("t"))


@query("adaptive_test", f"""select {_GROUP}, case when shapiro_p >= 0.05 and t_p is not null then 'paired t'
    when shapiro_p >= 0.05 then 'signed rank (fallback)' else 'signed rank' end as test,
  round(case when shapiro_p >= 0.05 and t_p is not null then t_p else wilcoxon_p end, 5) as p_value
  from shapiro_all join wilcoxon_all using ({_GROUP}) join t_all using ({_GROUP})""",
       ("shapiro_all", "wilcoxon_all", "t_all"))
def adaptive_test(spark, sf):
    return T.adaptive(_pairs(spark, sf))


@query("normality_table", f"""select {_GROUP}, round(shapiro_p, 5) as shapiro_p,
  case when shapiro_p >= 0.05 then 'yes' else 'no' end as normal from shapiro_all""", ("shapiro_all",))
def normality_table(spark, sf):
    return T.normality(_pairs(spark, sf))


_TESTED = ", ".join(f"'{m}'" for m in S.TESTED_METRICS)


@query("stats_table", f"""select p.comparison, p.model, p.metric, round(avg(y) - avg(x), 6) as mean_diff,
  round(max(exp(-chi2 / 2)), 8) as friedman_p from pairs p join friedman_t f on p.model = f.model
  and p.metric = f.metric where p.metric in ({_TESTED}) group by p.comparison, p.model, p.metric""",
       ("pairs", "friedman_t"))
def stats_table(spark, sf):
    out = T.stats_table(B.metrics_long(spark, sf), _PAIRS, B.DATASETS, S.TESTED_METRICS)
    return out.select(*T.GROUP, F.round("mean_diff", 6).alias("mean_diff"),
                      F.round("friedman_p", 8).alias("friedman_p"))


@query("stats_table_full", f"""with m as (select {_GROUP}, avg(y) - avg(x) as mean_diff from pairs group by {_GROUP})
  select {_GROUP}, round(mean_diff, 6) as mean_diff, round(shapiro_p, 6) as shapiro_p, wilcoxon_p,
    round(exp(-chi2 / 2), 8) as friedman_p, wilcoxon_p < 0.05 as significant
  from m join shapiro_all using ({_GROUP}) join wilcoxon_all using ({_GROUP}) left join friedman_t using (model, metric)
  where metric in ({_TESTED})""", ("pairs", "shapiro_all", "wilcoxon_all", "friedman_t"))
def stats_table_full(spark, sf):
    out = T.stats_table(B.metrics_long(spark, sf), _PAIRS, B.DATASETS, S.TESTED_METRICS)
    return out.withColumns({c: F.round(c, d) for c, d in (("mean_diff", 6), ("shapiro_p", 6), ("wilcoxon_p", 8),
                                                          ("friedman_p", 8))})


# a closed p-value both engines can state: two-sided normal tails are not SQL, exp(-chi2 / 2) is
cte("chi_p", "select model, metric, round(exp(-chi2 / 2), 8) as p_value from friedman_t", "friedman_t")


@query("sig_summary", "select count(*) filter (where p_value < 0.05) as n_significant, count(*) as n_tests, "
       "max(p_value) as max_p from chi_p", ("chi_p",))
def sig_summary(spark, sf):
    p = T.friedman(B.metrics_long(spark, sf), B.DATASETS).select(
        F.round("friedman_p", 8).alias("wilcoxon_p"))
    return T.sig_summary(p.withColumn("significant", F.col("wilcoxon_p") < 0.05))


_HOLM = """select model, metric, p_value, max(fail) over (order by p_value, model, metric
  rows between unbounded preceding and current row) = 0 as significant from (select *,
  case when p_value < 0.05 / (count(*) over () - row_number() over (order by p_value, model, metric) + 1)
  then 0 else 1 end as fail from chi_p)"""


def _holm(spark, sf):
    p = T.friedman(B.metrics_long(spark, sf), B.DATASETS).select(
        "model", "metric", F.round("friedman_p", 8).alias("p_value"))
    return T.holm(p, tie=["model", "metric"])


@query("holm", _HOLM, ("chi_p",))
def holm(spark, sf):
    return _holm(spark, sf)


@query("holm_flags", f"select significant, count(*) as n from ({_HOLM}) group by significant", ("chi_p",))
def holm_flags(spark, sf):
    return _holm(spark, sf).groupBy("significant").agg(F.count(F.lit(1)).alias("n"))


@query("sort_pvalues", "select model, metric, p_value, row_number() over (order by p_value, model, metric) as place "
       "from chi_p order by place", ("chi_p",))
def sort_pvalues(spark, sf):
    from pyspark.sql import Window

    p = T.friedman(B.metrics_long(spark, sf), B.DATASETS).select(
        "model", "metric", F.round("friedman_p", 8).alias("p_value"))
    return p.withColumn("place", F.row_number().over(
        Window.orderBy("p_value", "model", "metric"))).orderBy("place")


@query("round5", "select model, metric, round(p_value, 5) as p5 from chi_p", ("chi_p",))
def round5(spark, sf):
    p = T.friedman(B.metrics_long(spark, sf), B.DATASETS)
    return p.select("model", "metric", F.round(F.round("friedman_p", 8), 5).alias("p5"))
