"""Row statistics, encoders and feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom import schemas as S
from flowloom.catalog import bridge as B
from flowloom.catalog.q_enrich import WAVELET_SQL
from flowloom.catalog.registry import cte, query
from flowloom.functions import signal as G
from flowloom.operators import encode as E
from flowloom.operators import select as X
from flowloom.operators import splits as L
from flowloom.session import materialize

_SIG = ["src_ip_bytes", "dst_ip_bytes", "src_pkts", "dst_pkts"]


def _v():
    return G.signal(*[F.col(c) for c in _SIG])


@query("signal_stats", f"select row_id, sum, max, round(mean, 6) as mean, min, round(stddev, 4) as stddev "
       f"from (select row_id, {B.SIGNAL_SQL} from base)", ("base",))
def signal_stats(spark, sf):
    out = B.base(spark, sf).select("row_id", *[e.alias(n) for n, e in G.stats(_v()).items()])
    return out.withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 4)})


def _row_query(name, spark_expr, sql, digits=6):
    @query(name, f"select row_id, round({sql}, {digits}) as {name} from base", ("base",))
    def run(spark, sf):
        return B.base(spark, sf).select("row_id", F.round(spark_expr(), digits).alias(name))


_row_query("mi_row", lambda: G.value_information(_v()), WAVELET_SQL["MI_dir_L5_weight"])
_row_query("entropy_row", lambda: G.entropy(_v()), WAVELET_SQL["HH_L3_weight"])
_row_query("power_sum", lambda: G.power_sum(_v()), WAVELET_SQL["HH_L0_01_weight"])
_row_query("energy", lambda: G.energy(_v()), WAVELET_SQL["HpHp_L0_01_weight"])
_row_query("haar_row", lambda: G.haar(_v())["mean"], WAVELET_SQL["HpHp_L0_01_mean"])


@query("pad4", """select row_id, cast(src_ip_bytes as double) as v1, cast(src_pkts as double) as v2,
  0.0e0 as v3, 0.0e0 as v4 from base""", ("base",))
def pad4(spark, sf):
    padded = G.items(G.pad4(F.array("src_ip_bytes", "src_pkts")))
    return B.base(spark, sf).select("row_id", *[p.alias(f"v{i + 1}") for i, p in enumerate(padded)])


@query("unordered_pair", "select row_id, least(src_ip, dst_ip) as lo, greatest(src_ip, dst_ip) as hi "
       "from base", ("base",))
def unordered_pair(spark, sf):
    return B.base(spark, sf).select("row_id", F.least("src_ip", "dst_ip").alias("lo"),
                                    F.greatest("src_ip", "dst_ip").alias("hi"))


@query("text_functions", """select row_id, lower(application_name) as app,
  coalesce(lower(application_name) like '%http%', false) as is_http, label in ('ddos', 'normal') as chosen,
  concat_ws('-', src_ip, cast(dst_port as varchar)) as joined, split_part(src_ip, '.', 4) as last_octet
  from raw""", ("raw",))
def text_functions(spark, sf):
    c = F.col
    return B.raw_flows(spark, sf).select(
        "row_id", F.lower("application_name").alias("app"),
        F.coalesce(F.lower("application_name").contains("http"), F.lit(False)).alias("is_http"),
        c("label").isin("ddos", "normal").alias("chosen"),
        F.concat_ws("-", "src_ip", c("dst_port").cast("string")).alias("joined"),
        F.split_part("src_ip", F.lit("."), F.lit(4)).alias("last_octet"))


@query("math_functions", """select row_id, round(exp(-dur), 6) as e, round(ln(1 + src_pkts), 6) as l,
  round(sqrt(dst_ip_bytes), 6) as s, abs(src_pkts - dst_pkts) as a, floor(dur * 3) as f,
  round(power(src_pkts, 0.5e0), 6) as p, greatest(src_pkts, dst_pkts) as hi, least(src_pkts, dst_pkts) as lo
  from base""", ("base",))
def math_functions(spark, sf):
    c = F.col
    return B.base(spark, sf).select(
        "row_id", F.round(F.exp(-c("dur")), 6).alias("e"),
        F.round(F.log(1 + c("src_pkts")), 6).alias("l"),
        F.round(F.sqrt("dst_ip_bytes"), 6).alias("s"),
        F.abs(c("src_pkts") - c("dst_pkts")).alias("a"), F.floor(c("dur") * 3).alias("f"),
        F.round(F.pow("src_pkts", F.lit(0.5)), 6).alias("p"),
        F.greatest("src_pkts", "dst_pkts").alias("hi"), F.least("src_pkts", "dst_pkts").alias("lo"))


# --- encoders -----------------------------------------------------------------------------------
_NUM = ["src_ip_bytes", "dst_ip_bytes", "src_pkts", "dst_pkts", "http_status_code", "dst_port",
        "stime", "dur"]
cte("first_fit", "select " + ", ".join(f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in _NUM)
    + " from req where source_file = (select min(source_file) from req)", "req")
_SCALED = ", ".join(
    f"round((cast({c} as double) - lo_{c}) / case when hi_{c} = lo_{c} then 1 else hi_{c} - lo_{c} end, 6) as {c}"
    for c in _NUM)


@query("minmax", f"select row_id, {_SCALED} from req, first_fit", ("req", "first_fit"))
def minmax(spark, sf):
    rows = B.complete(spark, sf)
    out = E.fit_minmax(E.first_file(rows), _NUM).transform(rows)
    return out.select("row_id", *[F.round(c, 6).alias(c) for c in _NUM])


def _safe(name: str) -> str:
    return name.replace("-", "dash")


_KNOWN = [(c, v) for c in S.CATEGORICAL for v in sorted(S.KNOWN_VOCAB[c])]
_KNOWN_SQL = ", ".join(f"case when {c} = '{v}' then 1.0e0 else 0.0e0 end as \"{_safe(f'{c}_{v}')}\""
                       for c, v in _KNOWN)


def _dashes(df):
    return df.toDF(*[_safe(c) for c in df.columns])


@query("one_hot_known", f"select row_id, {_KNOWN_SQL} from base", ("base",))
def one_hot_known(spark, sf):
    return _dashes(E.one_hot(B.base(spark, sf).select("row_id", *S.CATEGORICAL), S.KNOWN_VOCAB))


# the learned vocabulary of the first file, as one row per (row, set column)
@query("one_hot_fit", """select row_id, concat('label_', label) as column_name from base
  where label in (select label from base where source_file = (select min(source_file) from base))
union all select row_id, concat('service_', service) from base
  where service in (select service from base where source_file = (select min(source_file) from base))""",
       ("base",))
def one_hot_fit(spark, sf):
    rows = B.base(spark, sf).select("row_id", "source_file", "label", "service")
    vocab = E.fit_vocab(E.first_file(rows), ["label", "service"])
    hot = E.one_hot(rows.drop("source_file"), vocab)
    names = [c for c in hot.columns if c != "row_id"]
    long = hot.unpivot(["row_id"], names, "column_name", "flag")
    return long.where("flag = 1").select("row_id", "column_name")


@query("concat_side_by_side", f"select row_id, src_pkts, dst_pkts, {_KNOWN_SQL} from req", ("req",))
def concat_side_by_side(spark, sf):
    rows = B.complete(spark, sf)
    return _dashes(E.one_hot(rows.select("row_id", "src_pkts", "dst_pkts", *S.CATEGORICAL),
                             S.KNOWN_VOCAB))


@query("encode", f"select row_id, source_file, label, {_SCALED}, {_KNOWN_SQL} from req, first_fit",
       ("req", "first_fit"))
def encode(spark, sf):
    rows = B.base(spark, sf).select("row_id", "source_file", "label", *_NUM, *S.CATEGORICAL)
    out = E.encode(rows, S.CATEGORICAL, _NUM, S.KNOWN_VOCAB)
    return _dashes(out.withColumns({c: F.round(c, 6) for c in _NUM}))


_STD = ", ".join(f"round((cast({c} as double) - (select avg({c}) from req)) / (select stddev_pop({c}) from req), 5) as {c}"
                 for c in _SIG)


@query("standard_scale", f"select row_id, {_STD} from req", ("req",))
def standard_scale(spark, sf):
    rows = B.complete(spark, sf)
    out = E.fit_standard(rows, _SIG).transform(rows)
    return out.select("row_id", *[F.round(c, 5).alias(c) for c in _SIG])


# --- selection --------------------------------------------------------------------------------------
_F = B.MODEL_FEATURES


def _mi_sql(source: str) -> str:
    return f"""with l as (select * from (select category, {', '.join(_F)} from {source})
    unpivot (value for feature in ({', '.join(_F)}))),
  r as (select feature, category, floor(10 * (rank() over (partition by feature order by value) - 1)
    / cast(count(*) over (partition by feature) as double)) as bin from l),
  j as (select feature, bin, category, count(*) as n_ij from r group by 1, 2, 3),
  m as (select *, sum(n_ij) over (partition by feature) as n, sum(n_ij) over (partition by feature, bin) as n_i,
    sum(n_ij) over (partition by feature, category) as n_j from j)
  select feature, sum(n_ij / cast(n as double) * ln(cast(n as double) * n_ij / (n_i * n_j))) as mi
  from m group by feature"""


cte("mi_all", _mi_sql("model_table"), "model_table")
cte("mi_train", _mi_sql("(select * from split80 where split = 'train')"), "split80")


@query("mi_binned", "select feature, round(mi, 6) as mi from mi_all", ("mi_all",))
def mi_binned(spark, sf):
    out = X.mi_binned(B.model_table(spark, sf), _F)
    return out.withColumn("mi", F.round("mi", 6))


def _train(spark, sf):
    split = materialize(L.supervised_split(B.model_table(spark, sf)), "split")
    return split.where("split = 'train'")


@query("mi_topk_train_only", "select feature, round(mi, 6) as mi from mi_train "
       "order by round(mi, 6) desc, feature limit 10", ("mi_train",))
def mi_topk_train_only(spark, sf):
    scores = X.mi_binned(_train(spark, sf), _F).withColumn("mi", F.round("mi", 6))
    return X.top_k(scores, 10)


@query("mi_topk_all", "select feature, round(mi, 6) as mi from mi_all "
       "order by round(mi, 6) desc, feature limit 10", ("mi_all",))
def mi_topk_all(spark, sf):
    return X.top_k(X.mi_binned(B.model_table(spark, sf), _F).withColumn("mi", F.round("mi", 6)), 10)


@query("topk_mi", "select feature, row_number() over (order by round(mi, 6) desc, feature) as place "
       "from mi_all order by place limit 5", ("mi_all",))
def topk_mi(spark, sf):
    from pyspark.sql import Window

    scores = X.mi_binned(B.model_table(spark, sf), _F).withColumn("mi", F.round("mi", 6))
    best = X.top_k(scores, 5)
    return best.select("feature", F.row_number().over(
        Window.orderBy(F.desc("mi"), "feature")).alias("place"))


_ORDINAL = "case feature " + " ".join(f"when '{f}' then {i + 1}" for i, f in enumerate(_F)) + " end"


@query("topk_features", f"select feature, {_ORDINAL} as ordinal from (select feature from mi_all "
       "order by round(mi, 6) desc, feature limit 5)", ("mi_all",))
def topk_features(spark, sf):
    scores = X.mi_binned(B.model_table(spark, sf), _F).withColumn("mi", F.round("mi", 6))
    return X.in_column_order(X.top_k(scores, 5), _F).select("feature", "ordinal")


@query("no_mi", f"select row_id, category, {', '.join(f'round({c}, 4) as {c}' for c in _F)} "
       "from model_table", ("model_table",))
def no_mi(spark, sf):
    """Without selection every numeric feature stays."""
    table = B.model_table(spark, sf)
    numeric = [n for n, t in table.dtypes if t in ("bigint", "double") and n != "row_id"]
    return table.select("row_id", "category", *[F.round(c, 4).alias(c) for c in numeric])


def _digamma_sql(n: str) -> str:
    x = f"({n} + 6.0e0)"
    steps = " + ".join(f"1.0e0 / ({n} + {i})" for i in range(6))
    return (f"(ln({x}) - 0.5e0 / {x} - 1 / ({x} * {x}) * (1 / 12.0e0 - 1 / ({x} * {x}) * (1 / 120.0e0 "
            f"- 1 / ({x} * {x}) * (1 / 252.0e0 - 1 / ({x} * {x}) / 240.0e0))) - ({steps}))")


def _gaps_sql(k: int) -> str:
    return ", ".join(f"{{'d': {s} * ({f}(x, {j}) over w - x), 'e': {s} * ({f}(u, {j}) over w - u), 's': {s}, "
                     f"'x': {f}(x, {j}) over w, 'u': {f}(u, {j}) over w}}"
                     for j in range(1, k + 1) for f, s in (("lag", -1), ("lead", 1)))


# every row against all rows of its feature
@query("mi_knn", f"""with l as (select row_id, category, feature, value + 0.0e0 as x,
    ('0x' || substr(md5(row_id || ':' || feature || ':42'), 1, 12))::bigint as u
    from (select row_id, category, {', '.join(_F)} from model_table) unpivot (value for feature in ({', '.join(_F)}))),
  g as (select *, count(*) over (partition by feature, category) as n_c, [{_gaps_sql(3)}] as near from l
    window w as (partition by feature, category order by x, u, row_id)),
  c as (select *, unnest(near) as nb from g where n_c > 1),
  k as (select * from (select *, row_number() over (partition by feature, row_id order by nb.d, nb.e, nb.s) as nth
    from c where nb.x is not null) where nth = least(3, n_c - 1)),
  i as (select *, 2 * x - nb.x as image, 2 * x - nb.x - 2 * x as part from k),
  e as (select *, (2 * x - (image - part)) + (-nb.x - part) as rest, 2 * u - nb.u as other from i),
  b as (select feature, row_id, x, u, n_c, nth, case when nb.s < 0 then nb.x else image end as lx,
    case when nb.s < 0 then 0 else rest end as lr, case when nb.s < 0 then nb.u else other end as lu,
    case when nb.s < 0 then image else nb.x end as hx, case when nb.s < 0 then rest else 0 end as hr,
    case when nb.s < 0 then other else nb.u end as hu from e),
  m as (select b.feature, b.row_id, any_value(b.n_c) as n_c, any_value(b.nth) as k, count(*) as m
    from b join b p on p.feature = b.feature and p.x >= b.lx and p.x <= b.hx
      and (p.x > b.lx or b.lr < 0 or (b.lr = 0 and p.u > b.lu))
      and (p.x < b.hx or b.hr > 0 or (b.hr = 0 and p.u < b.hu)) group by b.feature, b.row_id)
  select feature, round(greatest(0, {_digamma_sql('count(*)')} + avg({_digamma_sql('k')} - {_digamma_sql('n_c')}
    - {_digamma_sql('m')})), 6) as mi from m group by feature""", ("model_table",))
def mi_knn(spark, sf):
    return X.mi_knn(B.model_table(spark, sf), _F).withColumn("mi", F.round("mi", 6))


@query("leak_screen", f"""with l as (select * from (select category, {', '.join(_F)} from model_table)
    unpivot (value for feature in ({', '.join(_F)}))),
  r as (select feature, category, rank() over (partition by feature order by value)
    + (count(*) over (partition by feature, value) - 1) / 2.0e0 as rk from l),
  a as (select feature, (sum(rk) filter (where category = 1) - cast(count(*) filter (where category = 1) as double)
    * (count(*) filter (where category = 1) + 1) / 2) / (cast(count(*) filter (where category = 1) as double)
    * count(*) filter (where category = 0)) as auc from r group by feature)
  select feature, round(auc, 6) as auc, greatest(auc, 1 - auc) >= 0.999 as leak from a""",
       ("model_table",))
def leak_screen(spark, sf):
    out = X.leak_screen(B.model_table(spark, sf), _F)
    return out.withColumn("auc", F.round("auc", 6))
