"""Samples, splits, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowloom import schemas as S
from flowloom.catalog import bridge as B
from flowloom.catalog.registry import cte, query
from flowloom.functions import normalize as N
from flowloom.operators import encode as E
from flowloom.operators import sampling as P
from flowloom.operators import select as X
from flowloom.operators import splits as L
from flowloom.operators.counters import running_count
from flowloom.operators.prefix import spread, time_slices


def key(seed: str = "'42'", row: str = "row_id") -> str:
    return f"md5(concat_ws(':', cast({row} as varchar), {seed}))"


def _rank(part: str, seed: str = "'42'") -> str:
    scope = f"partition by {part} " if part else ""
    return f"row_number() over ({scope}order by {key(seed)}, row_id)"


_TARGETS = {"normal": 3000, "scanning": 2500, "ddos": 500, "backdoor": 2500, "mitm": 100}
cte("quota", f"""with r as (select row_id, label, {_rank('label')} as rn,
    count(*) over (partition by label) as n from base),
  t(label, target) as (values {', '.join(f"('{k}', {v})" for k, v in _TARGETS.items())}),
  s as (select t.label, target, max(n) as n from t join r on r.label = t.label group by 1, 2),
  d as (select label, n, unnest(range(1, target + 1)) as i from s where n < target),
  e as (select label, i, cast(concat('0x', substr({key(row='i')}, 1, 8)) as bigint) % n + 1 as rn from d)
  select r.row_id, r.label, 0 as dup_no from r join s on r.label = s.label
    where s.n >= s.target and r.rn <= s.target
  union all select r.row_id, r.label,
    row_number() over (partition by r.row_id order by i) - 1 from e join r on r.label = e.label and r.rn = e.rn
""", "base")


@query("quota_sample", "select row_id, label, dup_no from quota", ("quota",))
def quota_sample(spark, sf):
    rows = B.base(spark, sf).select("row_id", "label")
    return P.quota_sample(rows, _TARGETS)


@query("sample_with_replacement", "select label, count(*) as n_draws, count(distinct row_id) as n_rows "
       "from quota group by label", ("quota",))
def sample_with_replacement(spark, sf):
    out = P.quota_sample(B.base(spark, sf).select("row_id", "label"), _TARGETS)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n_draws"),
                                    F.countDistinct("row_id").alias("n_rows"))


@query("model_table", "select row_id, dup_no, case when label = 'normal' then 0 else 1 end as category, "
       "case label when 'normal' then 0 when 'backdoor' then 1 when 'ddos' then 3 "
       "when 'scanning' then 6 end as class from quota", ("quota",))
def model_table(spark, sf):
    """Quota sample, shuffle and both labellings in one plan."""
    rows = P.quota_sample(B.base(spark, sf).select("row_id", "label"), _TARGETS)
    rows = P.shuffle(rows, copy="dup_no")
    return rows.select("row_id", "dup_no", N.binary_category(F.col("label")).alias("category"),
                       N.coded(F.lower("label"), S.CLASS_CODES).alias("class"))


@query("balanced_subset", f"""select row_id, label from (select row_id, label,
  {_rank('label')} as rn from base where label in ('ddos', 'normal')) where rn <= 1500""",
       ("base",))
def balanced_subset(spark, sf):
    return P.balanced_subset(B.base(spark, sf).select("row_id", "label"), ["ddos", "normal"], 1500)


@query("subsample_rows", f"select row_id from base order by {key()}, row_id limit 1000", ("base",))
def subsample_rows(spark, sf):
    return P.subsample_rows(B.base(spark, sf).select("row_id"), 1000, 42)


@query("sample_fraction", f"""select row_id from (select row_id, {_rank('')} as rn,
  count(*) over () as n from base where label = 'normal') where rn <= round_even(0.8e0 * n, 0)""",
       ("base",))
def sample_fraction(spark, sf):
    benign = B.base(spark, sf).where(F.col("label") == "normal").select("row_id")
    return P.sample_fraction(benign, 0.8, 42)


def _split_sql(source: str, seed: str, scope: str = "") -> str:
    lead = f"{scope}, " if scope else ""
    over = f"partition by {scope}" if scope else ""
    return f"""with r as (select *, {_rank(f'{lead}category', seed)} as rn from {source}),
  c as (select {lead}category, count(*) as n from {source} group by {lead}category),
  a as (select *, sum(n) over ({over}) as all_n from c),
  t as (select *, cast(ceil(0.2e0 * all_n) as bigint) as test_n from a),
  q as (select *, (test_n * n) // all_n as quota, (test_n * n) % all_n as rest from t),
  z as (select *, quota + case when row_number() over ({over} order by rest desc, category)
    <= test_n - sum(quota) over ({over}) then 1 else 0 end as take from q)
  select r.*, case when r.rn <= z.take then 'test' else 'train' end as split from r
  join z on r.category = z.category {'and r.' + scope + ' = z.' + scope if scope else ''}"""


cte("split80", _split_sql("model_table", "'42'"), "model_table")
cte("five", "select row_id, category, unnest(range(1, 6)) as iteration from model_table",
    "model_table")
cte("split_k", _split_sql("five", "cast(42 + iteration - 1 as varchar)", "iteration"), "five")
cte("unsup", f"""with r as (select row_id, category, {_rank('category')} as rn,
    count(*) over (partition by category) as n from model_table),
  u as (select *, case when category = 0 then ceil(0.4e0 * n) else n - ceil(0.6e0 * n) end as used from r)
  select row_id, category, case when rn <= ceil(0.5e0 * used) then 'test' when rn <= used then 'valid'
    when category = 0 then 'train' else 'unused' end as split from u""", "model_table")


def _model(spark, sf):
    return B.model_table(spark, sf).select("row_id", "category")


@query("supervised_split", "select row_id, category, split from split80", ("split80",))
def supervised_split(spark, sf):
    return L.supervised_split(_model(spark, sf))


@query("unsupervised_split", "select row_id, category, split from unsup", ("unsup",))
def unsupervised_split(spark, sf):
    return L.unsupervised_split(_model(spark, sf))


def _drawn(name: str, seed: int) -> str:
    return (f"select row_id, category, '{name}' from (select row_id, category, "
            + _rank("", f"'{seed}'") + " as rn, count(*) over () as n from model_table "
            "where category = 1) where rn <= ceil(0.2e0 * n)")


@query("unsupervised_split_overlap", "select row_id, category, split from unsup where category = 0 "
       f"union all {_drawn('valid', 44)} union all {_drawn('test', 45)}", ("unsup",))
def unsupervised_split_overlap(spark, sf):
    return L.unsupervised_split_overlap(_model(spark, sf))


@query("stratified_kfold", f"select row_id, category, cast({_rank('category')} % 10 as int) as fold "
       "from model_table", ("model_table",))
def stratified_kfold(spark, sf):
    return L.stratified_kfold(_model(spark, sf))


@query("mccv_splits", "select row_id, category, iteration, split from split_k", ("split_k",))
def mccv_splits(spark, sf):
    return L.mccv_splits(_model(spark, sf), 5)


@query("split_summary", "select split, count(*) as n_rows, round(avg(category), 6) as attack_share "
       "from unsup group by split", ("unsup",))
def split_summary(spark, sf):
    out = L.split_summary(L.unsupervised_split(_model(spark, sf)))
    return out.withColumn("attack_share", F.round("attack_share", 6))


# --- sorts ---------------------------------------------------------------------------------------
@query("stable_time_sort", "select source_file, row_id, row_number() over (partition by source_file "
       "order by stime, row_id) as position from base", ("base",))
def stable_time_sort(spark, sf):
    rows = time_slices(B.base(spark, sf).select("source_file", "row_id", "stime"))
    return running_count(spread(rows), ["source_file"], "position", rows).select(
        "source_file", "row_id", "position")


@query("value_counts_desc", "select conn_state, count(*) as n from base group by conn_state "
       "order by n desc, conn_state", ("base",))
def value_counts_desc(spark, sf):
    return (B.base(spark, sf).groupBy("conn_state").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "conn_state"))


@query("shuffle", f"select row_id, label from base order by {key()}", ("base",))
def shuffle(spark, sf):
    return P.shuffle(B.base(spark, sf).select("row_id", "label"))


@query("head", "select row_id, stime from base order by stime, row_id limit 10", ("base",))
def head(spark, sf):
    return B.base(spark, sf).select("row_id", "stime").orderBy("stime", "row_id").limit(10)


# --- unions ----------------------------------------------------------------------------------------
def _per_label(spark, sf, cols):
    base = B.base(spark, sf)
    return [base.where(F.col("label") == lab).select(*cols)
            for lab in ("normal", "scanning", "ddos", "backdoor")]


@query("union_files", "select row_id, label, src_pkts from base", ("base",))
def union_files(spark, sf):
    return B.union_all(_per_label(spark, sf, ["row_id", "label", "src_pkts"]))


@query("union_align", "select row_id, label, src_pkts, case when label = 'normal' then dst_pkts else 0 "
       "end as dst_pkts from base", ("base",))
def union_align(spark, sf):
    base = B.base(spark, sf)
    first = base.where("label = 'normal'").select("row_id", "label", "src_pkts", "dst_pkts")
    other = base.where("label <> 'normal'").select("row_id", "label", "src_pkts", "stime")
    return E.union_aligned(first, other)


@query("merge_report", "select count(distinct source_file) as files_merged, count(*) as n_rows from base",
       ("base",))
def merge_report(spark, sf):
    return B.base(spark, sf).agg(F.countDistinct("source_file").alias("files_merged"),
                                 F.count(F.lit(1)).alias("n_rows"))


LIST_FEATURES = ["src_ip_bytes", "dst_ip_bytes", "src_pkts", "dst_pkts", "http_status_code",
                 "dst_port", "dur"]
_CV = ", ".join(f"round(stddev_pop({c}) / avg({c}), 6) as {c}" for c in LIST_FEATURES)
cte("ranked_lists", f"""select list_no, feature, rank from (
  select cast(substr(source_file, 2) as int) as list_no, feature,
    row_number() over (partition by source_file order by score desc, feature) as rank
  from (select source_file, {_CV} from req group by source_file)
  unpivot (score for feature in ({', '.join(LIST_FEATURES)}))) where rank <= 4""", "req")
cte("united", "select feature, row_number() over (order by list_no, rank) as ordinal from "
    "(select feature, list_no, rank, row_number() over (partition by feature order by list_no, rank) "
    "as nth from ranked_lists) where nth = 1", "ranked_lists")


def ranked_lists(spark, sf):
    """Per file, the four features that vary most: three ranked lists taken from the data."""
    req = B.complete(spark, sf)
    cv = req.groupBy("source_file").agg(*[
        F.round(F.stddev_pop(c) / F.avg(c), 6).alias(c) for c in LIST_FEATURES])
    long = cv.unpivot(["source_file"], LIST_FEATURES, "feature", "score")
    seq = Window.partitionBy("source_file").orderBy(F.desc("score"), "feature")
    return (long.withColumn("rank", F.row_number().over(seq)).where("rank <= 4")
            .select(F.substring("source_file", 2, 9).cast("int").alias("list_no"), "feature",
                    "rank"))


@query("feature_union", "select ordinal, feature from united", ("united",))
def feature_union(spark, sf):
    return X.feature_union(ranked_lists(spark, sf))


@query("feature_overlap", "select feature, count(distinct list_no) as n_lists from ranked_lists "
       "group by feature having count(distinct list_no) > 1", ("ranked_lists",))
def feature_overlap(spark, sf):
    return X.feature_overlap(ranked_lists(spark, sf))


_LONG_REQ = (f"(select row_id, {', '.join(f'cast({c} as double) as {c}' for c in LIST_FEATURES)} "
             f"from req) unpivot (value for feature in ({', '.join(LIST_FEATURES)}))")


def _union_projection(spark, sf):
    names = [r.feature for r in
             X.feature_union(ranked_lists(spark, sf)).orderBy("ordinal").collect()]
    return X.project_union(B.complete(spark, sf), names), names


@query("project_union", f"select feature, count(*) as n_rows from {_LONG_REQ} where feature in "
       "(select feature from united) group by feature", ("req", "united"))
def project_union(spark, sf):
    df, names = _union_projection(spark, sf)
    counts = df.agg(*[F.count(F.lit(1)).alias(c) for c in names])
    return counts.unpivot([], names, "feature", "n_rows")


@query("shap_union_filter", f"select feature, round(sum(value), 2) as total from {_LONG_REQ} "
       "where feature in (select feature from united) group by feature", ("req", "united"))
def shap_union_filter(spark, sf):
    df, names = _union_projection(spark, sf)
    sums = df.agg(*[F.round(F.sum(F.col(c).cast("double")), 2).alias(c) for c in names])
    return sums.unpivot([], names, "feature", "total")
