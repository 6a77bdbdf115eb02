"""Detectors, evaluation protocols, tuning, whole plans and streams.

The registered search and protocol runs use the full spaces, models and fold counts, on whole tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowloom import schemas as S
from flowloom.catalog import bridge as B
from flowloom.catalog.q_enrich import rounded
from flowloom.catalog.q_sampling import _split_sql
from flowloom.catalog.q_sources import FLOW_GAP, FLOWS_SQL
from flowloom.catalog.registry import cte, query
from flowloom.operators import detectors as D
from flowloom.operators import metrics as M
from flowloom.operators.detectors.lof import lof_table
from flowloom.operators.detectors.supervised import bayes_parameters
from flowloom.operators.splits import supervised_split, unsupervised_split
from flowloom.plans import experiment as E
from flowloom.plans import protocols as P
from flowloom.plans import tuning as T
from flowloom.session import materialize
from flowloom.streaming import flows as R
from flowloom.streaming.replay import closing, replay, replay_batches

FEATURES = ["src_ip_bytes", "dst_ip_bytes", "src_pkts", "dst_pkts", "dur"]

_SUP = {"Random Forest": lambda f, s: D.RandomForest(f, n_estimators=20, max_depth=8, seed=s),
        "Decision Tree": lambda f, s: D.DecisionTree(f, max_depth=8, seed=s),
        "Naive Bayes": lambda f, s: D.NaiveBayes(f)}
_UNS = {"Isolation Forest": lambda f, s: D.IsolationForest(f, contamination=0.1, seed=s),
        "One-Class SVM": lambda f, s: D.OneClassSVM(f, nu=0.1, seed=s),
        "Local Outlier Factor": lambda f, s: D.LocalOutlierFactor(f, contamination=0.1),
        "Elliptic Envelope": lambda f, s: D.EllipticEnvelope(f, seed=s)}


def _table(spark, sf):
    return B.model_table(spark, sf).select("row_id", S.TARGET, *FEATURES)


def _parts(spark, sf):
    parts = materialize(unsupervised_split(_table(spark, sf)), "split")
    benign = parts.where("split = 'train'").drop("split")
    return benign, parts.where("split = 'valid'").drop("split"), \
        parts.where("split = 'test'").drop("split")


def _fit_supervised(spark, sf, name):
    split = materialize(supervised_split(_table(spark, sf)), "split")
    model = _SUP[name](FEATURES, 42).fit(split.where("split = 'train'"))
    return model.predict(split.where("split = 'test'")).select("row_id", S.TARGET, "guess", "score")


def _fit_unsupervised(spark, sf, name):
    """Fit on all benign training rows."""
    benign, _, test = _parts(spark, sf)
    model = _UNS[name](FEATURES, 42).fit(benign)
    return model.predict(test).select("row_id", S.TARGET, "guess", "score")


@query("random_forest")
def random_forest(spark, sf):
    return _fit_supervised(spark, sf, "Random Forest")


_DEPTH = 8


def _tree_sql(depth: int) -> str:
    """The tree level by level: all cuts of all nodes are compared, then rows move to their child."""
    cell = "list_filter([" + ", ".join(f"{{'f': {i}, 'x': {f}}}" for i, f in enumerate(FEATURES))
    value = "case f " + " ".join(f"when {i} then {f}" for i, f in enumerate(FEATURES)) + " end"
    # class weights n / (2 n_c) over the training rows; test rows weigh nothing and only follow
    out = f"""with t0 as (select row_id, category, split, {', '.join(FEATURES)}, 1::bigint as node,
      case when split = 'train' and category = 0 then (select count(*) / (2.0e0 * count(*) filter (where category = 0))
        from split80 where split = 'train') else 0 end as w0,
      case when split = 'train' and category = 1 then (select count(*) / (2.0e0 * count(*) filter (where category = 1))
        from split80 where split = 'train') else 0 end as w1 from split80)"""
    for k in range(depth):
        out += f""",
    s{k} as (select node, sum(w0) as a, sum(w1) as b from t{k} where split = 'train' group by node),
    c{k} as (select node, f, x, sum(sum(w0)) over w as l0, sum(sum(w1)) over w as l1, lead(x) over w as y
      from (select node, w0, w1, unnest({cell}], lambda c: true), recursive := true) from t{k} where split = 'train')
      group by node, f, x window w as (partition by node, f order by x)),
    b{k} as (select node, f, case when x + (y - x) / 2 < y then x + (y - x) / 2 else x end as cut from (
      select *, row_number() over (partition by node order by round(((l0 * l0 + l1 * l1) / (l0 + l1)
        + (power(a - l0, 2) + power(b - l1, 2)) / (a - l0 + b - l1)) / (a + b), 10) desc, f, x) as place
      from c{k} join s{k} using (node) where y is not null and a > 0 and b > 0) where place = 1),
    t{k + 1} as (select t.* replace (case when f is null then node when {value} > cut then 2 * node + 1 else 2 * node end as node)
      from (select * from t{k} left join b{k} using (node)) t)""".replace("t.* replace", "t.* exclude (f, cut) replace")
    return out + f""",
    leaf as (select node, sum(w1) / (sum(w0) + sum(w1)) as p from t{depth} where split = 'train' group by node)
    select row_id, category, case when p > 0.5 then 1 else 0 end as guess, round(p, 6) as score
    from t{depth} join leaf using (node) where split = 'test'"""


@query("decision_tree", _tree_sql(_DEPTH), ("split80",))
def decision_tree(spark, sf):
    return _fit_supervised(spark, sf, "Decision Tree").withColumn("score", F.round("score", 6))


_NB = " union all ".join(
    f"select category, '{f}' as feature, avg({f}) as mean, var_pop({f}) as var, count(*) as n from model_table group by category"
    for f in FEATURES)
_MAXVAR = "greatest(" + ", ".join(f"var_pop({f})" for f in FEATURES) + ")"


@query("naive_bayes", f"""select category, feature, round(mean, 4) as mean,
  round(var + 1e-9 * (select {_MAXVAR} from model_table), 2) as var,
  round(n / (select cast(count(*) as double) from model_table), 6) as prior from ({_NB})""",
       ("model_table",))
def naive_bayes(spark, sf):
    out = bayes_parameters(_table(spark, sf), FEATURES)
    return rounded(out, {"mean": 4, "var": 2, "prior": 6})


_LL = {c: " + ".join([f"ln((select prior from nb where category = {c} limit 1))"] + [
    f"(select -0.5e0 * ln(2 * pi() * var) from nb where category = {c} and feature = '{f}') "
    f"- power({f} - (select mean from nb where category = {c} and feature = '{f}'), 2) / "
    f"(2 * (select var from nb where category = {c} and feature = '{f}'))" for f in FEATURES])
    for c in (0, 1)}
cte("nb", f"""select category, feature, mean, var + 1e-9 * (select {_MAXVAR} from split80 where split = 'train') as var,
  n / (select cast(count(*) as double) from split80 where split = 'train') as prior from (
  {_NB.replace('from model_table', "from split80 where split = 'train'")})""", "split80")


@query("naive_bayes_predict", f"""select row_id, case when l1 > l0 then 1 else 0 end as guess,
  round(1 / (1 + exp(l0 - l1)), 5) as score from (select row_id, {_LL[0]} as l0, {_LL[1]} as l1
  from split80 where split = 'test')""", ("nb", "split80"))
def naive_bayes_predict(spark, sf):
    out = _fit_supervised(spark, sf, "Naive Bayes")
    return out.select("row_id", "guess", F.round("score", 5).alias("score"))


@query("isolation_forest")
def isolation_forest(spark, sf):
    return _fit_unsupervised(spark, sf, "Isolation Forest")


@query("one_class_svm")
def one_class_svm(spark, sf):
    return _fit_unsupervised(spark, sf, "One-Class SVM")


@query("elliptic_envelope")
def elliptic_envelope(spark, sf):
    return _fit_unsupervised(spark, sf, "Elliptic Envelope")


# every distinct test row against every distinct benign training row, ties by distance, then smallest row id
_D2 = " + ".join(f"power(a.{f} - b.{f}, 2)" for f in FEATURES)
_K = 20
cte("lof_ref", f"""select min(row_id) as pid, count(*) as m, {', '.join(FEATURES)} from model_table
  join (select row_id from unsup where split = 'train') using (row_id) group by {', '.join(FEATURES)}""",
    "model_table", "unsup")
cte("lof_ask", f"""select distinct {', '.join(FEATURES)} from model_table
  join (select row_id from unsup where split = 'test') using (row_id)""", "model_table", "unsup")


def _lof_near(ask: str, weight: str) -> str:
    return f"""select q, p, sqrt(d2) as d, least(w, {_K} - before) as w from (
      select *, sum(w) over (partition by q order by d2, p) - w as before from (
        select *, row_number() over (partition by q order by d2, p) as nth from (
          select {ask} as q, b.pid as p, {_D2} as d2, {weight} as w from {{0}} a, lof_ref b) where w > 0)
      where nth <= {_K}) where before < {_K}"""


cte("lof_own", _lof_near("a.pid", "b.m - (a.pid = b.pid)::int").format("lof_ref"), "lof_ref")
cte("lof_kd", "select q as p, max(d) as kdist from lof_own group by q", "lof_own")
cte("lof_den", f"select q as p, 1 / (sum(greatest(d, kdist) * w) / {_K}.0e0 + 1e-10) as lrd from lof_own "
    "join lof_kd using (p) group by q", "lof_own", "lof_kd")
cte("lof_off", f"""select quantile_cont(-f, 0.1e0) as off from (select unnest(range(m)), f from lof_ref join (
  select q as pid, sum(n.lrd * w) / {_K}.0e0 / any_value(o.lrd) as f from lof_own join lof_den n using (p)
  join lof_den o on o.p = q group by q) using (pid))""", "lof_ref", "lof_own", "lof_den")
cte("lof_test", "select row_number() over () as qid, * from lof_ask", "lof_ask")
cte("lof_out", _lof_near("a.qid", "b.m").format("lof_test"), "lof_test", "lof_ref")
cte("lof_scored", f"""select {', '.join(FEATURES)}, score from lof_test join (select q as qid,
  sum(lrd * w) / {_K}.0e0 * (sum(greatest(d, kdist) * w) / {_K}.0e0 + 1e-10) as score
  from lof_out join lof_kd using (p) join lof_den using (p) group by q) using (qid)""",
    "lof_test", "lof_out", "lof_kd", "lof_den")


@query("local_outlier_factor_predict", f"""select row_id, category,
  case when score > -(select off from lof_off) then 1 else 0 end as guess, round(log10(score), 6) as score
  from model_table join (select row_id from unsup where split = 'test') using (row_id)
  join lof_scored using ({', '.join(FEATURES)})""", ("model_table", "unsup", "lof_scored", "lof_off"))
def local_outlier_factor_predict(spark, sf):
    out = _fit_unsupervised(spark, sf, "Local Outlier Factor")
    return out.withColumn("score", F.round(F.log10("score"), 6))


# every row of the embedding table against all others, k = 10
cte("lof_near", """select * from (select a.vec_id as i, b.vec_id as j,
    list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])) as d,
    row_number() over (partition by a.vec_id order by list_distance(cast(a.embedding as double[]),
      cast(b.embedding as double[])), b.vec_id) as r
  from embeddings a join embeddings b on a.vec_id <> b.vec_id) where r <= 10""")
cte("lof_k", "select i, max(d) as kdist from lof_near group by i", "lof_near")
cte("lof_lrd", "select n.i, 1 / (avg(greatest(d, kdist)) + 1e-10) as lrd from lof_near n "
    "join lof_k k on n.j = k.i group by n.i", "lof_near", "lof_k")


@query("local_outlier_factor", """select n.i as vec_id, round(max(k.kdist), 5) as kdist,
  round(avg(l.lrd) / max(o.lrd), 5) as factor from lof_near n join lof_lrd l on n.j = l.i
  join lof_lrd o on n.i = o.i join lof_k k on n.i = k.i group by n.i""", ("lof_near", "lof_lrd", "lof_k"))
def local_outlier_factor(spark, sf):
    rows = B.table(spark, sf, "embeddings")
    width = len(rows.select("embedding").first()[0])
    names = [f"e{i}" for i in range(width)]
    wide = rows.select("vec_id", *[F.element_at("embedding", i + 1).cast("double").alias(n)
                                   for i, n in enumerate(names)])
    out = lof_table(wide, "vec_id", names, 10)
    return out.select("vec_id", F.round("kdist", 5).alias("kdist"),
                      F.round("factor", 5).alias("factor"))


# --- tuning and protocols: full spaces and models; what does not depend on a fit is checked by SQL ------
_TRIALS, _FOLDS, _ROUNDS = 3, 10, 3


def _facts(out):
    """What the metric rows say of the rows they were measured on: per model and iteration the number of
    metrics, of test rows by class, and whether all shares lie in 0..1."""
    wide = out.where("model <> 'all'").groupBy("iteration", "model").pivot("metric", S.METRICS).agg(F.first("value"))
    share = [F.col(c).between(0, 1) for c in ("accuracy", "precision", "recall", "f1_score", "auc")]
    return wide.select("iteration", "model", (F.col("TP") + F.col("FN")).cast("bigint").alias("attacks"),
                       (F.col("TN") + F.col("FP")).cast("bigint").alias("benign"),
                       reduce(lambda a, b: a & b, share).alias("in_range"),
                       F.col("MCC").between(-1, 1).alias("mcc_in_range"),
                       (F.round(F.col("accuracy") * (F.col("TP") + F.col("TN") + F.col("FP") + F.col("FN")))
                        == F.col("TP") + F.col("TN")).alias("accuracy_fits"),
                       ((F.col("train_time") > 0) & (F.col("predict_time") >= 0)).alias("timed"))


def _facts_sql(models: list[str], first: int, last: int, rows: str) -> str:
    names = ", ".join(f"('{m}')" for m in models)
    return (f"select i::int as iteration, model, attacks, benign, true as in_range, true as mcc_in_range, "
            f"true as accuracy_fits, true as timed from range({first}, {last + 1}) t(i) "
            f"cross join (values {names}) m(model) join ({rows}) r on r.iteration is null or r.iteration = i")


def _sides(source: str, by: str = "cast(null as bigint)") -> str:
    return (f"select {by} as iteration, count(*) filter (where category = 1) as attacks, "
            f"count(*) filter (where category = 0) as benign from {source} where split = 'test' group by 1")


cte("rounds", f"select row_id, category, unnest(range(1, {_ROUNDS + 1})) as iteration from model_table", "model_table")
cte("split_rounds", _split_sql("rounds", "cast(42 + iteration - 1 as varchar)", "iteration"), "rounds")
cte("outer10", "select row_id, category, unnest(range(1, 11)) as iteration from model_table", "model_table")
cte("split_outer", _split_sql("outer10", "cast(42 + iteration - 1 as varchar)", "iteration"), "outer10")
_UNS_ROWS = _sides("unsup")


def _trial_facts(table):
    """Per model and trial: drawn parameters inside their ranges, a score of 0..1, one best trial."""
    best = F.sum(F.col("best").cast("int")).over(Window.partitionBy("model"))
    spaces = F.lit(None).cast("boolean")
    for model, space in T.SPACES.items():
        inside = F.lit(True)
        for name, span in space.items():
            p = F.col("params")[name]
            inside = inside & (p.isin([str(x) for x in span]) if isinstance(span, list)
                               else p.cast("double").between(*span))
        spaces = F.when(F.col("model") == model, inside).otherwise(spaces)
    return (T.mark_best(table).withColumn("n_best", best.cast("int"))
            .select("model", "trial", F.col("value").between(0, 1).alias("in_range"), spaces.alias("in_space"),
                    "n_best", "state", (F.size("params")).alias("n_params")))


def _trials_sql(models: list[str]) -> str:
    names = ", ".join(f"('{m}', {len(T.SPACES[m])})" for m in models)
    return (f"select model, t::int as trial, true as in_range, true as in_space, 1 as n_best, 'COMPLETE' as state, "
            f"k as n_params from (values {names}) m(model, k) cross join range({_TRIALS}) r(t)")


@query("search_supervised", _trials_sql(["Random Forest", "Decision Tree"]))
def search_supervised(spark, sf):
    split = supervised_split(_table(spark, sf)).where("split = 'train'").drop("split")
    return _trial_facts(T.search_supervised(split, FEATURES, _TRIALS, folds=_FOLDS)[1])


@query("search_unsupervised", _trials_sql(S.UNSUPERVISED_MODELS))
def search_unsupervised(spark, sf):
    benign, valid, _ = _parts(spark, sf)
    return _trial_facts(T.search_unsupervised(benign, valid, FEATURES, _TRIALS)[1])


@query("eval_quick", _facts_sql(S.SUPERVISED_MODELS, 0, 0, _sides("split80")) + " union all "
       + _facts_sql(S.UNSUPERVISED_MODELS, 0, 0, _UNS_ROWS), ("split80", "unsup"))
def eval_quick(spark, sf):
    benign, _, test = _parts(spark, sf)
    sup = P.eval_quick_supervised(_table(spark, sf), FEATURES)
    return _facts(sup.unionByName(P.eval_quick_unsupervised(benign, test, FEATURES)))


@query("eval_iter", _facts_sql(S.SUPERVISED_MODELS, 1, 10, _sides("split_outer", "iteration")) + " union all "
       + _facts_sql(S.UNSUPERVISED_MODELS, 1, 10, _UNS_ROWS), ("split_outer", "unsup"))
def eval_iter(spark, sf):
    benign, _, test = _parts(spark, sf)
    sup = P.eval_iter_supervised(_table(spark, sf), FEATURES, 10)
    return _facts(sup.unionByName(P.eval_iter_unsupervised(benign, test, FEATURES, 10)))


@query("eval_nested", _facts_sql(S.SUPERVISED_MODELS, 1, 10, _sides("split_outer", "iteration")), ("split_outer",))
def eval_nested(spark, sf):
    return _facts(P.eval_nested(_table(spark, sf), FEATURES, 10, 10))


@query("mccv_supervised", _facts_sql(S.SUPERVISED_MODELS, 1, _ROUNDS, _sides("split_rounds", "iteration")),
       ("split_rounds",))
def mccv_supervised(spark, sf):
    return _facts(P.mccv_supervised(_table(spark, sf), FEATURES, _ROUNDS))


@query("mccv_unsupervised", _facts_sql(S.UNSUPERVISED_MODELS, 1, _ROUNDS, _UNS_ROWS), ("unsup",))
def mccv_unsupervised(spark, sf):
    benign, _, test = _parts(spark, sf)
    return _facts(P.mccv_unsupervised(benign, test, FEATURES, _ROUNDS))


@query("learning_curve", "select n, 'Isolation Forest' as model, true as in_range from "
       "(values (5000), (10000), (20000), (50000)) t(n)")
def learning_curve(spark, sf):
    benign, _, test = _parts(spark, sf)
    return P.learning_curve(benign, test, FEATURES).select(
        "n", "model", F.col("f1_score").between(0, 1).alias("in_range"))


@query("run_experiment")
def run_experiment(spark, sf):
    table = B.model_table(spark, sf).drop("label")
    return E.run_experiment(table, k=10, n_trials=_TRIALS, iterations=2).summary


# --- evaluation of a fitted model, checked by SQL: naive Bayes on the seeded split ---------------------
@query("evaluation_table", """select round((tp + tn) / (tp + tn + fp + fn), 6) as accuracy,
  cast(tp as bigint) as "TP", cast(tn as bigint) as "TN", cast(fp as bigint) as "FP", cast(fn as bigint) as "FN"
  from (select cast(count(*) filter (where category = 1 and guess = 1) as double) as tp,
  cast(count(*) filter (where category = 0 and guess = 0) as double) as tn,
  cast(count(*) filter (where category = 0 and guess = 1) as double) as fp,
  cast(count(*) filter (where category = 1 and guess = 0) as double) as fn from (
  select category, case when l1 > l0 then 1 else 0 end as guess from (select category, """
       + f"{_LL[0]} as l0, {_LL[1]} as l1 from split80 where split = 'test')))", ("nb", "split80"))
def evaluation_table(spark, sf):
    guessed = _fit_supervised(spark, sf, "Naive Bayes").withColumn("m", F.lit(1))
    out = M.evaluation(guessed, ["m"], "macro", S.TARGET, "guess", "score")
    return out.select(F.round("accuracy", 6).alias("accuracy"), "TP", "TN", "FP", "FN")


_QUOTA = {"normal": 3000, "scanning": 2500, "ddos": 500, "backdoor": 2500, "mitm": 100}
_KEPT = ["proto_tcp", "proto_udp", "src_ip_bytes", "src_pkts", "dst_pkts", "service_dns",
         "H_L0.01_weight", "MI_dir_L0.1_mean", "HH_jit_L1_mean"]


@query("raw_to_model", "select label, case when label = 'normal' then 0 else 1 end as category, max(target) as n_rows "
       "from req join (values " + ", ".join(f"('{k}', {v})" for k, v in _QUOTA.items())
       + ") t(name, target) on label = name group by label", ("req",))
def raw_to_model(spark, sf):
    out = E.raw_to_model(B.base(spark, sf), _QUOTA, _KEPT)
    return out.groupBy("label", S.TARGET).agg(F.count(F.lit(1)).alias("n_rows"))


# --- streams -------------------------------------------------------------------------------------------
def _by_file(df):
    """The files in time order; each becomes one replayed part."""
    names = [r[0] for r in df.select("source_file").distinct().orderBy("source_file").collect()]
    return [df.where(F.col("source_file") == n) for n in names]


def _req(spark, sf):
    return B.complete(spark, sf).select(
        "row_id", "source_file", "stime", "src_ip", "dst_ip", "src_ip_bytes", "dst_ip_bytes",
        "src_pkts", "dst_pkts", "dur")


@query("damped_stream", "select row_id, round(w001, 5) as weight, round(m001, 3) as mean from damped_src",
       ("damped_src",))
def damped_stream(spark, sf):
    total = F.col("src_ip_bytes") + F.col("dst_ip_bytes")
    out = replay_batches(spark, _by_file(_req(spark, sf)),
                         lambda s, root: R.damped_stream(s, ["src_ip"], total, 0.01, root))
    return rounded(out, {"weight": 5, "mean": 3})


@query("counters_stream", """select row_id, count(*) over w as n, cast(sum(src_ip_bytes + dst_ip_bytes) over w as bigint) as total
  from req window w as (partition by dst_ip order by stime, row_id rows between unbounded preceding and current row)""",
       ("req",))
def counters_stream(spark, sf):
    total = F.col("src_ip_bytes") + F.col("dst_ip_bytes")
    return replay_batches(spark, _by_file(_req(spark, sf)),
                          lambda s, root: R.counters_stream(s, ["dst_ip"], total, root))


@query("flow_assembly_stream", FLOWS_SQL, ("packets",))
def flow_assembly_stream(spark, sf):
    packets = B.packets(spark, sf)
    middle = packets.agg(F.percentile_approx("ts", 0.5)).first()[0]
    parts = [packets.where(F.col("ts") <= middle), packets.where(F.col("ts") > middle),
             closing(packets, "ts", 2 * FLOW_GAP)]
    return replay(spark, parts, lambda s: R.flow_assembly_stream(s, FLOW_GAP))


@query("score_stream")
def score_stream(spark, sf):
    benign, _, _ = _parts(spark, sf)
    model = _UNS["Isolation Forest"](FEATURES, 42).fit(benign)
    return replay(spark, _by_file(_req(spark, sf)),
                  lambda s: R.score_stream(s, model).select("row_id", "guess", "score"))


_WIDTH = 600000
_DRIFT = [("connection_state", "connection_state <> '' and connection_state not in ('S0', 'SF', 'REJ', 'OTH')"),
          ("requested_service", "requested_service <> '' and requested_service not in ('-', 'dns', 'http')"),
          ("protocol", "protocol not in (6, 17)")]


@query("vocab_drift_stream", " union all ".join(
    f"select (stime // {_WIDTH}) * {_WIDTH} as start_ms, '{c}' as field, cast({c} as varchar) as value, "
    f"count(*) as n from raw where {cond} group by all" for c, cond in _DRIFT), ("raw",))
def vocab_drift_stream(spark, sf):
    raw = B.raw_flows(spark, sf).select("row_id", "source_file", "stime", "connection_state",
                                        "requested_service", "protocol")
    parts = [*_by_file(raw), closing(raw, "stime", 2 * _WIDTH, protocol=-1)]
    return replay(spark, parts, lambda s: R.vocab_drift_stream(s, window="10 minutes"))
