"""Queries over metrics, series, governance, sessions and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablekit.operators import forecast as fc
from tablekit.operators import govern, metrics
from tablekit.operators.anomaly import series_anomalies
from tablekit.operators.score import format_confidence
from tablekit.operators.smoothing import fit_smoothing
from tablekit.plans.registry import query, r, rounded
from tablekit.sources.model_store import latest_runs
from tablekit.streaming import jobs

# -- metrics ----------------------------------------------------------------------------------------

SCORED = """scored as (select l_returnflag as label, case when l_linestatus = 'F' and l_quantity < 20 then 'A' when l_quantity > 40 then 'R' else 'N' end as prediction,
    l_discount as score from lineitem)"""


def scored(t) -> DataFrame:
    q, s = F.col("l_quantity"), F.col("l_linestatus")
    return t("lineitem").select(
        F.col("l_returnflag").alias("label"),
        F.when((s == "F") & (q < 20), "A").when(q > 40, "R").otherwise("N").alias("prediction"),
        F.col("l_discount").alias("score"),
    )


CELLS = f"""{SCORED}, classes as (select label as c from scored union select prediction from scored),
  cells as (select a.c as label, b.c as prediction, (select count(*) from scored s where s.label = a.c and s.prediction = b.c) as n from classes a, classes b),
  per as (select c as class, sum(n) filter (label = c and prediction = c) as tp, sum(n) filter (label = c) as support, sum(n) filter (prediction = c) as predicted
          from classes, cells group by c),
  report as (select class, case when predicted = 0 then 0 else tp / predicted end as "precision", case when support = 0 then 0 else tp / support end as recall,
          case when support + predicted = 0 then 0 else 2 * tp / (support + predicted) end as f1, support, predicted, tp from per)"""


@query("confusion_returnflag", f"with {CELLS} select label, prediction, n from cells")
def confusion_returnflag(t):
    return metrics.confusion(scored(t))


@query(
    "class_report_returnflag",
    f'with {CELLS} select class, {r(chr(34) + "precision" + chr(34))} as "precision", {r("recall")} as recall, {r("f1")} as f1, cast(support as bigint) as support from report',
)
def class_report_returnflag(t):
    return rounded(metrics.class_report(scored(t)).drop("predicted", "hits"))


@query(
    "classification_metrics_returnflag",
    f"""with {CELLS}, s as (select sum(tp)::double as hit, sum(support)::double as n, sum(support * predicted)::double as chance,
          sum(predicted * predicted)::double as pp, sum(support * support)::double as ss from report)
        select 'accuracy' as metric, {r('hit / n')} as value from s
        union all select 'balanced_accuracy', {r('avg(recall)')} from report where support > 0
        union all select 'precision_macro', {r('avg("precision")')} from report union all select 'recall_macro', {r('avg(recall)')} from report
        union all select 'f1_macro', {r('avg(f1)')} from report
        union all select 'precision_weighted', {r('sum("precision" * support) / sum(support)')} from report
        union all select 'recall_weighted', {r('sum(recall * support) / sum(support)')} from report
        union all select 'f1_weighted', {r('sum(f1 * support) / sum(support)')} from report
        union all select 'mcc', {r('(hit * n - chance) / (sqrt(n * n - pp) * sqrt(n * n - ss))')} from s
        union all select 'kappa', {r('(hit / n - chance / (n * n)) / (1 - chance / (n * n))')} from s""",
)
def classification_metrics_returnflag(t):
    return rounded(metrics.classification_metrics(scored(t)))


CURVE = f"""{SCORED}, points as (select score, sum((label = 'R')::int) as pos, sum((label <> 'R')::int) as neg from scored group by score),
  curve as (select score, pos, neg, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp,
            sum(pos) over () as np, sum(neg) over () as nn from points)"""


@query("roc_auc_returnflag", f"with {CURVE} select 'roc_auc' as metric, {r('sum(neg * (tp - pos / 2.0)) / (max(np) * max(nn))')} as value from curve")
def roc_auc_returnflag(t):
    return rounded(metrics.roc_auc(scored(t), "R"))


@query(
    "roc_curve_returnflag",
    f"with {CURVE} select score as threshold, {r('fp / nn')} as fpr, {r('tp / np')} as tpr from curve union all select 'infinity'::double, 0.0, 0.0",
)
def roc_curve_returnflag(t):
    points = metrics.roc_curve(scored(t), "R")
    return points.withColumns({"fpr": F.round("fpr", 6) + 0.0, "tpr": F.round("tpr", 6) + 0.0})


@query(
    "precision_recall_returnflag",
    f'with {CURVE} select score as threshold, {r("tp / (tp + fp)")} as "precision", {r("tp / np")} as recall from curve union all select null, 1.0, 0.0',
)
def precision_recall_returnflag(t):
    return rounded(metrics.precision_recall_curve(scored(t), "R"))


def priced(t) -> DataFrame:
    return t("lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 2000 + F.col("l_tax") * 1000).alias("prediction"))


PRICED = "priced as (select l_extendedprice as label, l_quantity * 2000 + l_tax * 1000 as prediction, l_extendedprice - (l_quantity * 2000 + l_tax * 1000) as e from lineitem)"


@query(
    "regression_metrics_price",
    f"""with {PRICED} select 'rmse' as metric, {r('sqrt(avg(e * e))', 4)} as value from priced union all select 'mae', {r('avg(abs(e))', 4)} from priced
        union all select 'r2', {r('1 - sum(e * e) / (var_pop(label) * count(*))', 4)} from priced
        union all select 'mape', {r('avg(abs(e) / greatest(abs(label), 2.220446049250313e-16))', 4)} from priced
        union all select 'explained_variance', {r('1 - var_pop(e) / var_pop(label)', 4)} from priced
        union all select 'medae', {r('quantile_cont(abs(e), 0.5)', 4)} from priced""",
)
def regression_metrics_price(t):
    return rounded(metrics.regression_metrics(priced(t)), 4)


@query(
    "residuals_orders",
    f"select o_orderkey, o_totalprice as actual, o_custkey * 10.0::double as predicted, {r('o_totalprice - o_custkey * 10.0', 4)} as residual from orders",
)
def residuals_orders(t):
    df = t("orders").select("o_orderkey", F.col("o_totalprice").alias("label"), (F.col("o_custkey") * F.lit(10.0)).alias("prediction"))
    return metrics.residuals(df, ["o_orderkey"]).withColumn("residual", F.round("residual", 4) + 0.0)


@query(
    "residual_histogram_price",
    f"""with {PRICED}, s as (select min(e) as lo, max(e) as hi, (max(e) - min(e)) / 20 as w from priced)
        select cast(least(floor((e - lo) / w), 19) as bigint) as bin, {r('min(lo + least(floor((e - lo) / w), 19) * w)', 3)} as lower,
          {r('min(lo + (least(floor((e - lo) / w), 19) + 1) * w)', 3)} as upper, count(*) as n from priced, s group by 1""",
)
def residual_histogram_price(t):
    return rounded(metrics.residual_histogram(priced(t), bins=20), 3)


@query(
    "format_confidence_orders",
    "select o_orderkey, printf('%.2f%%', greatest(p, 1 - p) * 100) as \"Confidence\" from (select o_orderkey, (o_orderkey % 97) / 97.0::double as p from orders)",
)
def format_confidence_orders(t):
    p = (F.col("o_orderkey") % 97) / F.lit(97.0)
    return format_confidence(t("orders").select("o_orderkey", F.array(p, 1 - p).alias("probability"))).drop("probability")


# -- series -----------------------------------------------------------------------------------------


def user_series(t) -> DataFrame:
    return fc.series(t("events"), "value", "ts", ["user_id"], ["event_id"])


SERIES = "s as (select cast(user_id as varchar) as series, ts, event_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, count(*) over (partition by user_id) as n from events)"
BASE = SERIES + """, base as (select series, count(*) as n, avg(value) as mean, case when stddev_pop(value) > 0 then stddev_pop(value) else 1 end as sigma,
    arg_max(value, pos) as last, regr_slope(value, pos) as slope, regr_intercept(value, pos) as intercept, avg(value) filter (pos >= n - 7) as recent from s group by series)"""
TIES = ["event_id"]


def forecast_sql(value: str, widen: str = "1", least: int = 3, clamp: bool = False) -> str:
    steps = "least(10, n)" if clamp else "10"
    return (
        f"with {BASE}, steps as (select *, unnest(range(1, {steps} + 1)) as k from base where n >= {least}) "
        f"select series, cast(k as integer) as step, n + k - 1 as index, {r(value, 7)} as forecast, "
        f"{r(f'{value} - 1.96 * sigma * {widen}', 7)} as lower, {r(f'{value} + 1.96 * sigma * {widen}', 7)} as upper from steps"
    )


def forecasted(t, method: str) -> DataFrame:
    return rounded(fc.forecast(user_series(t), method, 10, TIES), 7)


@query("forecast_naive", forecast_sql("last", least=12, clamp=True))
def forecast_naive(t):
    return forecasted(t, "naive")


@query("forecast_mean", forecast_sql("mean", least=12, clamp=True))
def forecast_mean(t):
    return forecasted(t, "mean")


@query("forecast_drift", forecast_sql("(intercept + slope * (n + k))", least=12, clamp=True))
def forecast_drift(t):
    return forecasted(t, "drift")


@query("forecast_moving_average", forecast_sql("recent"))
def forecast_moving_average(t):
    return forecasted(t, "moving_avg")


@query("forecast_linear", forecast_sql("(intercept + slope * (n + k - 1))", "sqrt(0.5 * k)"))
def forecast_linear(t):
    return forecasted(t, "linear")


@query("forecast_trend_band", forecast_sql("(intercept + slope * (n + k - 1))", "sqrt(k)"))
def forecast_trend_band(t):
    return forecasted(t, "trend_band")


@query(
    "smoothing_fixed_alpha",
    f"""with recursive {SERIES}, w as (select series, pos, value as level, 0.0::double as sse from s where pos = 0
          union all select s.series, s.pos, level + 0.3 * (value - level), sse + (value - level) * (value - level) from w join s on s.series = w.series and s.pos = w.pos + 1)
        select series, 0.3::double as alpha, {r('arg_max(sse, pos)', 4)} as sse, {r('arg_max(level, pos)', 4)} as level from w group by series""",
)
def smoothing_fixed_alpha(t):
    return rounded(fit_smoothing(user_series(t), TIES, [0.3]), 4)


@query(
    "smoothing_fitted_alpha",
    f"""with {SERIES}, l as (select series, list(value order by pos) as v from s group by series), w as (select series, v, unnest(range(1, 100)) / 100.0::double as alpha from l),
          f as (select series, alpha, list_reduce(v, lambda c, x: {{'level': c.level + alpha * (x.level - c.level), 'sse': c.sse + (x.level - c.level) * (x.level - c.level)}}) as e
                from (select series, alpha, list_transform(v, lambda x: {{'level': x, 'sse': 0.0::double}}) as v from w))
        select series, {r('arg_min(alpha, (round(e.sse, 6), alpha))', 2)} as alpha, {r('min(e.sse)', 3)} as sse from f group by series""",
)
def smoothing_fitted_alpha(t):
    """The weight with the least squared error of 99, for every series."""
    return rounded(rounded(fit_smoothing(user_series(t), TIES).select("series", "alpha", "sse"), 3).withColumn("alpha", F.round("alpha", 2) + 0.0), 3)


@query("forecast_smoothing")
def forecast_smoothing(t):
    return forecasted(t, "exp_smoothing")


@query("forecast_arima")
def forecast_arima(t):
    return forecasted(t, "arima")


@query("forecast_seasonal_arima")
def forecast_seasonal_arima(t):
    return forecasted(t, "sarima")


@query(
    "stationarity_lag_zero",
    f"""with {SERIES}, d as (select series, value - lag(value) over w as dy, lag(value) over w as y1 from s window w as (partition by series order by pos)),
          g as (select series, count(*) as m, regr_slope(dy, y1) as b, regr_intercept(dy, y1) as a, var_pop(y1) * count(*) as sxx from d where y1 is not null group by series),
          e as (select series, sum(pow(dy - a - b * y1, 2)) as rss from d join g using (series) where y1 is not null group by series)
        select series, m + 1 as n, 0 as lag, {r('b / sqrt(rss / (m - 2) / sxx)', 4)} as statistic from g join e using (series)""",
)
def stationarity_lag_zero(t):
    return rounded(fc.stationarity(user_series(t), TIES, fixed_lag=0).select("series", "n", "lag", "statistic"), 4)


@query("stationarity_users")
def stationarity_users(t):
    return rounded(fc.stationarity(user_series(t), TIES), 4)


@query(
    "series_summary_users",
    f"with {SERIES} select series, count(*) as n, {r('avg(value)', 4)} as mean, {r('stddev_samp(value)', 4)} as std, min(value) as min, max(value) as max from s group by series having count(*) >= 10",
)
def series_summary_users(t):
    return rounded(fc.summary(user_series(t)), 4)


@query(
    "detect_series_columns",
    """select 'l_shipdate' as date_column, (select c from (select 'l_quantity' as c, var_samp(l_quantity) as v from lineitem
         union all select 'l_extendedprice', var_samp(l_extendedprice) from lineitem union all select 'l_discount', var_samp(l_discount) from lineitem) order by v desc limit 1) as target""",
)
def detect_series_columns(t):
    df = t("lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    return t.spark.createDataFrame([(fc.detect_date_column(df), fc.default_target(df))], "date_column string, target string")


@query(
    "regularise_daily_price",
    f"""with p as (select l_returnflag as series, date_trunc('day', l_shipdate) as ts, avg(l_extendedprice) as value from lineitem group by all),
          g as (select series, unnest(generate_series(min(ts), max(ts), interval 1 day)) as ts from p group by series)
        select series, strftime(ts, '%Y-%m-%d') as ts, {r('last_value(value ignore nulls) over (partition by series order by ts rows between unbounded preceding and current row)', 4)} as value
        from g left join p using (series, ts)""",
)
def regularise_daily_price(t):
    data = fc.series(t("lineitem"), "l_extendedprice", "l_shipdate", ["l_returnflag"])
    return rounded(fc.regularise(data, "D").withColumn("ts", F.date_format("ts", "yyyy-MM-dd")), 4)


@query(
    "regularise_monthly_orders",
    f"""select 'all' as series, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as ts, {r('avg(o_totalprice)', 4)} as value from orders group by all""",
)
def regularise_monthly_orders(t):
    data = fc.series(t("orders"), "o_totalprice", "o_orderdate")
    return rounded(fc.regularise(data, "M").withColumn("ts", F.date_format("ts", "yyyy-MM-dd")), 4)


@query(
    "date_range_users",
    "select cast(user_id as varchar) as series, min(ts) as start, max(ts) as \"end\", count(*) as n from events group by user_id",
)
def date_range_users(t):
    return fc.date_range(user_series(t))


@query(
    "forecast_envelope",
    f"with {BASE}, x as (select series, min(value) as min, max(value) as max, stddev_pop(value) as std from s group by series) "
    f"select series, n, last as last_observed, {r('mean', 4)} as mean, {r('std', 4)} as std, min, max from base join x using (series) where n >= 3",
)
def forecast_envelope(t):
    return rounded(fc.envelope(user_series(t), TIES), 4)


@query("series_history", f"with {SERIES} select series, n - pos as back, ts, value from s where pos >= n - 100")
def series_history(t):
    return fc.history(user_series(t), TIES)


@query("series_anomalies_users")
def series_anomalies_users(t):
    return rounded(series_anomalies(user_series(t), 0.05, TIES)).drop("ts")


# -- governance -------------------------------------------------------------------------------------


@query(
    "mask_customers",
    """select c_custkey, case when length(c_name) <= 4 then '****' else left(c_name, 2) || '****' || right(c_name, 2) end as c_name, '******' as c_mktsegment,
         case when length(seg) <= 4 then '****' else left(seg, 2) || '****' || right(seg, 2) end as parts from (select *, left(c_mktsegment, 4 + c_nationkey % 4) as seg from customer)""",
)
def mask_customers(t):
    short = F.substring("c_mktsegment", F.lit(1), 4 + F.col("c_nationkey") % 4)
    df = t("customer").select("c_custkey", "c_name", "c_mktsegment", F.array(F.struct(short.alias("seg"))).alias("parts"))
    masked = govern.mask_columns(df, {"c_name": "confidential", "c_mktsegment": "restricted", "parts": "confidential", "c_custkey": "restricted"})
    return masked.withColumn("parts", F.col("parts")[0]["seg"])


@query("encrypt_round_trip", "select c_custkey, c_name, false as readable from customer")
def encrypt_round_trip(t):
    df = t("customer").select("c_custkey", "c_name")
    secret = govern.encrypt_columns(df, ["c_name"], "a test secret")
    opened = govern.decrypt_columns(secret.withColumn("cipher", F.col("c_name")), ["c_name"], "a test secret")
    return opened.select("c_custkey", "c_name", (F.col("cipher") == F.col("c_name")).alias("readable"))


@query("strip_characters_pages", "select page_id, regexp_replace(html, '[<>\"''&]', '', 'g') as cleaned from pages")
def strip_characters_pages(t):
    return t("pages").select("page_id", govern.strip_markup_characters(F.col("html")).alias("cleaned"))


def _strip_sql(text: str) -> str:
    for pattern in govern.SCRIPT_PATTERNS:
        text = f"regexp_replace({text}, '{pattern}', '', 'gis')"
    return text


@query("strip_scripts_pages", f"select page_id, {_strip_sql('html')} as cleaned from pages")
def strip_scripts_pages(t):
    return t("pages").select("page_id", govern.strip_scripts(F.col("html")).alias("cleaned"))


@query(
    "escape_html_documents",
    "select doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') as escaped from documents",
)
def escape_html_documents(t):
    return t("documents").select("doc_id", govern.escape_html(F.col("text")).alias("escaped"))


def audit_events(t) -> DataFrame:
    """events as audit records: severity by value, logins and uploads by type."""
    kind = F.col("event_type")
    v = F.col("value")
    return t("events").select(
        "ts",
        F.when(kind == "click", govern.FAILED_LOGIN).when(kind == "error", govern.REJECTED_UPLOAD).otherwise(kind).alias("event_type"),
        F.when(v > 50, "ERROR").when(v > 10, "WARNING").otherwise("INFO").alias("severity"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 50).cast("string")).alias("ip_address"),
        (v < 20).alias("success"),
    )


AUDIT = """audit as (select ts, case event_type when 'click' then 'authentication_attempt' when 'error' then 'file_upload_rejected' else event_type end as event_type,
    case when value > 50 then 'ERROR' when value > 10 then 'WARNING' else 'INFO' end as severity, '10.0.0.' || (user_id % 50) as ip_address, value < 20 as success from events)"""


@query(
    "audit_rollup_daily",
    f"with {AUDIT} select strftime(date_trunc('day', ts), '%Y-%m-%d') as window_start, event_type, severity, count(*) as n from audit group by all",
)
def audit_rollup_daily(t):
    return govern.audit_rollup(audit_events(t)).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query(
    "address_alerts",
    f"""with {AUDIT} select ip_address, count(*) filter (event_type = 'authentication_attempt' and not success) as failed_logins,
          count(*) filter (event_type = 'file_upload_rejected') as rejected_uploads from audit
        where (event_type = 'authentication_attempt' and not success) or event_type = 'file_upload_rejected' group by ip_address""",
)
def address_alerts(t):
    return govern.address_alerts(audit_events(t))


# -- sessions, logs, streams ------------------------------------------------------------------------

SESSIONS = """g as (select *, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 1 hour then 1 else 0 end as opens from events window w as (partition by user_id order by ts, event_id)),
  n as (select *, sum(opens) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from g)"""


@query(
    "sessions_batch",
    f"with {SESSIONS} select user_id, cast(session as bigint) as session, min(ts) as session_start, max(ts) as last_event, count(*) as n from n group by user_id, session",
)
def sessions_batch(t):
    return jobs.batch_sessions(t("events"), "user_id", "ts", 3600, ["event_id"])


@query(
    "sessions_window",
    f"with {SESSIONS} select user_id, min(ts) as session_start, max(ts) + interval 1 hour as session_end, count(*) as n from n group by user_id, session",
)
def sessions_window(t):
    found = jobs.activity_sessions(t("events"), "user_id", "ts", "1 hour")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query(
    "sessions_stateful_stream",
    f"with {SESSIONS} select user_id, min(ts) as session_start, max(ts) as last_event, count(*) as n from n group by user_id, session",
)
def sessions_stateful_stream(t):
    """Sessions of a stream of four files, with the state of each user's open sessions: the closed and the still open ones."""
    events, source, target, state = t("events").select("event_id", "user_id", "ts"), t.scratch("events"), t.scratch("sessions"), t.scratch("sessions-state")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = events.select(at.cast("double").alias("at")).approxQuantile("at", [0.25, 0.5, 0.75], 0.01)
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = events.filter((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high))
        part.coalesce(1).write.mode("append").parquet(source)
    stream = jobs.read_stream(t.spark, source, events.schema, max_files=1)
    jobs.store_sessions(stream, "user_id", "ts", target, state).awaitTermination()
    found = t.spark.read.parquet(target).unionByName(jobs.open_sessions(t.spark, state, "user_id"))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "last_event")})


@query("latest_runs_log", "select event_id, user_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_runs_log(t):
    return latest_runs(t("events"), "user_id", "ts").select("event_id", "user_id", "event_type", "value")


@query(
    "audit_rollup_stream",
    f"""with {AUDIT} select strftime(date_trunc('day', ts), '%Y-%m-%d') as window_start, event_type, severity, count(*) as n from audit
        where date_trunc('day', ts) + interval 1 day <= (select max(ts) - interval 1 hour from audit) group by all""",
)
def audit_rollup_stream(t):
    """The rollup as a stream over the stored audit records: windows the watermark has passed."""
    source, target = t.scratch("audit"), t.scratch("rollup")
    audit_events(t).write.parquet(source)
    schema = t.spark.read.parquet(source).schema
    stream = jobs.read_stream(t.spark, source, schema)
    job = jobs.audit_stream(stream).writeStream.format("parquet").outputMode("append").option("path", target)
    job.option("checkpointLocation", t.scratch("rollup-state")).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(target).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query(
    "running_profile_stream",
    " union all ".join(
        f"select '{c}' as column, count({c}) as count, cast(0 as bigint) as null_count, {r(f'avg({c})', 3)} as mean, {r(f'stddev_samp({c})', 3)} as std, "
        f"min({c})::double as min, max({c})::double as max from orders"
        for c in ("o_totalprice", "o_custkey")
    ),
)
def running_profile_stream(t):
    source, state = t.scratch("orders"), t.scratch("profile")
    t("orders").select("o_totalprice", "o_custkey").repartition(4).write.parquet(source)
    stream = jobs.read_stream(t.spark, source, "o_totalprice double, o_custkey bigint", max_files=1)
    jobs.profile_stream(stream, state, t.scratch("profile-state")).awaitTermination()
    return rounded(jobs.running_profile(t.spark, state), 3)
