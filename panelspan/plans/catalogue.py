"""The panel engine's queries over the driver's tables, each beside the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspan.functions import flags as X
from panelspan.functions import scalars as M
from panelspan.functions import timeutil as T
from panelspan.operators import cleaning as C
from panelspan.operators import events as E
from panelspan.operators import geometry as G
from panelspan.operators import lookup as L
from panelspan.operators import metrics as K
from panelspan.operators import panel as P
from panelspan.operators import policy as Y
from panelspan.operators import reshape as R
from panelspan.operators import windows as W
from panelspan.plans import views as V
from panelspan.plans.views import ELIGIBLE_SQL, FORECAST, HISTORY, HOURLY, INTERVALS_SQL, READINGS_SQL, SUMMARY_SQL, WINDOWS_SQL, at, panel_sql, tidy, windows_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# panels (means of a few readings can lie on a rounding edge; 1e-7 moves them off it in both engines)


@query(panel_sql() + f" SELECT dataset, turbine_id, {at('timestamp')} AS timestamp, target_kw, is_observed, quality_flags FROM panel")
def panel_grid_fill(spark, sf):
    return V.panel(spark, sf).select("dataset", "turbine_id", "timestamp", "target_kw", "is_observed", "quality_flags")


@query(panel_sql(entity="user_id % 8", layout="entity") + f" SELECT dataset, turbine_id, {at('timestamp')} AS timestamp, target_kw, is_observed, quality_flags FROM panel")
def panel_grid_entity(spark, sf):
    return V.panel(spark, sf, entity="user_id % 8", layout="entity").select("dataset", "turbine_id", "timestamp", "target_kw", "is_observed", "quality_flags")


@query(
    panel_sql()
    + f""", n AS (SELECT timestamp, sum(is_observed::INT)::BIGINT AS o, count(target_kw) AS t FROM panel GROUP BY 1)
  SELECT turbine_id, {at('p.timestamp')} AS timestamp, 5::BIGINT AS farm_turbines_expected, o AS farm_turbines_observed, t AS farm_turbines_with_target,
  o = 5 AS farm_is_fully_synchronous, t = 5 AS farm_has_all_targets FROM panel AS p JOIN n ON n.timestamp = p.timestamp"""
)
def farm_sync(spark, sf):
    return P.with_farm_sync(V.panel(spark, sf), 5).select("turbine_id", "timestamp", "farm_turbines_expected", "farm_turbines_observed", "farm_turbines_with_target", "farm_is_fully_synchronous", "farm_has_all_targets")


@query(
    panel_sql()
    + SUMMARY_SQL
    + f""" SELECT 'events' AS dataset, count(*) AS timestamp_count, count(*) FILTER (WHERE observed = 5) AS synchronous_count, count(*) FILTER (WHERE with_target = 5) AS full_target_count,
  round(count(*) FILTER (WHERE observed = 5) / count(*), 6) AS synchronous_ratio, round(count(*) FILTER (WHERE with_target = 5) / count(*), 6) AS full_target_ratio,
  {at('min(timestamp) FILTER (WHERE observed = 5)')} AS first_synchronous, {at('max(timestamp) FILTER (WHERE observed = 5)')} AS last_synchronous,
  {at('min(timestamp) FILTER (WHERE with_target = 5)')} AS first_full_target, {at('max(timestamp) FILTER (WHERE with_target = 5)')} AS last_full_target FROM summary"""
)
def coverage_overall(spark, sf):
    return P.coverage_overall(V.panel(spark, sf), 5)


@query(
    panel_sql()
    + f""" SELECT dataset, turbine_id, count(*) AS row_count, count(*) FILTER (WHERE is_observed) AS observed_count, count(target_kw) AS target_count,
  round(count(*) FILTER (WHERE is_observed) / count(*), 6) AS observed_ratio, round(count(target_kw) / count(*), 6) AS target_ratio,
  {at('min(timestamp) FILTER (WHERE is_observed)')} AS first_observed, {at('max(timestamp) FILTER (WHERE is_observed)')} AS last_observed FROM panel GROUP BY 1, 2"""
)
def coverage_entity(spark, sf):
    return P.coverage_entity(V.panel(spark, sf))


@query(
    panel_sql()
    + """ SELECT dataset, count(*) AS row_count, count(*) FILTER (WHERE NOT is_observed) AS missing_row_count, count(*) FILTER (WHERE target_kw IS NULL) AS missing_target_count,
  count(*) FILTER (WHERE quality_flags <> '') AS flagged_row_count, count(*) - count(DISTINCT (turbine_id, timestamp)) AS duplicate_key_count FROM panel GROUP BY 1"""
)
def quality_totals(spark, sf):
    return P.quality_totals(V.panel(spark, sf))


_DELTAS = panel_sql() + ", d AS (SELECT dataset, turbine_id, timestamp, lag(timestamp) OVER (PARTITION BY turbine_id ORDER BY timestamp) AS previous FROM panel WHERE is_observed), e AS (SELECT *, date_diff('minute', previous, timestamp) AS delta_minutes FROM d WHERE previous IS NOT NULL)"


@query(_DELTAS + " SELECT dataset, delta_minutes, count(*) AS delta_count FROM e GROUP BY 1, 2")
def interval_histogram(spark, sf):
    return P.interval_histogram(V.panel(spark, sf))


@query(_DELTAS + f" SELECT dataset, turbine_id, {at('previous')} AS previous, {at('timestamp')} AS timestamp, delta_minutes FROM e WHERE delta_minutes > 60")
def long_gaps(spark, sf):
    return P.long_gaps(V.panel(spark, sf), HOURLY)


@query(
    panel_sql()
    + f""" SELECT dataset, {at('timestamp')} AS timestamp, count(*) FILTER (WHERE target_kw IS NULL OR NOT is_observed OR quality_flags <> '') AS target_issue_count, 0::BIGINT AS feature_issue_count,
  count(*) FILTER (WHERE target_kw > 60) AS masked_count, count(*) FILTER (WHERE target_kw IS NULL OR NOT is_observed OR quality_flags <> '') > 0 AS has_target_issue, false AS has_feature_issue, count(*) FILTER (WHERE target_kw > 60) > 0 AS has_masked FROM panel GROUP BY 1, 2"""
)
def farm_status(spark, sf):
    return P.farm_status(V.panel(spark, sf).withColumn("high", (F.col("target_kw") > 60).cast("int")), ("high",))


@query(
    panel_sql()
    + f""", site AS (SELECT timestamp, avg(target_kw) AS site_kw, count(*) FILTER (WHERE target_kw > 60) AS high_count, bool_or(target_kw > 60) AS any_high FROM obs WHERE turbine_id <> 'click' GROUP BY 1)
  SELECT turbine_id, {at('p.timestamp')} AS timestamp, round(site_kw + 1e-7, 3) AS site_kw, coalesce(high_count, 0) AS high_count, coalesce(any_high, false) AS any_high FROM panel AS p LEFT JOIN site AS s ON s.timestamp = p.timestamp"""
)
def site_attach(spark, sf):
    obs = V.observations(spark, sf).filter("turbine_id <> 'click'")
    site = obs.groupBy("dataset", "timestamp").agg(F.round(F.avg("target_kw") + 1e-7, 3).alias("site_kw"), F.count_if(F.col("target_kw") > 60).alias("high_count"), F.max(F.col("target_kw") > 60).alias("any_high"))
    return P.attach_site_series(V.panel(spark, sf), site).select("turbine_id", "timestamp", "site_kw", "high_count", "any_high")


# windows


@query(
    panel_sql()
    + SUMMARY_SQL
    + WINDOWS_SQL
    + f""" SELECT 'events' AS dataset, window_id, {at('input_start_ts')} AS input_start_ts, {at('input_end_ts')} AS input_end_ts, {at('output_start_ts')} AS output_start_ts, {at('output_end_ts')} AS output_end_ts,
  {HISTORY}::BIGINT AS input_steps_expected, {FORECAST}::BIGINT AS output_steps_expected, array_to_string(io, ',') AS input_observed, array_to_string(oo, ',') AS output_observed,
  array_to_string(it, ',') AS input_with_target, array_to_string(ot, ',') AS output_with_target,
  array_to_string(list_transform(io, lambda x: 0), ',') AS input_masked, array_to_string(list_transform(oo, lambda x: 0), ',') AS output_masked,
  array_to_string(list_transform(io, lambda x: 0), ',') AS input_unknown, array_to_string(list_transform(oo, lambda x: 0), ',') AS output_unknown,
  array_to_string(list_transform(io, lambda x: 0), ',') AS input_abnormal, array_to_string(list_transform(oo, lambda x: 0), ',') AS output_abnormal,
  mio::BIGINT AS min_input_observed, mot::BIGINT AS min_output_with_target, ci AS is_complete_input, co AS is_complete_output, si AS is_fully_synchronous_input, so AS is_fully_synchronous_output,
  flags AS quality_flags, '' AS feature_quality_flags FROM windows"""
)
def farm_windows(spark, sf):
    return W.farm_windows(P.farm_summary(V.panel(spark, sf), 5), HISTORY, FORECAST)


@query(
    panel_sql()
    + SUMMARY_SQL
    + WINDOWS_SQL
    + """ SELECT 'events' AS dataset, count(*) AS window_count, count(*) FILTER (WHERE ci) AS complete_input, count(*) FILTER (WHERE co) AS complete_output, count(*) FILTER (WHERE si) AS fully_synchronous_input,
  count(*) FILTER (WHERE so) AS fully_synchronous_output, count(*) AS unmasked_input, count(*) AS unmasked_output, 0::BIGINT AS masked_input, 0::BIGINT AS masked_output,
  count(*) FILTER (WHERE si AND so) AS fully_synchronous, count(*) FILTER (WHERE co) AS fully_synchronous_and_unmasked_output, count(*) FILTER (WHERE si AND so) AS fully_synchronous_and_unmasked_all FROM windows"""
)
def farm_window_report(spark, sf):
    return W.farm_window_report(W.farm_windows(P.farm_summary(V.panel(spark, sf), 5), HISTORY, FORECAST))


@query(
    panel_sql()
    + f""", x AS (SELECT *, row_number() OVER (PARTITION BY turbine_id ORDER BY timestamp) - 1 AS i, count(*) OVER (PARTITION BY turbine_id) AS n,
    first(timestamp) OVER h AS a, last(timestamp) OVER h AS b, first(timestamp) OVER f AS c, last(timestamp) OVER f AS d, sum(is_observed::INT) OVER h AS ho, count(target_kw) OVER h AS ht, sum(is_observed::INT) OVER f AS fo, count(target_kw) OVER f AS ft,
    greatest(max((quality_flags <> '')::INT) OVER h, max((quality_flags <> '')::INT) OVER f) AS fl FROM panel
  WINDOW h AS (PARTITION BY turbine_id ORDER BY timestamp ROWS BETWEEN {HISTORY - 1} PRECEDING AND CURRENT ROW), f AS (PARTITION BY turbine_id ORDER BY timestamp ROWS BETWEEN 1 FOLLOWING AND {FORECAST} FOLLOWING))
  SELECT dataset, turbine_id, {at('a')} AS input_start_ts, {at('b')} AS input_end_ts, ho::BIGINT AS input_observed_steps, ht AS input_target_steps, {at('c')} AS output_start_ts, {at('d')} AS output_end_ts, fo::BIGINT AS output_observed_steps, ft AS output_target_steps,
  ht = {HISTORY} AS is_complete_input, ft = {FORECAST} AS is_complete_output, concat_ws('|', CASE WHEN ht <> {HISTORY} THEN 'partial_input' END, CASE WHEN ft <> {FORECAST} THEN 'partial_output' END, CASE WHEN fl > 0 THEN 'row_quality_issues' END) AS window_flags
  FROM x WHERE i >= {HISTORY - 1} AND i <= n - {FORECAST} - 1"""
)
def entity_windows(spark, sf):
    return W.entity_windows(V.panel(spark, sf), HISTORY, FORECAST)


@query(panel_sql(1440) + SUMMARY_SQL + windows_sql(5, 2) + f" SELECT window_id, {at('output_start_ts')} AS output_start_ts FROM windows WHERE ci AND co AND si AND so AND fl = 0")
def strict_windows(spark, sf):
    return W.strict_windows(W.farm_windows(P.farm_summary(V.panel(spark, sf, 1440), 5), 5, 2)).select("window_id", "output_start_ts")


@query(panel_sql() + ELIGIBLE_SQL + " SELECT turbine_id, count(*) AS eligible_count, round(sum(predicted), 6) AS anchor_sum FROM anchors GROUP BY 1")
def clean_window_eligibility(spark, sf):
    return W.eligible_anchors(V.panel(spark, sf), HISTORY, FORECAST).groupBy("turbine_id").agg(F.count("*").alias("eligible_count"), F.sum("anchor_value").alias("anchor_sum"))


@query(
    panel_sql()
    + f", v AS (SELECT timestamp, count(target_kw) AS v FROM panel GROUP BY 1), s AS (SELECT timestamp, sum(v) OVER (ORDER BY timestamp ROWS BETWEEN 1 FOLLOWING AND {FORECAST} FOLLOWING) AS valid_targets FROM v) SELECT 'events' AS dataset, {at('timestamp')} AS timestamp, valid_targets::BIGINT AS valid_targets FROM s WHERE valid_targets > 0"
)
def valid_target_windows(spark, sf):
    return W.valid_target_windows(V.panel(spark, sf), FORECAST)


_SPLIT_SQL = ", a AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT timestamp FROM panel)), sp AS (SELECT timestamp, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * 0.7::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM a), bo AS (SELECT split, min(timestamp) AS start_ts, max(timestamp) AS end_ts, count(*) AS n_steps FROM sp GROUP BY 1)"


@query(panel_sql() + _SPLIT_SQL + f" SELECT 'events' AS dataset, split, {at('start_ts')} AS start_ts, {at('end_ts')} AS end_ts, n_steps FROM bo")
def chrono_split(spark, sf):
    return W.split_bounds(V.panel(spark, sf))


def _split(spark, sf):
    panel = V.panel(spark, sf)
    return W.split_windows(W.farm_windows(P.farm_summary(panel, 5), HISTORY, FORECAST), W.split_bounds(panel))


_IN_SPLIT = panel_sql() + SUMMARY_SQL + WINDOWS_SQL + _SPLIT_SQL + ", sw AS (SELECT w.*, split FROM windows AS w JOIN bo ON input_start_ts >= start_ts AND output_end_ts <= end_ts)"


@query(_IN_SPLIT + f" SELECT window_id, split, {at('output_start_ts')} AS output_start_ts FROM sw")
def split_windows(spark, sf):
    return _split(spark, sf).select("window_id", "split", "output_start_ts")


@query(_IN_SPLIT + f", r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY output_start_ts) - 1 AS p FROM sw) SELECT window_id, split, {at('output_start_ts')} AS output_start_ts FROM r WHERE p % {FORECAST} = 0")
def thin_windows(spark, sf):
    return W.thin(_split(spark, sf), FORECAST, ("dataset", "split")).select("window_id", "split", "output_start_ts")


@query(_IN_SPLIT + f", r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY output_start_ts) AS p FROM sw) SELECT window_id, split FROM r WHERE split <> 'train' OR p <= 20")
def first_windows(spark, sf):
    return W.first_per_split(_split(spark, sf), {"train": 20}).select("window_id", "split")


@query(_IN_SPLIT + f" SELECT {at('output_start_ts')} AS output_start_ts, {at('output_end_ts')} AS output_end_ts FROM sw WHERE split = 'train' AND window_id % 3 = 0 AND window_id % 2 = 0")
def align_windows(spark, sf):
    train = _split(spark, sf).filter("split = 'train'")
    return W.align([train.filter("window_id % 3 = 0"), train.filter("window_id % 2 = 0")])


@query(_IN_SPLIT + f", t AS (SELECT DISTINCT output_start_ts AS ts FROM sw WHERE split = 'val') SELECT DISTINCT 'events' AS dataset, {at('a.timestamp')} AS timestamp FROM a JOIN t ON a.timestamp < t.ts AND a.timestamp >= t.ts - INTERVAL '{HISTORY} hours'")
def history_rows(spark, sf):
    return W.history_rows(V.panel(spark, sf), _split(spark, sf).filter("split = 'val'"), HISTORY)


@query(
    panel_sql()
    + f" SELECT dataset, turbine_id, {at('timestamp')} AS timestamp, coalesce(last_value(target_kw IGNORE NULLS) OVER (PARTITION BY turbine_id ORDER BY timestamp ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0.5) AS last_valid FROM panel"
)
def persistence_last_valid(spark, sf):
    panel = V.panel(spark, sf)
    return W.last_valid(panel, 3, V.observations(spark, sf).select("turbine_id").distinct().withColumn("fallback", F.lit(0.5)))


@query(
    panel_sql()
    + f""", r AS (SELECT *, row_number() OVER (PARTITION BY turbine_id ORDER BY timestamp) AS rn FROM panel), s AS (SELECT *, last_value(CASE WHEN target_kw IS NOT NULL THEN rn END IGNORE NULLS) OVER (PARTITION BY turbine_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS lv FROM r)
  SELECT dataset, turbine_id, {at('timestamp')} AS timestamp, round(least(coalesce(rn - lv, 72), 72) / 72, 6) AS since_valid FROM s"""
)
def steps_since_valid(spark, sf):
    return W.steps_since_valid(V.panel(spark, sf))


@query(panel_sql() + f" SELECT 'events' AS dataset, {at('timestamp')} AS timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS step FROM (SELECT DISTINCT timestamp FROM panel)")
def panel_ordinals(spark, sf):
    return W.panel_ordinals(V.panel(spark, sf))


# errors


def _predictions(spark, sf):
    return K.persistence_predictions(W.eligible_anchors(V.panel(spark, sf), HISTORY, FORECAST))


_ERR = "count(*) AS prediction_count, round(avg(abs(predicted - actual)), 6) AS mae, round(sqrt(avg((predicted - actual) ** 2)), 6) AS rmse"
_ERR_PU = _ERR + ", round(avg(abs(predicted - actual) / 100), 6) AS mae_pu, round(sqrt(avg(((predicted - actual) / 100) ** 2)), 6) AS rmse_pu"


@query(panel_sql() + ELIGIBLE_SQL + f" SELECT 'events' AS dataset, {_ERR_PU} FROM predictions GROUP BY 1")
def persistence_summary(spark, sf):
    return K.errors(_predictions(spark, sf), ["dataset"], F.lit(100.0))


@query(panel_sql() + ELIGIBLE_SQL + f" SELECT horizon, {_ERR} FROM predictions GROUP BY 1")
def persistence_horizon(spark, sf):
    return K.errors(_predictions(spark, sf), ["horizon"])


@query(panel_sql() + ELIGIBLE_SQL + f" SELECT turbine_id, {_ERR} FROM predictions GROUP BY 1")
def persistence_entity(spark, sf):
    return K.errors(_predictions(spark, sf), ["turbine_id"])


@query(
    panel_sql()
    + ELIGIBLE_SQL
    + f""" SELECT dataset, horizon, turbine_id, CASE WHEN g = 3 THEN 'overall' WHEN g = 1 THEN 'horizon' ELSE 'entity' END AS scope, prediction_count, mae, rmse FROM (
  SELECT dataset, horizon, turbine_id, grouping(horizon) * 2 + grouping(turbine_id) AS g, {_ERR} FROM (SELECT 'events' AS dataset, * FROM predictions) GROUP BY GROUPING SETS ((dataset), (dataset, horizon), (dataset, turbine_id)))"""
)
def metrics_rollup(spark, sf):
    return K.metrics_rollup(_predictions(spark, sf))


@query(panel_sql() + ELIGIBLE_SQL + f" SELECT turbine_id, 'overall' AS scope, NULL::BIGINT AS lead, {_ERR} FROM predictions GROUP BY 1 UNION ALL SELECT turbine_id, 'horizon', horizon, {_ERR} FROM predictions GROUP BY 1, 3")
def metric_rows(spark, sf):
    return K.metric_rows(_predictions(spark, sf), ["turbine_id"])


@query(panel_sql() + ELIGIBLE_SQL + f", l AS (SELECT horizon, avg(abs(predicted - actual)) AS mae, sqrt(avg((predicted - actual) ** 2)) AS rmse FROM predictions GROUP BY 1) SELECT 'events' AS dataset, CASE WHEN horizon <= 3 THEN '1-3' ELSE '4-6' END AS bucket, round(avg(mae), 6) AS mae, round(avg(rmse), 6) AS rmse, count(*) AS leads FROM l GROUP BY 2")
def lead_buckets(spark, sf):
    return K.lead_buckets(K.errors(_predictions(spark, sf), ["dataset", "horizon"]), ["dataset"], ((1, 3), (4, 6)))


@query(
    panel_sql()
    + ELIGIBLE_SQL
    + """, r AS (SELECT 2 AS scale, predicted - lag(predicted, 2) OVER w AS p, actual - lag(actual, 2) OVER w AS a FROM predictions WINDOW w AS (PARTITION BY turbine_id, anchor_ts ORDER BY horizon)
    UNION ALL SELECT 3, predicted - lag(predicted, 3) OVER w, actual - lag(actual, 3) OVER w FROM predictions WINDOW w AS (PARTITION BY turbine_id, anchor_ts ORDER BY horizon))
  SELECT scale::BIGINT AS scale, count(*) AS pair_count, round(avg(abs(p - a)), 6) AS ramp_mae, round(sqrt(avg((p - a) ** 2)), 6) AS ramp_rmse, round(avg((sign(p) = sign(a))::INT), 6) AS sign_agreement FROM r WHERE p IS NOT NULL AND a IS NOT NULL GROUP BY 1"""
)
def ramp_metrics(spark, sf):
    steps = _predictions(spark, sf).select(F.col("anchor_ts").alias("window_id"), "turbine_id", F.col("horizon").alias("step"), "actual", "predicted")
    return K.ramp_errors(steps, (2, 3))


@query(panel_sql() + ELIGIBLE_SQL + " SELECT horizon, round(quantile_cont(abs(predicted - actual), 0.05), 6) AS q05, round(quantile_cont(abs(predicted - actual), 0.5), 6) AS q50, round(quantile_cont(abs(predicted - actual), 0.95), 6) AS q95, round(avg(abs(predicted - actual)), 6) AS mean, round(avg((abs(predicted - actual) < 1e-6)::INT), 6) AS near_zero_share FROM predictions GROUP BY 1")
def quantile_diag(spark, sf):
    return K.quantile_diagnostics(_predictions(spark, sf).withColumn("e", F.abs(F.col("predicted") - F.col("actual"))), ["horizon"], "e")


@query(
    panel_sql()
    + ELIGIBLE_SQL
    + """ SELECT horizon, count(*) AS prediction_count, round(avg((least(predicted * 1.1, 60) <= 0 OR least(predicted * 1.1, 60) >= 60)::INT), 6) AS clamp_rate, round(avg(abs(predicted - actual)), 6) AS anchor_mae, round(sqrt(avg((predicted - actual) ** 2)), 6) AS anchor_rmse,
  round(avg(abs(least(predicted * 1.1, 60) - actual)), 6) AS final_mae, round(sqrt(avg((least(predicted * 1.1, 60) - actual) ** 2)), 6) AS final_rmse, round(avg(abs(least(predicted * 1.1, 60) - predicted)), 6) AS mean_shift FROM predictions GROUP BY 1"""
)
def diagnostic_rates(spark, sf):
    rows = _predictions(spark, sf).withColumn("anchor", F.col("predicted")).withColumn("predicted", F.least(F.col("predicted") * 1.1, F.lit(60.0)))
    return K.diagnostic_rates(rows, ["horizon"], 0.0, 60.0)


@query(panel_sql() + ELIGIBLE_SQL + " SELECT turbine_id, count(*) AS valid_count, round(avg(CASE WHEN abs(predicted - actual) <= 5 THEN 0.5 * (predicted - actual) ** 2 / 5 ELSE abs(predicted - actual) - 2.5 END), 6) AS huber, round(avg((predicted - actual) ** 2), 6) AS mse FROM predictions WHERE horizon <> 2 GROUP BY 1")
def masked_losses(spark, sf):
    return K.masked_losses(_predictions(spark, sf).withColumn("valid", F.col("horizon") != 2), ["turbine_id"], 5.0)


@query(panel_sql() + _SPLIT_SQL + " SELECT turbine_id, round(avg(target_kw), 6) AS mean, round(CASE WHEN stddev_pop(target_kw) > 0 THEN stddev_pop(target_kw) ELSE 1 END, 6) AS std FROM panel JOIN sp USING (timestamp) WHERE split = 'train' GROUP BY 1")
def train_stats(spark, sf):
    panel = V.panel(spark, sf)
    train = W.split_bounds(panel).filter("split = 'train'").select("dataset", "start_ts", "end_ts")  # one row a dataset
    return K.train_stats(panel.join(F.broadcast(train), "dataset").filter("timestamp BETWEEN start_ts AND end_ts"), ["turbine_id"], "target_kw")


@query(panel_sql() + f", s AS (SELECT turbine_id, avg(target_kw) AS m, stddev_pop(target_kw) AS d FROM panel GROUP BY 1) SELECT turbine_id, {at('timestamp')} AS timestamp, round(coalesce((target_kw - m) / CASE WHEN d > 0 THEN d ELSE 1 END, 0), 6) AS z, round(CASE WHEN target_kw IS NOT NULL THEN ln(1 + greatest(target_kw, 0)) END, 6) AS lg, round(CASE WHEN target_kw IS NOT NULL THEN least(greatest(target_kw, 0), 60) / 60 END, 6) AS pu FROM panel JOIN s USING (turbine_id)")
def zscore(spark, sf):
    panel = V.panel(spark, sf)
    stats = K.train_stats(panel, ["turbine_id"], "target_kw")
    return panel.join(stats, "turbine_id").select("turbine_id", "timestamp", M.zscore("target_kw", F.col("mean"), F.col("std")).alias("z"), M.log_count("target_kw").alias("lg"), M.per_unit("target_kw", F.lit(60.0)).alias("pu"))


@query(
    panel_sql()
    + """, w AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) AS weight FROM (SELECT DISTINCT timestamp FROM panel))
  SELECT 'events' AS dataset, turbine_id, round(sum(target_kw * weight) / sum(weight), 6) AS fallback FROM panel JOIN w USING (timestamp) WHERE target_kw IS NOT NULL GROUP BY 2"""
)
def weighted_history_mean(spark, sf):
    panel = V.panel(spark, sf)
    return K.weighted_history_mean(panel, W.panel_ordinals(panel).select("dataset", "timestamp", (F.col("step") + 1).alias("weight")))


@query(
    panel_sql()
    + f""", s AS (SELECT timestamp, coalesce(sum(target_kw), 0) / greatest(count(target_kw), 1) AS a, coalesce(sum(cos(target_kw * 0.017453292519943295)), 0) / greatest(count(target_kw), 1) AS c, coalesce(sum(sin(target_kw * 0.017453292519943295)), 0) / greatest(count(target_kw), 1) AS d, count(target_kw) / count(*) AS v FROM panel GROUP BY 1)
  SELECT 'events' AS dataset, {at('timestamp')} AS timestamp, round(a + 1e-7, 3) AS mean_speed, round(c, 6) AS mean_cos, round(d, 6) AS mean_sin, round(v, 6) AS speed_availability, round(v, 6) AS direction_availability, round(sqrt(c * c + d * d), 6) AS resultant FROM s"""
)
def site_summary(spark, sf):
    return K.site_summary(V.panel(spark, sf), "target_kw", "target_kw").withColumn("mean_speed", F.round(F.col("mean_speed") + 1e-7, 3))


# duplicates

_PRESENT = "CASE WHEN {c} IS NOT NULL AND trim({c}::VARCHAR) <> '' THEN {c} END"
_CELLS = ("quantity", "discount", "l_returnflag", "linestatus")


@query(
    READINGS_SQL
    + """, f AS (SELECT *, (quantity IS NOT NULL)::INT + (discount IS NOT NULL)::INT + 2 AS filled FROM readings), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY filled DESC, row_order) AS k FROM f)
  SELECT l_partkey, l_suppkey, arg_min(quantity, k) AS quantity, arg_min(discount, k) FILTER (WHERE discount IS NOT NULL) AS discount, arg_min(l_returnflag, k) AS l_returnflag, arg_min(linestatus, k) AS linestatus,
  ((count(DISTINCT quantity) > 1)::INT + (count(DISTINCT discount) > 1)::INT + (count(DISTINCT l_returnflag) > 1)::INT + (count(DISTINCT linestatus) > 1)::INT)::BIGINT AS row_conflict_count, count(*) AS source_row_count FROM r GROUP BY 1, 2"""
)
def merge_best_value(spark, sf):
    return C.merge_best_value(V.readings(spark, sf), ["l_partkey", "l_suppkey"], list(_CELLS), "row_order")


@query(
    READINGS_SQL
    + """, f AS (SELECT *, (discount IS NOT NULL)::INT AS filled FROM readings), c AS (
    SELECT l_partkey, l_suppkey, 'quantity' AS column_name, quantity::VARCHAR AS value, filled, row_order FROM f UNION ALL SELECT l_partkey, l_suppkey, 'discount', discount::VARCHAR, filled, row_order FROM f
    UNION ALL SELECT l_partkey, l_suppkey, 'l_returnflag', l_returnflag, filled, row_order FROM f UNION ALL SELECT l_partkey, l_suppkey, 'linestatus', trim(linestatus), filled, row_order FROM f),
  r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey, column_name ORDER BY filled DESC, row_order) AS k FROM c WHERE value IS NOT NULL),
  v AS (SELECT l_partkey, l_suppkey, column_name, arg_min(value, k) AS kept_value, list_distinct(list(value)) AS vs FROM r GROUP BY 1, 2, 3)
  SELECT l_partkey, l_suppkey, column_name, kept_value, other_value FROM (SELECT *, unnest(vs) AS other_value FROM v) WHERE other_value <> kept_value"""
)
def merge_conflicts(spark, sf):
    return C.merge_conflicts(V.readings(spark, sf), ["l_partkey", "l_suppkey"], list(_CELLS), "row_order")


_RESOLVE_SQL = (
    READINGS_SQL
    + """, g AS (SELECT l_partkey, l_suppkey, count(*) AS duplicate_count, arg_min(quantity, row_order) AS q, arg_min({'v': discount}, row_order).v AS d, arg_min(l_returnflag, row_order) AS rf, arg_min(linestatus, row_order) AS ls,
    count(DISTINCT quantity) > 1 AS xq, count(DISTINCT discount) > 1 AS xd, count(DISTINCT l_returnflag) > 1 AS xr, count(DISTINCT trim(linestatus)) > 1 AS xl,
    count(DISTINCT discount) + max((discount IS NULL)::INT) > 1 AS rd FROM readings GROUP BY 1, 2),
  resolved AS (SELECT l_partkey, l_suppkey, CASE WHEN NOT xq THEN q END AS quantity, CASE WHEN NOT xd THEN d END AS discount, CASE WHEN NOT xr THEN rf END AS l_returnflag, CASE WHEN NOT xl THEN ls END AS linestatus, duplicate_count,
    CASE WHEN duplicate_count = 1 THEN NULL WHEN xq OR xd OR xr OR xl THEN 'conflict' WHEN rd AND NOT xd THEN 'normalized_equal' ELSE 'identical' END AS duplicate_kind,
    concat_ws(',', CASE WHEN xq THEN 'quantity' END, CASE WHEN xd THEN 'discount' END, CASE WHEN xr THEN 'l_returnflag' END, CASE WHEN xl THEN 'linestatus' END) AS conflict_columns, CASE WHEN rd AND NOT xd THEN 'discount' ELSE '' END AS normalized_columns FROM g)"""
)


def _resolved(spark, sf):
    return C.resolve_duplicates(V.readings(spark, sf), ["l_partkey", "l_suppkey"], list(_CELLS), ["row_order"])


@query(_RESOLVE_SQL + " SELECT * FROM resolved")
def dedupe_resolve(spark, sf):
    return _resolved(spark, sf)


@query(_RESOLVE_SQL + " SELECT 'readings' AS source_table, duplicate_kind, count(*) AS key_count, sum(duplicate_count)::BIGINT AS row_count FROM resolved WHERE duplicate_count > 1 GROUP BY 2")
def dedupe_audit(spark, sf):
    return C.duplicate_report(C.duplicate_audit(_resolved(spark, sf), ["l_partkey", "l_suppkey"], "readings"))


@query(_RESOLVE_SQL + " SELECT l_suppkey, 'feature_source_conflict__grid' AS flags, string_agg(DISTINCT c, ',' ORDER BY c) AS conflict_columns FROM (SELECT l_suppkey, unnest(string_split(conflict_columns, ',')) AS c FROM resolved WHERE duplicate_kind = 'conflict') GROUP BY 1")
def dedupe_effects(spark, sf):
    audit = C.duplicate_audit(_resolved(spark, sf), ["l_partkey", "l_suppkey"], "readings")
    out = C.aggregate_effects(C.duplicate_effects(audit, "feature", "grid"), ["l_suppkey"], "l_partkey")
    return out.select("l_suppkey", "flags", F.array_sort("conflict_columns").alias("conflict_columns"))


@query(READINGS_SQL + ", c AS (SELECT *, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS n FROM readings) SELECT n > 1 AS duplicated, count(*) AS row_count, sum(quantity)::BIGINT AS quantity FROM c GROUP BY 1")
def duplicate_split(spark, sf):
    twice, once = C.split_on_duplicates(V.readings(spark, sf), ["l_partkey", "l_suppkey"])
    both = twice.withColumn("duplicated", F.lit(True)).unionByName(once.withColumn("duplicated", F.lit(False)))
    return both.groupBy("duplicated").agg(F.count("*").alias("row_count"), F.sum("quantity").alias("quantity"))


@query(READINGS_SQL + " SELECT l_partkey, min(row_order) AS row_order, arg_min(quantity, row_order) AS quantity FROM readings GROUP BY 1")
def first_per_key(spark, sf):
    return C.first_per_key(V.readings(spark, sf), ["l_partkey"], ["row_order"]).select("l_partkey", "row_order", "quantity")


# events

_COVER_SQL = (
    INTERVALS_SQL
    + """, b AS (SELECT *, unnest(generate_series(time_bucket(INTERVAL '60 minutes', start_ts) + INTERVAL '60 minutes', time_bucket(INTERVAL '60 minutes', effective_end - INTERVAL '1 microsecond') + INTERVAL '60 minutes', INTERVAL '60 minutes')) AS t FROM ev),
  c AS (SELECT *, greatest(0, date_diff('second', greatest(start_ts, t - INTERVAL '60 minutes'), least(effective_end, t))) AS ov FROM b WHERE t > start_ts AND t < effective_end + INTERVAL '60 minutes'),
  h AS (SELECT key, t, count(*) AS n, sum(ov) AS ov, bool_or(status = 'error') AS stop, bool_or(status = 'click') AS v1, bool_or(status = 'view') AS v2 FROM c GROUP BY 1, 2),
  g AS (SELECT key, unnest(generate_series(time_bucket(INTERVAL '60 minutes', min(start_ts)), time_bucket(INTERVAL '60 minutes', max(effective_end) - INTERVAL '1 microsecond') + INTERVAL '60 minutes', INTERVAL '60 minutes')) AS t FROM ev GROUP BY 1)"""
)


@query(_COVER_SQL + f" SELECT g.key, {at('g.t')} AS timestamp, coalesce(n, 0) > 0 AS evt_any_active, coalesce(n, 0)::BIGINT AS evt_active_count, coalesce(ov, 0)::BIGINT AS evt_total_overlap_seconds, coalesce(stop, false) AS evt_stop, coalesce(v1, false) AS evt_status__click FROM g LEFT JOIN h ON h.key = g.key AND h.t = g.t")
def event_interval_features(spark, sf):
    out = E.event_features(V.intervals(spark, sf), ["key"], HOURLY, categorical={"status": "evt_status"}, aliases={"error": "stop"})
    return out.select("key", "timestamp", "evt_any_active", "evt_active_count", "evt_total_overlap_seconds", "evt_stop", "evt_status__click")


@query(INTERVALS_SQL + f" SELECT key, event_id, {at('effective_end')} AS effective_end FROM ev")
def event_next_start(spark, sf):
    return E.effective_ends(V.intervals(spark, sf), ["key"], HOURLY).select("key", "event_id", "effective_end")


@query(
    INTERVALS_SQL
    + f""", m AS (SELECT key, time_bucket(INTERVAL '60 minutes', start_ts) + INTERVAL '60 minutes' AS t, 1 AS d FROM ev UNION ALL SELECT key, time_bucket(INTERVAL '60 minutes', effective_end - INTERVAL '1 microsecond') + INTERVAL '120 minutes', -1 FROM ev),
  s AS (SELECT key, t, sum(d) AS d FROM m GROUP BY 1, 2) SELECT key, {at('t')} AS timestamp, (sum(d) OVER (PARTITION BY key ORDER BY t))::BIGINT AS active_count FROM s"""
)
def active_sweep(spark, sf):
    return E.sweep_counts(V.intervals(spark, sf), ["key"], HOURLY)


@query(
    """
WITH i AS (SELECT s_suppkey, TIMESTAMP '2024-01-01' + to_hours(s_suppkey % 24) AS a, TIMESTAMP '2024-01-01' + to_hours(s_suppkey % 24 + 5) AS f, TIMESTAMP '2024-01-01' + to_hours(s_suppkey % 24 + 9) AS z FROM supplier),
g AS (SELECT *, unnest(generate_series(a, TIMESTAMP '2024-01-03', INTERVAL '60 minutes')) AS t FROM i)
SELECT s_suppkey, strftime(t, '%Y-%m-%d %H:%M:%S') AS timestamp, t >= a AND t <= z AS tuneup_in_window, t > z AS tuneup_post, t >= f AS tuneup_effective,
  round(date_diff('second', a, t) / 86400, 6) AS days_since_tuneup_start, round(CASE WHEN t >= f THEN date_diff('second', f, t) / 86400 END, 6) AS days_since_tuneup_effective FROM g"""
)
def intervention_features(spark, sf):
    base = F.lit("2024-01-01").cast("timestamp_ntz")
    later = lambda h: base + F.make_dt_interval(hours=F.col("s_suppkey").cast("int") % 24 + h)
    i = V.table(spark, sf, "supplier").select("s_suppkey", later(0).alias("start_ts"), later(5).alias("effective_ts"), later(9).alias("end_ts"))
    return E.intervention_features(i, ["s_suppkey"], F.lit("2024-01-03").cast("timestamp_ntz"), HOURLY)


# scalar surface


@query(
    """SELECT o_orderkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS joined, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i AND x <> 'b'), '|') AS stripped, list_contains(l, 'b') AS has_b
FROM (SELECT o_orderkey, string_split(CASE o_orderkey % 3 WHEN 0 THEN 'a|b|a' WHEN 1 THEN 'b|c' ELSE 'c|c' END || '|' || lower(o_orderstatus) || '|a', '|') AS l FROM orders)"""
)
def join_flags(spark, sf):
    first = F.when(F.col("o_orderkey") % 3 == 0, "a|b|a").when(F.col("o_orderkey") % 3 == 1, " b | c").otherwise("c||c")
    o = V.table(spark, sf, "orders").select("o_orderkey", X.join_flags(first, F.lit(None).cast("string"), F.lower("o_orderstatus"), F.lit("a")).alias("joined"))
    return o.select("o_orderkey", "joined", X.strip_flags("joined", ["b"]).alias("stripped"), X.has_token("joined", "b").alias("has_b"))


@query(panel_sql() + " SELECT count(*) FILTER (WHERE list_contains(string_split(quality_flags, '|'), 'missing_row')) AS missing_rows, count(*) FILTER (WHERE list_contains(string_split(quality_flags, '|'), 'missing_target')) AS missing_targets, count(*) AS rows FROM panel")
def token_counts(spark, sf):
    return V.panel(spark, sf).agg(F.count_if(X.has_token("quality_flags", X.MISSING_ROW)).alias("missing_rows"), F.count_if(X.has_token("quality_flags", X.MISSING_TARGET)).alias("missing_targets"), F.count("*").alias("rows"))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL ELSE p_size END::BIGINT AS p_size, CASE WHEN p_retailprice < 950 OR p_retailprice > 1500 THEN NULL ELSE p_retailprice END AS p_retailprice FROM part")
def policy_mask(spark, sf):
    rows = Y.load_policy([{"asset": "x", "table": "part", "column": c, "decision": d} for c, d in (("p_partkey", "keep"), ("p_size", "mask+keep"), ("p_retailprice", "keep"), ("p_name", "drop"))])
    masked = Y.apply_masks(V.table(spark, sf, "part"), {"p_size": Y.predicate("p_size", "gt:40"), "p_retailprice": Y.predicate("p_retailprice", "lt:950|gt:1500")})
    return Y.project(masked, Y.kept_columns(rows, "x", "part"))


@query("SELECT count(*) FILTER (WHERE s_acctbal < -10 OR s_acctbal > 5000) AS rule_rows, 0::BIGINT AS missing_rows, count(*) AS rows FROM supplier")
def rule_diagnostics(spark, sf):
    return Y.rule_diagnostics(V.table(spark, sf, "supplier"), ["s_acctbal"], -10.0, 5000.0)


@query("SELECT 'a' AS asset, 't' AS \"table\", n_name AS \"column\" FROM nation WHERE n_nationkey % 4 = 0")
def coverage_check(spark, sf):
    n = V.table(spark, sf, "nation").select(F.lit("a").alias("asset"), F.lit("t").alias("table"), F.col("n_name").alias("column"), "n_nationkey")
    return Y.uncovered(n.drop("n_nationkey"), n.filter("n_nationkey % 4 <> 0")).select("asset", "table", "column")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN round(o_orderkey / 8, 6) ELSE NULL END AS number FROM orders")
def lenient_cast(spark, sf):
    k = F.col("o_orderkey")
    raw = F.when(k % 5 == 0, " ").when(k % 5 == 1, "NaN").when(k % 5 == 2, "-").when(k % 5 == 3, "x1").otherwise(F.concat(F.lit(" "), (k / 8).cast("string")))
    return V.table(spark, sf, "orders").select("o_orderkey", M.lenient_double(raw).alias("number"))


@query("SELECT DISTINCT p_type AS value, 'f__' || trim(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM part")
def sanitize_names(spark, sf):
    return M.feature_names(V.table(spark, sf, "part"), "p_type", "f")


@query(
    """SELECT event_id, round(sin((hour(ts) * 60 + minute(ts)) * 2 * pi() / 1440), 6) AS time_of_day_sin, round(cos((hour(ts) * 60 + minute(ts)) * 2 * pi() / 1440), 6) AS time_of_day_cos,
  round(sin((isodow(ts) - 1) * 2 * pi() / 7), 6) AS day_of_week_sin, round(cos((isodow(ts) - 1) * 2 * pi() / 7), 6) AS day_of_week_cos, round(sin((month(ts) - 1) * 2 * pi() / 12), 6) AS month_of_year_sin, round(cos((month(ts) - 1) * 2 * pi() / 12), 6) AS month_of_year_cos,
  (isodow(ts) >= 5)::BIGINT AS is_weekend, (isodow(ts) >= 6)::BIGINT AS is_weekend_corrected FROM events"""
)
def calendar_features(spark, sf):
    return V.table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in T.calendar("ts").items()])


@query("SELECT s_suppkey, round(sin((s_acctbal - s_nationkey) * pi() / 180), 6) AS yaw_sin, round(cos((s_acctbal - s_nationkey) * pi() / 180), 6) AS yaw_cos, round((s_acctbal + s_nationkey + CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey END) / 3, 6) AS pitch_mean, (s_suppkey % 3 = 0)::BIGINT AS pitch__mask FROM supplier")
def angle_features(spark, sf):
    s = V.table(spark, sf, "supplier").withColumn("c", F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey")))
    a, b = M.sin_cos(F.col("s_acctbal") - F.col("s_nationkey"))
    return s.select("s_suppkey", a.alias("yaw_sin"), b.alias("yaw_cos"), M.row_mean("s_acctbal", "s_nationkey", "c").alias("pitch_mean"), M.companion_mask("c").alias("pitch__mask"))


# geometry

_EDGES_SQL = """
WITH s AS (SELECT printf('T%05d', s_suppkey::BIGINT) AS id, s_acctbal::DOUBLE AS x, s_suppkey * 10.0 AS y, (s_suppkey % 7)::DOUBLE AS el, 80.0 + s_nationkey AS ro FROM supplier),
e AS (SELECT a.id AS src_turbine_id, b.id AS dst_turbine_id, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS d, b.el - a.el AS el, (a.ro + b.ro) / 2 AS mr FROM s AS a JOIN s AS b ON a.id <> b.id)"""


@query(_EDGES_SQL + " SELECT src_turbine_id, dst_turbine_id, round(dx, 6) AS dx_m, round(dy, 6) AS dy_m, round(d, 6) AS distance_m, round(fmod(degrees(atan2(dx, dy)) + 360, 360), 6) AS bearing_deg, round(el, 6) AS elevation_diff_m, round(d / mr, 6) AS distance_rotor FROM e")
def pairwise_geometry(spark, sf):
    return G.pairwise_geometry(V.registry(spark, sf))


@query(_EDGES_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY src_turbine_id ORDER BY d, dst_turbine_id) AS rank FROM e) SELECT src_turbine_id, dst_turbine_id, round(d, 6) AS distance_m, rank FROM r WHERE rank <= 3")
def nearest_neighbors(spark, sf):
    return G.nearest(V.registry(spark, sf), 3)


@query(_EDGES_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY src_turbine_id ORDER BY d, dst_turbine_id) AS rank FROM e) SELECT DISTINCT least(src_turbine_id, dst_turbine_id) AS a, greatest(src_turbine_id, dst_turbine_id) AS b, round(d, 6) AS distance_m FROM r WHERE rank <= 2")
def knn_edges(spark, sf):
    return G.knn_edges(V.registry(spark, sf), 2)


@query(_EDGES_SQL + " SELECT src_turbine_id, dst_turbine_id, round(sin(radians(fmod(degrees(atan2(dx, dy)) + 360, 360))), 6) AS bearing_sin, round(cos(radians(fmod(degrees(atan2(dx, dy)) + 360, 360))), 6) AS bearing_cos, round((ln(1 + d) - avg(ln(1 + d)) OVER ()) / (stddev_pop(ln(1 + d)) OVER ()), 6) AS log_distance_z FROM e")
def edge_features(spark, sf):
    return G.edge_features(G.pairwise_geometry(V.registry(spark, sf)))


# reshaping, orders, unions

_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(panel_sql() + f" SELECT dataset, {at('timestamp')} AS timestamp, " + ", ".join(f"max(target_kw) FILTER (WHERE turbine_id = '{t}') AS \"{t}\"" for t in _TYPES) + " FROM panel GROUP BY 1, 2")
def pivot_panel(spark, sf):
    return R.pivot_entities(V.panel(spark, sf), _TYPES)


@query(panel_sql() + f" SELECT dataset, {at('timestamp')} AS timestamp, min(target_kw) AS value, coalesce(max(target_kw) - min(target_kw) <= 10, true) AS agrees FROM panel GROUP BY 1, 2")
def global_collapse(spark, sf):
    return R.collapse_site(V.panel(spark, sf), "target_kw", 10.0)


@query(panel_sql() + ", r AS (SELECT turbine_id, target_kw, row_number() OVER (PARTITION BY turbine_id ORDER BY timestamp) - 1 AS i, ceil(sqrt(count(*) OVER (PARTITION BY turbine_id)))::BIGINT AS s FROM panel) SELECT turbine_id, (i // s)::BIGINT AS tile_row, (i % s)::BIGINT AS tile_col, target_kw AS value FROM r")
def power_tile(spark, sf):
    return R.tile(V.panel(spark, sf), ["turbine_id"], "timestamp", "target_kw")


@query(panel_sql() + ", r AS (SELECT turbine_id, CASE WHEN coalesce(target_kw > 60, false) THEN 2 WHEN target_kw IS NULL THEN 0 ELSE 3 END AS value, row_number() OVER (PARTITION BY turbine_id ORDER BY timestamp) - 1 AS i, ceil(sqrt(count(*) OVER (PARTITION BY turbine_id)))::BIGINT AS s FROM panel) SELECT turbine_id, (i // s)::BIGINT AS tile_row, (i % s)::BIGINT AS tile_col, value::BIGINT AS value FROM r")
def status_tile(spark, sf):
    code = R.status_code(F.coalesce(F.col("target_kw") > 60, F.lit(False)), F.col("target_kw").isNull(), F.lit(False))
    return R.status_tile(V.panel(spark, sf), ["turbine_id"], "timestamp", code)


@query(
    panel_sql()
    + f""", s AS (SELECT turbine_id, timestamp AS anchor_ts, list(coalesce(target_kw, -1)) OVER (PARTITION BY turbine_id ORDER BY timestamp ROWS BETWEEN {HISTORY - 1} PRECEDING AND CURRENT ROW) AS p, list(coalesce(target_kw, -1)) OVER (PARTITION BY turbine_id ORDER BY timestamp ROWS BETWEEN 1 FOLLOWING AND {FORECAST} FOLLOWING) AS f FROM panel)
  SELECT turbine_id, {at('anchor_ts')} AS anchor_ts, round(list_sum(p), 6) AS past_sum, round(list_sum(f), 6) AS future_sum FROM s WHERE len(p) = {HISTORY} AND len(f) = {FORECAST}"""
)
def window_samples(spark, sf):
    out = R.window_samples(V.panel(spark, sf), HISTORY, FORECAST)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + F.nanvl(x, F.lit(-1.0))), 6)
    return out.select("turbine_id", "anchor_ts", total("past").alias("past_sum"), total("future").alias("future_sum"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_regionkey::BIGINT AS n_regionkey, row_number() OVER (ORDER BY CASE n_regionkey WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END, n_regionkey, n_name) AS sort_position FROM nation")
def result_order(spark, sf):
    n = V.table(spark, sf, "nation").withColumn("r", F.col("n_regionkey").cast("string"))
    return K.canonical_order(n, {"r": ["2", "0"]}, ("n_name",)).select("n_nationkey", "n_regionkey", "sort_position")


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank = 1")
def best_per_group(spark, sf):
    return K.top_per_group(V.table(spark, sf, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "rank")


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def topk_per_group(spark, sf):
    return K.top_per_group(V.table(spark, sf, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN -1.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def history_upsert(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return K.upsert(o, o.filter("o_orderkey % 7 = 0").withColumn("o_totalprice", F.lit(-1.0)), ["o_orderkey"])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM (SELECT l_returnflag, l_linestatus, l_orderkey FROM lineitem UNION ALL SELECT 'N', l_linestatus, l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem AS b WHERE b.l_returnflag = 'N' AND b.l_orderkey = lineitem.l_orderkey)) GROUP BY 1, 2")
def clone_metric(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey")
    return K.clone_metric(li, "l_returnflag", "R", "N", ["l_orderkey"]).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT n_name, 1::BIGINT AS one FROM nation WHERE n_regionkey = 1")
def prune_history(spark, sf):
    n = V.table(spark, sf, "nation").withColumn("job", (F.col("n_regionkey") == 1).cast("string")).withColumn("epoch", F.lit(1))
    return K.prune_from(n, {"job": "false"}, 1).select("n_name", F.lit(1).alias("one"))


@query("SELECT c_custkey, string_agg(name || '=' || label, ';' ORDER BY name) AS context FROM (SELECT c_custkey, 'segment' AS name, c_mktsegment AS label FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey::VARCHAR FROM customer) GROUP BY 1")
def long_context(spark, sf):
    c = V.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    lists = R.label_lists(R.long_context(c, ["c_custkey"], ["segment", "nation"]), ["c_custkey"])
    return lists.groupBy("c_custkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "name", "labels"))), ";").alias("context"))


@query(
    """SELECT key, strftime(min(start_ts), '%Y-%m-%d %H:%M:%S') AS first_start, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY key ORDER BY start_ts, event_id) AS sid FROM (
  SELECT *, (lag(start_ts) OVER (PARTITION BY key ORDER BY start_ts, event_id) IS NULL OR start_ts - lag(start_ts) OVER (PARTITION BY key ORDER BY start_ts, event_id) >= INTERVAL '60 minutes')::INT AS brk FROM (SELECT (user_id % 50)::VARCHAR AS key, date_trunc('second', ts) AS start_ts, event_id FROM events))) GROUP BY key, sid"""
)
def gap_sessions(spark, sf):
    from panelspan.streaming import revisions

    return revisions.sessions(V.intervals(spark, sf), "key", "start_ts", "60 minutes", "1 hour").select("key", F.col("start_ts").alias("first_start"), F.col("row_count").alias("n"))


@query("SELECT user_id, strftime(time_bucket(INTERVAL '60 minutes', ts), '%Y-%m-%d %H:%M:%S') AS timestamp, count(*) AS row_count, round(avg(value), 6) AS target_kw FROM events GROUP BY 1, 2")
def tumbling_buckets(spark, sf):
    from panelspan.streaming import revisions

    return revisions.bucket_means(V.table(spark, sf, "events"), "user_id", "ts", "value", HOURLY, "1 hour").select("user_id", "timestamp", "row_count", "target_kw")


@query("SELECT user_id, event_type, left(max(ts_text), 19) AS last_ts, arg_max(value, ts_text) AS value FROM (SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts_text, value FROM events) GROUP BY 1, 2")
def revision_stream(spark, sf):
    from panelspan.streaming import revisions

    return revisions.latest(V.table(spark, sf, "events").select("user_id", "event_type", "ts", "value"), ["user_id", "event_type"], "ts", ["value"]).select("user_id", "event_type", F.col("ts").alias("last_ts"), "value")


@query("SELECT n_name, r_name, n_nationkey::BIGINT AS n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def dimension_lookup(spark, sf):
    dim = V.table(spark, sf, "region").filter("r_name <> 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return L.lookup(V.table(spark, sf, "nation"), dim, "n_regionkey").select("n_name", "r_name", "n_nationkey")


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name, NULL::DOUBLE AS balance FROM nation UNION ALL SELECT 'S' || s_suppkey::VARCHAR, NULL, s_acctbal FROM supplier")
def diagonal_union(spark, sf):
    n = V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    s = V.table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_acctbal").alias("balance"))
    return L.diagonal_union([n, s])


@query("SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_nationkey < 5 THEN 'missing' ELSE 'extra' END AS side FROM nation WHERE n_nationkey < 5 OR n_nationkey >= 20")
def key_difference(spark, sf):
    n = V.table(spark, sf, "nation").select("n_nationkey")
    return L.key_difference(n.filter("n_nationkey < 20"), n.filter("n_nationkey >= 5"), ["n_nationkey"])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 200000)")
def pending_jobs(spark, sf):
    from panelspan.sources import layers

    done = V.table(spark, sf, "orders").filter("o_orderstatus = 'P' AND o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return layers.pending(V.table(spark, sf, "customer").select("c_custkey"), done, ["c_custkey"])


@query("SELECT 'file' AS \"table\", p_brand AS \"column\", 'x' AS asset, count(DISTINCT p_type) AS file_count, array_to_string(list_slice(list_sort(list_distinct(list(p_type))), 1, 3), ',') AS examples FROM part GROUP BY 2")
def schema_inventory(spark, sf):
    headers = V.table(spark, sf, "part").select(F.col("p_type").alias("path"), F.lit("x").alias("asset"), F.lit("file").alias("table"), F.col("p_brand").alias("column"))
    return Y.schema_inventory(headers)
