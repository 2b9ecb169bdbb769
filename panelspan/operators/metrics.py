"""Forecast errors, ramps, buckets, diagnostics, rankings and canonical orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspan.operators.panel import ENTITY


def persistence_predictions(anchors: DataFrame) -> DataFrame:
    """(dataset, turbine_id, anchor_ts, horizon, actual, predicted): the anchor's value held over each lead."""
    return anchors.select("dataset", ENTITY, "anchor_ts", F.posexplode("future").alias("p", "actual"), F.col("anchor_value").alias("predicted")).select(
        "dataset", ENTITY, "anchor_ts", (F.col("p") + 1).alias("horizon"), "actual", "predicted"
    )


def _valid() -> Column:
    return F.col("actual").isNotNull() & F.col("predicted").isNotNull()


def error_aggregates(rated: Column | None = None) -> list[Column]:
    """MAE and RMSE over valid pairs, in the target's unit and, with a rated power, per unit; null without pairs."""
    e = F.when(_valid(), F.col("predicted") - F.col("actual"))
    out = [F.count(e).alias("prediction_count"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")]
    if rated is not None:
        pu = e / rated
        out += [F.avg(F.abs(pu)).alias("mae_pu"), F.sqrt(F.avg(pu * pu)).alias("rmse_pu")]
    return out


def errors(predictions: DataFrame, keys: list[str], rated: Column | None = None) -> DataFrame:
    """One row for each combination of keys that has predictions; without any there is no row."""
    return predictions.groupBy(*keys).agg(*error_aggregates(rated))


def metric_rows(predictions: DataFrame, keys: list[str], rated: Column | None = None) -> DataFrame:
    """Long rows of an overall scope and one per lead, in one pass with grouping sets; overall rows have a null horizon."""
    expanded = predictions.select("*", F.explode(F.array(F.lit("overall"), F.lit("horizon"))).alias("scope"))
    lead = F.when(F.col("scope") == "horizon", F.col("horizon"))
    return expanded.withColumn("lead", lead).groupBy(*keys, "scope", "lead").agg(*error_aggregates(rated))


def metrics_rollup(predictions: DataFrame, rated: Column | None = None) -> DataFrame:
    """The same over (dataset), (dataset, horizon) and (dataset, entity) by grouping sets."""
    sets = [[F.col("dataset")], [F.col("dataset"), F.col("horizon")], [F.col("dataset"), F.col(ENTITY)]]
    out = predictions.groupingSets(sets, "dataset", "horizon", ENTITY).agg(F.grouping_id().alias("gid"), *error_aggregates(rated))
    scope = F.when(F.col("gid") == 3, "overall").when(F.col("gid") == 1, "horizon").otherwise("entity")
    return out.withColumn("scope", scope).drop("gid")


def ramp_errors(steps: DataFrame, scales: tuple[int, ...] = (3, 6), keys: tuple[str, ...] = ("window_id", ENTITY)) -> DataFrame:
    """Errors of K-step differences over history and forecast, per scale.

    steps has (keys, step, actual, predicted); steps up to 0 are history, where the
    prediction is the actual value. A ramp counts if both its ends are valid.
    """
    w = Window.partitionBy(*keys).orderBy("step")
    ramps = None
    for k in scales:
        pred, act = (F.col(c) - F.lag(c, k).over(w) for c in ("predicted", "actual"))
        one = steps.select("step", F.lit(k).alias("scale"), pred.alias("p"), act.alias("a")).filter("step > 0 AND p IS NOT NULL AND a IS NOT NULL")
        ramps = one if ramps is None else ramps.union(one)
    e = F.col("p") - F.col("a")
    return ramps.groupBy("scale").agg(
        F.count("*").alias("pair_count"), F.avg(F.abs(e)).alias("ramp_mae"), F.sqrt(F.avg(e * e)).alias("ramp_rmse"),
        F.avg((F.signum("p") == F.signum("a")).cast("double")).alias("sign_agreement"),
    )


def lead_buckets(per_lead: DataFrame, keys: list[str], buckets: tuple[tuple[int, int], ...] = ((1, 12), (13, 24), (25, 36))) -> DataFrame:
    """Plain means of per-lead metrics in buckets of leads: a mean of RMSEs, not a pooled one."""
    name = F.lit(None).cast("string")
    for lo, hi in buckets:
        name = F.when(F.col("horizon").between(lo, hi), f"{lo}-{hi}").otherwise(name)
    return per_lead.withColumn("bucket", name).filter("bucket IS NOT NULL").groupBy(*keys, "bucket").agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.count("*").alias("leads"))


def diagnostic_rates(rows: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """Clamp-hit rate, anchor-only errors, and how far the final value moves from the anchor."""
    a, f = F.col("anchor") - F.col("actual"), F.col("predicted") - F.col("actual")
    hit = ((F.col("predicted") <= low) | (F.col("predicted") >= high)).cast("double")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("prediction_count"), F.avg(hit).alias("clamp_rate"), F.avg(F.abs(a)).alias("anchor_mae"), F.sqrt(F.avg(a * a)).alias("anchor_rmse"),
        F.avg(F.abs(f)).alias("final_mae"), F.sqrt(F.avg(f * f)).alias("final_rmse"), F.avg(F.abs(F.col("predicted") - F.col("anchor"))).alias("mean_shift"),
    )


def quantile_diagnostics(values: DataFrame, keys: list[str], column: str, tiny: float = 1e-6) -> DataFrame:
    """Exact interpolated 5, 50 and 95 % quantiles, the mean, and the share of near-zero values."""
    q = F.percentile(column, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = values.groupBy(*keys).agg(q.alias("q"), F.avg(column).alias("mean"), F.avg((F.abs(F.col(column)) < tiny).cast("double")).alias("near_zero_share"))
    return out.select(*keys, F.col("q")[0].alias("q05"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q95"), "mean", "near_zero_share")


def masked_losses(rows: DataFrame, keys: list[str], delta: float = 1.0) -> DataFrame:
    """Masked Huber (0.5 e²/δ inside, |e| - 0.5 δ outside) and squared loss over the valid pairs."""
    e = F.when(_valid() & F.coalesce(F.col("valid"), F.lit(True)), F.col("predicted") - F.col("actual"))
    huber = F.when(F.abs(e) <= delta, 0.5 * e * e / delta).otherwise(F.abs(e) - 0.5 * delta)
    return rows.groupBy(*keys).agg(F.count(e).alias("valid_count"), F.avg(huber).alias("huber"), F.avg(e * e).alias("mse"))


def train_stats(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Population mean and spread over training rows; a spread of 0 counts as 1."""
    out = rows.groupBy(*keys).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
    return out.withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0)))


def weighted_history_mean(panel: DataFrame, weights: DataFrame) -> DataFrame:
    """Per entity the mean target over all training histories; a row counts once for each window it is in (weights: dataset, timestamp, weight)."""
    joined = panel.join(weights, ["dataset", "timestamp"]).filter("target_kw IS NOT NULL")
    return joined.groupBy("dataset", ENTITY).agg((F.sum(F.col("target_kw") * F.col("weight")) / F.sum("weight")).alias("fallback"))


def site_summary(panel: DataFrame, speed: str, direction: str) -> DataFrame:
    """Per timestamp: mean speed, mean cosine and sine of the direction, resultant length, availability; denominators are 1 at least."""
    angle = F.col(direction) * 0.017453292519943295
    n = F.greatest(F.count(speed), F.lit(1))
    m = F.greatest(F.count(direction), F.lit(1))
    out = panel.groupBy("dataset", "timestamp").agg(
        (F.coalesce(F.sum(speed), F.lit(0.0)) / n).alias("mean_speed"), (F.coalesce(F.sum(F.cos(angle)), F.lit(0.0)) / m).alias("mean_cos"), (F.coalesce(F.sum(F.sin(angle)), F.lit(0.0)) / m).alias("mean_sin"),
        (F.count(speed) / F.count("*")).alias("speed_availability"), (F.count(direction) / F.count("*")).alias("direction_availability"),
    )
    return out.withColumn("resultant", F.sqrt(F.col("mean_cos") ** 2 + F.col("mean_sin") ** 2))


def rank_of(column: str, order: list[str]) -> Column:
    """Position in a fixed list; what isn't in it comes last."""
    out = F.lit(len(order))
    for i, v in enumerate(order):
        out = F.when(F.col(column) == v, F.lit(i)).otherwise(out)
    return out


def canonical_order(rows: DataFrame, orders: dict[str, list[str]], then: tuple[str, ...] = ()) -> DataFrame:
    """rows with sort_position, their place by the ranks of the listed columns and then by plain columns, nulls first.

    The first listed column splits the rows into groups that are ordered apart, each in a task of its own, and the
    counts of the groups before it give each one its offset.
    """
    names = list(orders)
    lead = names[0]
    by = [rank_of(c, orders[c]) for c in names[1:]] + [F.col(c).asc_nulls_first() for c in names[1:]] + [F.col(c).asc_nulls_first() for c in then]
    groups = rows.groupBy(F.col(lead).alias("__lead")).agg(F.count("*").alias("__n")).withColumn("__rank", rank_of("__lead", orders[lead]))
    before = groups.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__rank", F.col("__lead").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = rows.withColumn("__p", F.row_number().over(Window.partitionBy(lead).orderBy(*(by or [F.lit(1)]))))
    out = placed.join(before.select("__lead", "__before"), F.col(lead).eqNullSafe(F.col("__lead")))
    return out.withColumn("sort_position", (F.col("__p") + F.col("__before")).cast("int")).drop("__p", "__lead", "__before")


def history_order(rows: DataFrame, orders: dict[str, list[str]], epoch: str = "epoch") -> DataFrame:
    """Training history in its canonical order: by ranked columns, then by epoch."""
    return canonical_order(rows, orders, (epoch,))


def search_ranking(rows: DataFrame, keys: list[str], metrics: list[str], name: str) -> DataFrame:
    """Candidates of a search ranked within keys, all metrics ascending, nulls last, the candidate's name settling ties."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(m).asc_nulls_last() for m in metrics], name)
    return rows.withColumn("rank", F.row_number().over(w))


def top_per_group(rows: DataFrame, keys: list[str], by: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group; Spark limits groups before its shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter(F.col("rank") <= k)


def upsert(history: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """history with new rows in place of those that have the same keys."""
    return history.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def prune_from(history: DataFrame, job: dict[str, str], epoch: int) -> DataFrame:
    """history without one job's rows from an epoch on."""
    same = F.lit(True)
    for c, v in job.items():
        same = same & F.col(c).eqNullSafe(F.lit(v))
    return history.filter(~(same & (F.col("epoch") >= epoch)))


def clone_metric(rows: DataFrame, column: str, source: str, copy: str, keys: list[str]) -> DataFrame:
    """rows with those of one selection metric repeated under another, where that one has none of the keys yet."""
    have = rows.filter(F.col(column) == copy).select(*keys).distinct()
    made = rows.filter(F.col(column) == source).join(have, keys, "left_anti").withColumn(column, F.lit(copy))
    return rows.unionByName(made)
