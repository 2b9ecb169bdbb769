"""Sliding history/forecast windows, splits, thinning and alignment, all as frames over ordinals.

A dataset's axis isn't one task. Ordinals come from row numbers within spans of time plus
the counts of the spans before; frames are taken in blocks of consecutive ordinals, each
with copies of the neighbouring rows that its frames reach into.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspan.functions import flags as X
from panelspan.functions import timeutil as T
from panelspan.operators.panel import ENTITY, clean_row

#: The window index's columns, in order.
FARM_COLUMNS = (
    "dataset", "window_id", "input_start_ts", "input_end_ts", "output_start_ts", "output_end_ts", "input_steps_expected", "output_steps_expected",
    "input_observed", "output_observed", "input_with_target", "output_with_target", "input_masked", "output_masked",
    "input_unknown", "output_unknown", "input_abnormal", "output_abnormal", "min_input_observed", "min_output_with_target",
    "is_complete_input", "is_complete_output", "is_fully_synchronous_input", "is_fully_synchronous_output", "quality_flags", "feature_quality_flags",
)


#: Seconds of a span that is numbered in one task, and rows of a block (more if frames are longer).
SPAN, BLOCK = 2_000_000, 4096


def _frames(keys: list[str], history: int, forecast: int):
    order = Window.partitionBy(*keys).orderBy("timestamp")
    return order, order.rowsBetween(-(history - 1), 0), order.rowsBetween(1, forecast)


def with_ordinals(rows: DataFrame, keys: tuple[str, ...] = ("dataset",), time: str = "timestamp", span: int = SPAN) -> DataFrame:
    """rows with __i, their place by time from 0, and __n, how many rows their keys have; times should be distinct within keys.

    Each span of time is numbered by itself; what meets in one task a key is one count a span.
    """
    part = F.floor(T.seconds(time) / span)
    marked = rows.withColumn("__span", part)
    counts = marked.groupBy(*keys, "__span").agg(F.count("*").alias("__c"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy(F.col("__span").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)], F.col("__span").alias("__s"), F.coalesce(F.sum("__c").over(upto), F.lit(0)).alias("__before"), F.sum("__c").over(whole).alias("__n"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__k{j}")) for j, k in enumerate(keys)], F.col("__span").eqNullSafe(F.col("__s")))
    numbered = marked.withColumn("__p", F.row_number().over(Window.partitionBy(*keys, "__span").orderBy(F.col(time).asc_nulls_first())) - 1)
    out = numbered.join(before, same).withColumn("__i", F.col("__p") + F.col("__before"))
    return out.drop("__span", "__s", "__p", "__before", *[f"__k{j}" for j in range(len(keys))])


def in_blocks(numbered: DataFrame, keys: tuple[str, ...], back: int, ahead: int, block: int = BLOCK):
    """(rows with __block and __home, the window specification of a block): each row in its own block, and as a copy in those whose frames reach it.

    Frames of up to back rows before and ahead rows after a home row are whole.
    """
    size = max(block, back + ahead)
    own = F.floor(F.col("__i") / size)
    low, high = F.floor((F.col("__i") - ahead) / size), F.floor((F.col("__i") + back) / size)
    copies = numbered.withColumn("__own", own).withColumn("__block", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)))
    return copies.withColumn("__home", F.col("__block") == F.col("__own")).drop("__own"), Window.partitionBy(*keys, "__block").orderBy("__i")


def farm_windows(summary: DataFrame, history: int, forecast: int, stride: int = 1, block: int = BLOCK) -> DataFrame:
    """The farm window index of a per-timestamp summary (panel.farm_summary).

    Windows count rows, not time: input rows i-H+1 … i, output i+1 … i+F, for anchors from
    H-1 to n-F-1 by the stride. A side is complete if every step has all expected entities'
    targets, synchronous if all are observed. One frame a side gathers all its steps.
    """
    rows, order = in_blocks(with_ordinals(summary), ("dataset",), history - 1, forecast, block)
    step = F.struct("timestamp", "observed", "with_target", "masked", "unknown", "abnormal", "has_row_flags", (F.coalesce("feature_flags", F.lit("")) != "").cast("int").alias("has_feature"))
    framed = rows.select(
        "dataset", "expected", "__i", "__n", "__home",
        F.collect_list(step).over(order.rowsBetween(-(history - 1), 0)).alias("input"), F.collect_list(step).over(order.rowsBetween(1, forecast)).alias("output"),
    )
    anchor = F.col("__home") & (F.col("__i") >= history - 1) & (F.col("__i") <= F.col("__n") - forecast - 1) & ((F.col("__i") - (history - 1)) % stride == 0)
    kept = framed.filter(anchor)
    sides = ("input", "output")
    least = lambda s, c: F.array_min(F.col(f"{s}.{c}"))
    most = lambda s, c: F.array_max(F.col(f"{s}.{c}"))
    complete = {s: least(s, "with_target") == F.col("expected") for s in sides}
    synchronous = {s: least(s, "observed") == F.col("expected") for s in sides}
    flags = X.flag_list(
        X.flag_when(~complete["input"], X.PARTIAL_INPUT), X.flag_when(~complete["output"], X.PARTIAL_OUTPUT),
        X.flag_when(most("input", "masked") > 0, X.MASKED_INPUT), X.flag_when(most("output", "masked") > 0, X.MASKED_OUTPUT),
        X.flag_when(F.greatest(most("input", "has_row_flags"), most("output", "has_row_flags")) > 0, X.ROW_ISSUES),
    )
    feature = X.flag_list(X.flag_when(most("input", "has_feature") > 0, X.FEATURE_ISSUES_INPUT), X.flag_when(most("output", "has_feature") > 0, X.FEATURE_ISSUES_OUTPUT))
    made = {
        "window_id": ((F.col("__i") - (history - 1)) / stride).cast("long"),
        "input_steps_expected": F.lit(history), "output_steps_expected": F.lit(forecast),
        "min_input_observed": least("input", "observed"), "min_output_with_target": least("output", "with_target"),
        "is_complete_input": complete["input"], "is_complete_output": complete["output"],
        "is_fully_synchronous_input": synchronous["input"], "is_fully_synchronous_output": synchronous["output"],
        "quality_flags": flags, "feature_quality_flags": feature,
    }
    for s in sides:
        made[f"{s}_start_ts"], made[f"{s}_end_ts"] = F.element_at(F.col(f"{s}.timestamp"), 1), F.element_at(F.col(f"{s}.timestamp"), -1)
        made |= {f"{s}_{c}": F.col(f"{s}.{c}") for c in ("observed", "with_target", "masked", "unknown", "abnormal")}
    return kept.select(*[F.col("dataset") if c == "dataset" else made[c].alias(c) for c in FARM_COLUMNS])


def farm_window_report(index: DataFrame) -> DataFrame:
    """Counters over a farm window index, one row a dataset."""
    masked_in, masked_out = (X.has_token("quality_flags", t) for t in (X.MASKED_INPUT, X.MASKED_OUTPUT))
    sync = F.col("is_fully_synchronous_input") & F.col("is_fully_synchronous_output")
    conditions = {
        "complete_input": F.col("is_complete_input"), "complete_output": F.col("is_complete_output"),
        "fully_synchronous_input": F.col("is_fully_synchronous_input"), "fully_synchronous_output": F.col("is_fully_synchronous_output"),
        "unmasked_input": ~masked_in, "unmasked_output": ~masked_out, "masked_input": masked_in, "masked_output": masked_out,
        "fully_synchronous": sync, "fully_synchronous_and_unmasked_output": F.col("is_complete_output") & ~masked_out,
        "fully_synchronous_and_unmasked_all": sync & ~masked_in & ~masked_out,
    }
    return index.groupBy("dataset").agg(F.count("*").alias("window_count"), *(F.count_if(c).alias(k) for k, c in conditions.items()))


def entity_windows(panel: DataFrame, history: int, forecast: int, stride: int = 1) -> DataFrame:
    """The same per entity, with counts instead of per-step arrays."""
    keys = ["dataset", ENTITY]
    order, back, ahead = _frames(keys, history, forecast)
    flagged = (F.coalesce("quality_flags", F.lit("")) != "").cast("int")
    cols: dict[str, Column] = {"__i": F.row_number().over(order) - 1, "__n": F.count("*").over(Window.partitionBy(*keys))}
    for side, w in (("input", back), ("output", ahead)):
        cols[f"{side}_start_ts"], cols[f"{side}_end_ts"] = F.first("timestamp").over(w), F.last("timestamp").over(w)
        cols[f"{side}_observed_steps"] = F.sum(F.col("is_observed").cast("int")).over(w)
        cols[f"{side}_target_steps"] = F.sum(F.col("target_kw").isNotNull().cast("int")).over(w)
        cols[f"__{side}_flags"] = F.max(flagged).over(w)
    kept = panel.select("*", *(v.alias(k) for k, v in cols.items()))
    kept = kept.filter((F.col("__i") >= history - 1) & (F.col("__i") <= F.col("__n") - forecast - 1) & ((F.col("__i") - (history - 1)) % stride == 0))
    full_in, full_out = F.col("input_target_steps") == history, F.col("output_target_steps") == forecast
    flags = X.flag_list(X.flag_when(~full_in, X.PARTIAL_INPUT), X.flag_when(~full_out, X.PARTIAL_OUTPUT), X.flag_when(F.greatest("__input_flags", "__output_flags") > 0, X.ROW_ISSUES))
    sides = [f"{s}_{c}" for s in ("input", "output") for c in ("start_ts", "end_ts", "observed_steps", "target_steps")]
    return kept.select(*keys, *sides, full_in.alias("is_complete_input"), full_out.alias("is_complete_output"), flags.alias("window_flags"))


def entity_window_report(index: DataFrame) -> DataFrame:
    """Counters over an entity window index, one row an entity."""
    return index.groupBy("dataset", ENTITY).agg(
        F.count("*").alias("window_count"), F.count_if("is_complete_input").alias("complete_input"), F.count_if("is_complete_output").alias("complete_output"),
        F.count_if(F.col("is_complete_input") & F.col("is_complete_output")).alias("complete"), F.count_if(F.col("window_flags") == "").alias("unflagged"),
    )


def strict_windows(index: DataFrame, clean_inputs: bool = False) -> DataFrame:
    """Windows complete and synchronous on both sides without row flags, optionally without input feature issues."""
    ok = F.col("is_complete_input") & F.col("is_complete_output") & F.col("is_fully_synchronous_input") & F.col("is_fully_synchronous_output")
    ok = ok & ~X.has_token("quality_flags", X.ROW_ISSUES)
    if clean_inputs:
        ok = ok & ~X.has_token("feature_quality_flags", X.FEATURE_ISSUES_INPUT)
    return index.filter(ok)


def eligible_anchors(panel: DataFrame, history: int, forecast: int) -> DataFrame:
    """(dataset, turbine_id, anchor_ts, anchor_value, future array) where every history and forecast row is clean."""
    keys = ["dataset", ENTITY]
    _, back, ahead = _frames(keys, history, forecast)
    clean = clean_row().cast("int")
    framed = panel.select(*keys, "timestamp", "target_kw", F.sum(clean).over(back).alias("__h"), F.sum(clean).over(ahead).alias("__f"), F.collect_list("target_kw").over(ahead).alias("future"))
    return framed.filter((F.col("__h") == history) & (F.col("__f") == forecast)).select(*keys, F.col("timestamp").alias("anchor_ts"), F.col("target_kw").alias("anchor_value"), "future")


def valid_target_windows(panel: DataFrame, forecast: int, block: int = BLOCK) -> DataFrame:
    """Anchors (dataset, timestamp) with one valid target of any entity in their forecast span, at least."""
    per = panel.groupBy("dataset", "timestamp").agg(F.count("target_kw").alias("v"))
    rows, order = in_blocks(with_ordinals(per), ("dataset",), 0, forecast, block)
    return rows.select("dataset", "timestamp", "__home", F.sum("v").over(order.rowsBetween(1, forecast)).alias("valid_targets")).filter("__home AND valid_targets > 0").drop("__home")


def split_bounds(axis: DataFrame, train: float = 0.7, validation: float = 0.1) -> DataFrame:
    """(dataset, split, start_ts, end_ts, n_steps): floor shares of the distinct timestamps, the rest for test.

    Shares are doubles: the floor of a decimal product would differ at the edges.
    """
    ranked = with_ordinals(axis.select("dataset", "timestamp").distinct())
    a = F.floor(F.col("__n") * F.lit(float(train)))
    b = a + F.floor(F.col("__n") * F.lit(float(validation)))
    split = F.when(F.col("__i") < a, "train").when(F.col("__i") < b, "val").otherwise("test")
    return ranked.groupBy("dataset", split.alias("split")).agg(F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"), F.count("*").alias("n_steps"))


def split_windows(index: DataFrame, bounds: DataFrame) -> DataFrame:
    """Windows that lie in one split from first input to last output, with that split. bounds has three rows a dataset."""
    b = bounds.select("dataset", "split", "start_ts", "end_ts")
    return index.join(F.broadcast(b), "dataset").filter("input_start_ts >= start_ts AND output_end_ts <= end_ts").drop("start_ts", "end_ts")


def thin(windows: DataFrame, forecast: int, keys: tuple[str, ...] = ("dataset",), order: str = "output_start_ts") -> DataFrame:
    """Every forecast-th window, from the first, so that forecasts don't overlap."""
    return with_ordinals(windows, keys, order).filter(F.col("__i") % forecast == 0).drop("__i", "__n")


def first_per_split(windows: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The first windows of each split in time order; splits without a limit stay whole."""
    ranked = with_ordinals(windows, ("dataset", "split"), "output_start_ts")
    keep = reduce(lambda c, kv: F.when(F.col("split") == kv[0], F.col("__i") < kv[1]).otherwise(c), limits.items(), F.lit(True))
    return ranked.filter(keep).drop("__i", "__n")


def align(variants: list[DataFrame], keys: tuple[str, ...] = ("output_start_ts", "output_end_ts")) -> DataFrame:
    """The key sets that all variants have."""
    return reduce(lambda a, b: a.intersect(b), [v.select(*keys).distinct() for v in variants])


def history_rows(axis: DataFrame, targets: DataFrame, history: int, block: int = BLOCK) -> DataFrame:
    """Timestamps that are in the history of a training window: one of the next `history` steps starts a target."""
    marked = axis.select("dataset", "timestamp").distinct().join(targets.select("dataset", F.col("output_start_ts").alias("timestamp"), F.lit(1).alias("__t")).distinct(), ["dataset", "timestamp"], "left")
    rows, order = in_blocks(with_ordinals(marked), ("dataset",), 0, history, block)
    return rows.withColumn("__h", F.max("__t").over(order.rowsBetween(1, history))).filter("__home AND __h = 1").select("dataset", "timestamp")


def last_valid(panel: DataFrame, history: int, fallback: DataFrame | None = None) -> DataFrame:
    """The last available target inside the history, else the entity's fallback (turbine_id, fallback)."""
    w = Window.partitionBy("dataset", ENTITY).orderBy("timestamp").rowsBetween(-(history - 1), 0)
    out = panel.select("dataset", ENTITY, "timestamp", F.last("target_kw", ignorenulls=True).over(w).alias("last_valid"))
    if fallback is None:
        return out
    return out.join(fallback, ENTITY, "left").withColumn("last_valid", F.coalesce("last_valid", "fallback")).drop("fallback")


def steps_since_valid(panel: DataFrame, cap: int = 72) -> DataFrame:
    """Steps since the last target, 0 where there is one, capped and divided by the cap; the cap before any."""
    w = Window.partitionBy("dataset", ENTITY).orderBy("timestamp")
    rn = F.row_number().over(w)
    ranked = panel.select("dataset", ENTITY, "timestamp", "target_kw", rn.alias("rn"))
    seen = F.last(F.when(F.col("target_kw").isNotNull(), F.col("rn")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    steps = F.least(F.coalesce(F.col("rn") - seen, F.lit(cap)), F.lit(cap))
    return ranked.select("dataset", ENTITY, "timestamp", (steps / cap).alias("since_valid"))


def panel_ordinals(panel: DataFrame) -> DataFrame:
    """(dataset, timestamp, step): the position of each timestamp on the axis, from 0."""
    return with_ordinals(panel.select("dataset", "timestamp").distinct()).select("dataset", "timestamp", F.col("__i").alias("step"))
