"""Interval events as per-bucket features, and features since interventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspan.functions import scalars as M
from panelspan.functions import timeutil as T

#: Distinct category values that may become columns.
MAX_CATEGORIES = 500


def effective_ends(events: DataFrame, keys: list[str], minutes: int) -> DataFrame:
    """events (keys, start_ts, end_ts, …) with effective_end: the end if after the start, else the
    next later start of the key, else the key's last bound rounded up plus one step.

    The next later start is taken over times, not rows, so events that start together all get the same one.
    """
    # from the latest start backwards, so that the frame only grows
    w = Window.partitionBy(*keys).orderBy(T.micros("start_ts").desc())
    bound = F.max(F.coalesce("end_ts", "start_ts")).over(Window.partitionBy(*keys))
    following = F.min("start_ts").over(w.rangeBetween(Window.unboundedPreceding, -1))
    return events.withColumn(
        "effective_end",
        F.when(F.col("end_ts") > F.col("start_ts"), F.col("end_ts")).when(following > F.col("start_ts"), following).otherwise(T.plus_minutes(T.ceil_to(bound, minutes), minutes)),
    )


def covered_buckets(events: DataFrame, minutes: int) -> DataFrame:
    """One row for each event and interval-end bucket t that it covers: t > start and t - step < effective end.

    Buckets come from a sequence of each event's own, so the overlap is an equi-explode, not a theta join.
    """
    first = T.plus_minutes(T.floor_to("start_ts", minutes), minutes)
    # the last t with t < effective_end + step
    last = T.ceil_to("effective_end", minutes)
    last = F.when(last == T.plus_minutes("effective_end", minutes), last - F.expr(f"INTERVAL {minutes} MINUTES")).otherwise(last)
    out = events.withColumn("__a", first).withColumn("__b", last).filter("__a <= __b")
    out = out.withColumn("timestamp", F.explode(T.grid("__a", "__b", minutes))).drop("__a", "__b")
    begin = F.greatest(T.micros("start_ts"), T.micros("timestamp") - minutes * 60_000_000)
    end = F.least(T.micros("effective_end"), T.micros("timestamp"))
    return out.withColumn("overlap_seconds", F.greatest(F.lit(0), F.floor((end - begin) / 1_000_000)).cast("int"))


def event_features(
    events: DataFrame, keys: list[str], minutes: int, prefix: str = "evt", categorical: dict[str, str] | None = None, aliases: dict[str, str] | None = None, alias_column: str = "status"
) -> DataFrame:
    """Per key and bucket: any_active, active_count, total_overlap_seconds, and a flag per alias and category.

    The grid runs from the floor of a key's first start to the ceiling of its last effective
    end. aliases maps sanitised statuses to flag names, all of which are always there;
    categorical maps columns to name prefixes, one flag for each distinct value, named once
    over all keys. The distinct values are the only thing collected: they are columns, and
    more than MAX_CATEGORIES of them are an error, not a plan.
    """
    ready = effective_ends(events, keys, minutes)
    named = {}
    marked = covered_buckets(ready, minutes)
    conditions: dict[str, Column] = {}
    for status, name in (aliases or {}).items():
        hit = M.sanitize(alias_column) == status
        conditions[f"{prefix}_{name}"] = conditions[f"{prefix}_{name}"] | hit if f"{prefix}_{name}" in conditions else hit
    for column, name_prefix in (categorical or {}).items():
        found = M.feature_names(events, column, name_prefix).orderBy("name").limit(MAX_CATEGORIES + 1).collect()
        if len(found) > MAX_CATEGORIES:
            raise ValueError(f"{column} has more than {MAX_CATEGORIES} values: too many for columns")
        for value, name in found:
            named[name] = F.trim(F.col(column)) == value
    conditions |= named
    aggs = [F.count("*").cast("int").alias(f"{prefix}_active_count"), F.sum("overlap_seconds").cast("int").alias(f"{prefix}_total_overlap_seconds")]
    aggs += [F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()]
    hits = marked.groupBy(*keys, "timestamp").agg(*aggs)
    bounds = ready.groupBy(*keys).agg(T.floor_to(F.min("start_ts"), minutes).alias("__lo"), T.ceil_to(F.max("effective_end"), minutes).alias("__hi"))
    grid = bounds.select(*keys, F.explode(T.grid("__lo", "__hi", minutes)).alias("timestamp"))
    out = grid.join(hits, [*keys, "timestamp"], "left")
    fills = {f"{prefix}_active_count": F.coalesce(f"{prefix}_active_count", F.lit(0)), f"{prefix}_total_overlap_seconds": F.coalesce(f"{prefix}_total_overlap_seconds", F.lit(0))}
    fills |= {n: F.coalesce(n, F.lit(False)) for n in conditions}
    return out.withColumns(fills).withColumn(f"{prefix}_any_active", F.col(f"{prefix}_active_count") > 0).select(
        *keys, "timestamp", f"{prefix}_any_active", f"{prefix}_active_count", f"{prefix}_total_overlap_seconds", *conditions
    )


def sweep_counts(events: DataFrame, keys: list[str], minutes: int) -> DataFrame:
    """Active counts by +1/-1 marks and a running sum: linear in events, whatever their length."""
    ready = effective_ends(events, keys, minutes)
    first = T.plus_minutes(T.floor_to("start_ts", minutes), minutes)
    after = T.plus_minutes(T.ceil_to("effective_end", minutes), minutes)
    marks = ready.select(*keys, F.explode(F.array(F.struct(first.alias("timestamp"), F.lit(1).alias("d")), F.struct(after.alias("timestamp"), F.lit(-1).alias("d")))).alias("m")).select(*keys, "m.*")
    steps = marks.groupBy(*keys, "timestamp").agg(F.sum("d").alias("d"))
    return steps.select(*keys, "timestamp", F.sum("d").over(Window.partitionBy(*keys).orderBy("timestamp")).alias("active_count"))


def intervention_features(interventions: DataFrame, keys: list[str], end: Column, minutes: int, prefix: str = "tuneup") -> DataFrame:
    """From each start to a dataset end: in_window (closed), post (strictly after), effective (from the effective time on), and days since.

    interventions has (keys, start_ts, effective_ts, end_ts); days are fractional, null before their event.
    """
    grid = interventions.withColumn("timestamp", F.explode(T.grid(T.ceil_to("start_ts", minutes), end, minutes)))
    t = F.col("timestamp")
    days = lambda c: (T.seconds("timestamp") - T.seconds(c)) / F.lit(86400.0)
    return grid.select(
        *keys, "timestamp", ((t >= F.col("start_ts")) & F.coalesce(t <= F.col("end_ts"), F.lit(False))).alias(f"{prefix}_in_window"),
        F.coalesce(t > F.col("end_ts"), F.lit(False)).alias(f"{prefix}_post"), F.coalesce(t >= F.col("effective_ts"), F.lit(False)).alias(f"{prefix}_effective"),
        days("start_ts").alias(f"days_since_{prefix}_start"), F.when(t >= F.col("effective_ts"), days("effective_ts")).alias(f"days_since_{prefix}_effective"),
    )
