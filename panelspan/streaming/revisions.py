"""Streaming twins of the ordered-merge, bucket and report operators.

Rows arrive in time order but for a bounded lateness: the frontier. It is the watermark
delay, state older than it is dropped, and each function is the same DataFrame code over
a batch and over a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """The last revision of each key: an aggregate that merges, so batch and stream agree."""
    best = F.max(F.struct(F.col(time), *[F.col(v) for v in values]))
    return rows.groupBy(*keys).agg(best.alias("__b")).select(*keys, *[F.col(f"__b.{c}").alias(c) for c in (time, *values)])


def deduplicated(stream: DataFrame, keys: list[str], time: str, frontier: str) -> DataFrame:
    """The first row of each key; keys are forgotten once the frontier has passed them."""
    return stream.withWatermark(time, frontier).dropDuplicatesWithinWatermark(keys)


def frontier_merge(stream: DataFrame, keys: list[str], time: str, values: list[str], frontier: str) -> DataFrame:
    """Rows of one key and time merged once the frontier has passed them: a value on which they differ is null.

    (keys, time, values, row_count, conflict_count). Least and greatest values merge in any order, so batch and
    stream agree; a row later than the frontier is not merged again.
    """
    same = lambda v: F.when(F.min(v) == F.max(v), F.min(v)).alias(v)
    odd = sum((F.coalesce(F.min(v) != F.max(v), F.lit(False)).cast("int") for v in values), F.lit(0)).alias("conflict_count")
    return stream.withWatermark(time, frontier).groupBy(*keys, time).agg(*[same(v) for v in values], F.count("*").alias("row_count"), odd)


def bucket_means(stream: DataFrame, entity: str, time: str, value: str, minutes: int, frontier: str) -> DataFrame:
    """Mean, count per entity and bucket, final once the frontier has passed the bucket."""
    w = F.window(time, f"{minutes} minutes")
    out = stream.withWatermark(time, frontier).groupBy(entity, w).agg(F.avg(value).alias("target_kw"), F.count("*").alias("row_count"))
    return out.select(entity, F.col("window.start").alias("timestamp"), "target_kw", "row_count")


def sessions(stream: DataFrame, entity: str, time: str, gap: str, frontier: str) -> DataFrame:
    """Runs of rows without a gap of the given length."""
    out = stream.withWatermark(time, frontier).groupBy(entity, F.session_window(time, gap)).agg(F.count("*").alias("row_count"))
    return out.select(entity, F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), "row_count")


def running_report(stream: DataFrame, entity: str, value: str) -> DataFrame:
    """Mergeable counts for the complete output mode."""
    return stream.groupBy(entity).agg(F.count("*").alias("row_count"), F.count(value).alias("value_count"), F.sum(F.col(value).isNull().cast("long")).alias("missing_count"))


def carry_over(stream: DataFrame, keys: list[str], fold, state_schema: str, output_schema: str, mode: str = "append") -> DataFrame:
    """A generic fold with state per key: fold(state tuple or None, rows pandas) -> (state tuple, output pandas)."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames, state: GroupState):
        held = state.get if state.exists else None
        for rows in frames:
            held, out = fold(key, held, rows)
            yield out
        state.update(held)

    return stream.groupBy(*keys).applyInPandasWithState(step, output_schema, state_schema, mode, GroupStateTimeout.NoTimeout)
