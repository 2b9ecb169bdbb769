"""Regular panels: gap filling, farm synchrony, coverage, quality totals.

A panel has one row per (dataset, entity, timestamp) on a shared regular time axis,
with is_observed, a target and pipe-separated quality_flags.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspan.functions import flags as X
from panelspan.functions import timeutil as T

FARM_KEYS = ["dataset", "timestamp"]
ENTITY = "turbine_id"


def fill_grid(obs: DataFrame, entities: DataFrame | None, minutes: int, layout: str = "farm") -> DataFrame:
    """Left join of the regular grid with the observations (dataset, turbine_id, timestamp, target_kw, quality_flags?, …).

    layout 'farm': every registered entity over its dataset's whole time span; 'entity': each
    over its own. entities: (dataset, turbine_id), or (turbine_id) where obs has one dataset;
    those of obs by default. Rows off the grid vanish; duplicate keys multiply.
    """
    if layout == "farm":
        bounds = obs.groupBy("dataset").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
        known = (entities if entities is not None else obs).select(*[c for c in ("dataset", ENTITY) if entities is None or c in entities.columns]).distinct()
        # the bounds are one row a dataset and the entity list is a registry: with the axis they make the grid itself
        owners = bounds.join(known, "dataset") if "dataset" in known.columns else bounds.crossJoin(known)
        axis = owners.select("dataset", ENTITY, F.explode(T.grid("lo", "hi", minutes)).alias("timestamp"))
    else:
        bounds = obs.groupBy("dataset", ENTITY).agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
        axis = bounds.select("dataset", ENTITY, F.explode(T.grid("lo", "hi", minutes)).alias("timestamp"))
    base = obs if "quality_flags" in obs.columns else obs.withColumn("quality_flags", F.lit(""))
    joined = axis.join(base.withColumn("__there", F.lit(True)), ["dataset", ENTITY, "timestamp"], "left")
    flags = X.flag_list(
        F.when(F.col("quality_flags") != "", F.col("quality_flags")),
        X.flag_when(F.col("__there").isNull(), X.MISSING_ROW),
        X.flag_when(F.col("target_kw").isNull(), X.MISSING_TARGET),
    )
    return joined.withColumn("quality_flags", flags).withColumn("is_observed", F.col("__there").isNotNull()).drop("__there")


def with_farm_sync(panel: DataFrame, expected: int) -> DataFrame:
    """The panel with per-timestamp counts and synchrony, by one window: no join back."""
    w = Window.partitionBy(*FARM_KEYS)
    seen = F.sum(F.coalesce(F.col("is_observed"), F.lit(False)).cast("int")).over(w).cast("int")
    target = F.sum(F.col("target_kw").isNotNull().cast("int")).over(w).cast("int")
    return (
        panel.withColumn("farm_turbines_expected", F.lit(expected))
        .withColumn("farm_turbines_observed", seen)
        .withColumn("farm_turbines_with_target", target)
        .withColumn("farm_is_fully_synchronous", F.col("farm_turbines_observed") == expected)
        .withColumn("farm_has_all_targets", F.col("farm_turbines_with_target") == expected)
    )


def farm_summary(panel: DataFrame, expected: int | None = None, masks: tuple[str, ...] = ("target_kw__mask", "is_unknown", "is_abnormal")) -> DataFrame:
    """One row per timestamp: counts, whether any row has a flag, and the union of feature flags.

    expected: given, or the panel's farm_turbines_expected, or its number of entities.
    Columns named in masks are counted where the panel has them, else 0.
    """
    on = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    count = lambda c: F.sum(on(c)).cast("int") if c in panel.columns else F.lit(0)
    feature = F.coalesce("feature_quality_flags", F.lit("")) if "feature_quality_flags" in panel.columns else F.lit("")
    aggs = [
        F.sum(on("is_observed")).cast("int").alias("observed"),
        F.sum(F.col("target_kw").isNotNull().cast("int")).cast("int").alias("with_target"),
        *(count(c).alias(n) for c, n in zip(masks, ("masked", "unknown", "abnormal"), strict=True)),
        F.max((F.coalesce("quality_flags", F.lit("")) != "").cast("int")).alias("has_row_flags"),
        X.join_flag_arrays(F.array_sort(F.collect_set(feature))).alias("feature_flags"),
    ]
    if "farm_turbines_expected" in panel.columns and expected is None:
        aggs.append(F.max("farm_turbines_expected").alias("own_expected"))
    out = panel.groupBy(*FARM_KEYS).agg(*aggs)
    if expected is not None:
        return out.withColumn("expected", F.lit(expected))
    if "own_expected" in out.columns:
        return out.withColumn("expected", F.max("own_expected").over(Window.partitionBy("dataset"))).drop("own_expected")
    n = panel.groupBy("dataset").agg(F.countDistinct(ENTITY).cast("int").alias("expected"))
    return out.join(n, "dataset")


def coverage_overall(panel: DataFrame, expected: int) -> DataFrame:
    """Per dataset: timestamps, synchronous and full-target ones, their ratios, first and last of them."""
    per = panel.groupBy(*FARM_KEYS).agg(F.sum(F.col("is_observed").cast("int")).alias("o"), F.sum(F.col("target_kw").isNotNull().cast("int")).alias("t"))
    sync, full = F.col("o") == expected, F.col("t") == expected
    return per.groupBy("dataset").agg(
        F.count("*").alias("timestamp_count"),
        F.count_if(sync).alias("synchronous_count"), F.count_if(full).alias("full_target_count"),
        (F.count_if(sync) / F.count("*")).alias("synchronous_ratio"), (F.count_if(full) / F.count("*")).alias("full_target_ratio"),
        F.min(F.when(sync, F.col("timestamp"))).alias("first_synchronous"), F.max(F.when(sync, F.col("timestamp"))).alias("last_synchronous"),
        F.min(F.when(full, F.col("timestamp"))).alias("first_full_target"), F.max(F.when(full, F.col("timestamp"))).alias("last_full_target"),
    )


def coverage_entity(panel: DataFrame) -> DataFrame:
    """Per entity: rows, observed and target rows, their ratios, first and last observed time."""
    seen = F.col("is_observed")
    return panel.groupBy("dataset", ENTITY).agg(
        F.count("*").alias("row_count"), F.count_if(seen).alias("observed_count"), F.count("target_kw").alias("target_count"),
        (F.count_if(seen) / F.count("*")).alias("observed_ratio"), (F.count("target_kw") / F.count("*")).alias("target_ratio"),
        F.min(F.when(seen, F.col("timestamp"))).alias("first_observed"), F.max(F.when(seen, F.col("timestamp"))).alias("last_observed"),
    )


def quality_totals(panel: DataFrame) -> DataFrame:
    """Per dataset: rows, missing rows and targets, flagged rows, duplicated keys; sums that merge across partitions."""
    dup = panel.groupBy("dataset", ENTITY, "timestamp").agg(F.count("*").alias("n"), F.count_if(~F.col("is_observed")).alias("gone"), F.count_if(F.col("target_kw").isNull()).alias("blank"), F.count_if(F.col("quality_flags") != "").alias("flagged"))
    return dup.groupBy("dataset").agg(
        F.sum("n").alias("row_count"), F.sum("gone").alias("missing_row_count"), F.sum("blank").alias("missing_target_count"),
        F.sum("flagged").alias("flagged_row_count"), F.count_if(F.col("n") > 1).alias("duplicate_key_count"),
    )


def observed_deltas(panel: DataFrame) -> DataFrame:
    """(dataset, turbine_id, previous, timestamp, delta_minutes) between successive observed rows of an entity."""
    w = Window.partitionBy("dataset", ENTITY).orderBy("timestamp")
    seen = panel.filter("is_observed").withColumn("previous", F.lag("timestamp").over(w)).filter("previous IS NOT NULL")
    return seen.select("dataset", ENTITY, "previous", "timestamp", F.floor((T.seconds("timestamp") - T.seconds("previous")) / 60).alias("delta_minutes"))


def interval_histogram(panel: DataFrame) -> DataFrame:
    return observed_deltas(panel).groupBy("dataset", "delta_minutes").agg(F.count("*").alias("delta_count"))


def long_gaps(panel: DataFrame, minutes: int) -> DataFrame:
    return observed_deltas(panel).filter(F.col("delta_minutes") > minutes)


def clean_row():
    """Observed, with a target, and without a quality flag."""
    return F.coalesce(F.col("is_observed"), F.lit(False)) & F.col("target_kw").isNotNull() & (F.coalesce("quality_flags", F.lit("")) == "")


def invalid_point():
    """The opposite for drawing: an unknown state counts as invalid."""
    bad = F.col("target_kw").isNull() | (F.coalesce("quality_flags", F.lit("")) != "") | ~F.col("is_observed")
    return F.coalesce(bad, F.lit(True))


def farm_status(panel: DataFrame, masks: tuple[str, ...] = (), warm_up: str = X.MISSING_COVARIATES) -> DataFrame:
    """Per timestamp: entities with a target issue, a feature issue (a warm-up flag aside) or a mask, and whether any."""
    feature = X.strip_flags("feature_quality_flags", [warm_up]) != "" if "feature_quality_flags" in panel.columns else F.lit(False)
    issue = F.col("target_kw").isNull() | ~F.col("is_observed") | (F.coalesce("quality_flags", F.lit("")) != "")
    masked = F.lit(False)
    for m in masks:
        masked = masked | (F.coalesce(F.col(m).cast("int"), F.lit(0)) == 1)
    out = panel.groupBy(*FARM_KEYS).agg(F.count_if(issue).alias("target_issue_count"), F.count_if(feature).alias("feature_issue_count"), F.count_if(masked).alias("masked_count"))
    return out.withColumns({f"has_{n}": F.col(f"{n}_count") > 0 for n in ("target_issue", "feature_issue", "masked")})


def attach_site_series(panel: DataFrame, site: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """Site-level columns by (dataset, timestamp) and entity-level ones by (dataset, entity, timestamp).

    After the join null booleans are false and null event counts 0; days_since_* stay null.
    """
    out = panel.join(site, FARM_KEYS, "left")
    added = [(c, t) for c, t in site.dtypes if c not in FARM_KEYS]
    if local is not None:
        out = out.join(local, ["dataset", ENTITY, "timestamp"], "left")
        added += [(c, t) for c, t in local.dtypes if c not in [*FARM_KEYS, ENTITY]]
    fills = {c: F.coalesce(c, F.lit(False)) for c, t in added if t == "boolean"}
    fills |= {c: F.coalesce(c, F.lit(0)).cast(t) for c, t in added if (c.endswith("_count") or c.endswith("_seconds")) and not c.startswith("days_since")}
    return out.withColumns(fills) if fills else out


def time_slice(panel: DataFrame, start=None, end=None, entity: str | None = None) -> DataFrame:
    """Rows of a closed time interval, open where no bound is given, and of one entity if named; both reach a Parquet scan as filters."""
    out = panel
    for bound, inside in ((start, lambda t, b: t >= b), (end, lambda t, b: t <= b)):
        if bound is not None:
            out = out.filter(inside(F.col("timestamp"), F.lit(bound).cast("timestamp_ntz")))
    return out if entity is None else out.filter(F.col(ENTITY) == entity)


def time_bounds(frames: list[DataFrame], time: str = "timestamp") -> DataFrame:
    """(first, last) over several tables: each gives its own bounds first, so only those meet."""
    each = [f.agg(F.min(time).alias("first"), F.max(time).alias("last")) for f in frames]
    return reduce(lambda a, b: a.union(b), each).agg(F.min("first").alias("first"), F.max("last").alias("last"))


def to_interval_end(rows: DataFrame, keys: list[str], minutes: int, order: list[str], time: str = "timestamp") -> DataFrame:
    """Rows labelled by the start of their interval, relabelled by its end; the first of each key and label stays."""
    moved = rows.withColumn(time, T.plus_minutes(time, minutes))
    w = Window.partitionBy(*keys, time).orderBy(*order)
    return moved.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def per_entity(panel: DataFrame, frame_to_frame, schema: str) -> DataFrame:
    """A Python callback for each entity's frame, in time order: for what no expression says.

    One entity is held by one task, so its frame must fit a worker; prefer expressions.
    """
    return panel.groupBy("dataset", ENTITY).applyInPandas(lambda f: frame_to_frame(f.sort_values("timestamp", kind="stable")), schema)


def joined_series(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All keys of two series with the columns of both: the union of the keys, then left joins."""
    axis = first.select(*keys).union(second.select(*keys)).distinct()
    return axis.join(first, keys, "left").join(second, keys, "left")
