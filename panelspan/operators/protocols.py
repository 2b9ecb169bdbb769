"""Feature protocols: from a panel's native columns to value columns, masks and flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspan.functions import flags as X
from panelspan.functions import scalars as M
from panelspan.functions import timeutil as T
from panelspan.operators import geometry
from panelspan.operators.policy import outside_rule
from panelspan.sources.specs import MASKED, MASKED_SOURCES, PITCH_RULE, PROTOCOLS, SourceSpec, groups_of

BASE = ("dataset", "turbine_id", "timestamp", "target_kw", "is_observed", "quality_flags", "feature_quality_flags")


def _native(spec: SourceSpec, role: str) -> str:
    try:
        return spec.columns[role]
    except KeyError:
        raise ValueError(f"{spec.dataset_id} has no {role} column") from None


def role_columns(spec: SourceSpec, masked: bool) -> dict[str, Column]:
    """Each role's expression. Where a dataset stores the direction relative to the nacelle, that is
    the yaw error itself, and the direction is their sum."""
    out: dict[str, Column] = {}
    for role in ("speed", "ambient", "internal", "generator", "rotor"):
        if role in spec.columns:
            out[role] = F.col(f"`{spec.columns[role]}`")
    nacelle = F.col(f"`{_native(spec, 'nacelle')}`")
    if "relative" in spec.columns:
        yaw = F.col(f"`{spec.columns['relative']}`")
        direction = nacelle + yaw
    else:
        direction = F.col(f"`{_native(spec, 'direction')}`")
        yaw = direction - nacelle
    out["wd_sin"], out["wd_cos"] = M.sin_cos(direction)
    out["yaw_sin"], out["yaw_cos"] = M.sin_cos(yaw)
    pitch = [F.when(~outside_rule(p, *PITCH_RULE), F.col(f"`{p}`")) if masked else F.col(f"`{p}`") for p in _native(spec, "pitch")]
    out["pitch_mean"] = M.row_mean(*pitch)
    return out


NAMES = {"wd_sin": "wind_direction_sin", "wd_cos": "wind_direction_cos", "yaw_sin": "yaw_error_sin", "yaw_cos": "yaw_error_cos", "pitch_mean": "pitch_mean"}


def protocol_groups(spec: SourceSpec, protocol: str) -> dict[str, list[str]]:
    """The names of a protocol's columns by group: local and global values with their masks, target mask, known future, static, pairwise."""
    groups, masked = groups_of(protocol), protocol in MASKED
    local = [*[NAMES.get(r) or spec.columns[r] for r in PROTOCOLS[protocol]], *groups.local]
    mask = lambda cs: [f"{c}__mask" for c in cs] if masked else []
    return {
        "local_values": local, "local_masks": mask(local), "global_values": list(groups.site), "global_masks": mask(groups.site), "target_masks": mask(["target_kw"]),
        "known_future": list(groups.known_future), "static": list(groups.static), "pairwise": list(groups.pairwise),
    }


def select_protocol(panel: DataFrame, spec: SourceSpec, protocol: str) -> DataFrame:
    """The base columns, the protocol's values and its masks; a row that misses a value is flagged for it.

    Values are those by role, then the local and the site-wide observations that the protocol names. A masked
    protocol has an int8 companion of the target and of every value, 1 where missing.
    """
    if protocol not in PROTOCOLS:
        raise ValueError(f"unknown protocol {protocol!r}")
    masked = protocol in MASKED
    if masked and spec.dataset_id not in MASKED_SOURCES:
        raise ValueError(f"{protocol} is not defined for {spec.dataset_id}")
    roles, groups = PROTOCOLS[protocol], groups_of(protocol)
    known = role_columns(spec, masked) if roles else {}
    missing = [r for r in roles if r not in known]
    if missing:
        raise ValueError(f"{protocol} needs {missing}, which {spec.dataset_id} lacks")
    observed = [*groups.local, *groups.site]
    absent = [c for c in observed if c not in panel.columns]
    if absent:
        raise ValueError(f"{protocol} needs {absent}, which the panel of {spec.dataset_id} lacks")
    values = {NAMES.get(r) or spec.columns[r]: known[r] for r in roles} | {c: F.col(c) for c in observed}
    base = panel if "feature_quality_flags" in panel.columns else panel.withColumn("feature_quality_flags", F.lit(""))
    out = base.select(*BASE, *[x.alias(c) for c, x in values.items()])
    if values:
        gone = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in values])
        out = out.withColumn("feature_quality_flags", X.join_flags("feature_quality_flags", X.flag_when(gone, X.MISSING_COVARIATES)))
    if masked:
        out = out.withColumns({f"{c}__mask": M.companion_mask(F.col(f"`{c}`")) for c in ("target_kw", *values)})
    return out


#: Names of the calendar's encodings in a bundle.
CALENDAR = {"time_of_day": "calendar_hour", "day_of_week": "calendar_weekday", "month_of_year": "calendar_month", "is_weekend": "calendar_is_weekend"}


def known_future(panel: DataFrame) -> DataFrame:
    """Calendar encodings per (dataset, timestamp)."""
    axis = panel.select("dataset", "timestamp").distinct()
    named = lambda n: CALENDAR.get(n) or CALENDAR[n[:-4]] + n[-4:]
    return axis.select("dataset", "timestamp", *[c.alias(named(n)) for n, c in T.calendar("timestamp").items() if n != "is_weekend_corrected"])


def pairwise_table(entities: DataFrame) -> DataFrame:
    """Directed edges between placed entities (turbine_id, turbine_index, x, y, elevation_m, rotor_diameter_m), by a bundle's names."""
    placed = entities.select("turbine_id", "x", "y", F.col("elevation_m").alias("elevation"), F.col("rotor_diameter_m").alias("rotor"))
    edges = geometry.pairwise_geometry(placed)
    index = lambda end: entities.select(F.col("turbine_id").alias(f"{end}_turbine_id"), F.col("turbine_index").alias(f"{end}_turbine_index"))
    return edges.join(index("src"), "src_turbine_id").join(index("dst"), "dst_turbine_id").select(
        "src_turbine_id", "dst_turbine_id", "src_turbine_index", "dst_turbine_index", F.col("dx_m").alias("delta_x_m"), F.col("dy_m").alias("delta_y_m"),
        "distance_m", "bearing_deg", "elevation_diff_m", F.col("distance_rotor").alias("distance_in_rotor_diameters"),
    )


def static_table(static: DataFrame, schema: dict[str, str], entities: list[str], spark, order: tuple[str, ...] = ()) -> DataFrame:
    """Every registered entity in index order with the schema's columns, null where unknown.

    Of several rows of an id the first by the order given, and then by their schema columns, counts as a whole.
    """
    axis = spark.createDataFrame([(i, e) for i, e in enumerate(entities)], "turbine_index int, turbine_id string")
    cols = [F.col(c).try_cast(t).alias(c) if c in static.columns else F.lit(None).cast(t).alias(c) for c, t in schema.items()]
    row = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.struct(*cols).alias("row"))
    one = static.groupBy("turbine_id").agg(F.min(row)["row"].alias("row")).select("turbine_id", "row.*")
    return axis.join(one, "turbine_id", "left")
