"""Gold panels from normalised sources: flags, masks, target and the regular grid, by source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspan.functions import flags as X
from panelspan.operators import panel as P
from panelspan.operators import policy as Y
from panelspan.sources.specs import SourceSpec

#: Columns that place a row and are no features.
PLACE = ("turbine_id", "timestamp", "day", "clock")


def day_clock_gold(rows: DataFrame, spec: SourceSpec, entities: DataFrame | None = None, masks: dict[str, str] | None = None) -> DataFrame:
    """The farm panel of a day/clock source: rows (turbine_id, timestamp, numeric columns) as files.read_day_clock gives them.

    Readings are flagged as they came, then the masks (column -> named rule) null single cells. Three booleans say
    whether a row is unknown, abnormal or either; on rows that the grid adds they are false.
    """
    flags = Y.reading_flags(rows.columns)
    unknown, abnormal = (reduce(lambda a, b: a | b, [c for n, c in flags.items() if kind in n]) for kind in ("_unknown_", "_abnormal_"))
    marked = rows.withColumns({"quality_flags": X.flag_list(*[X.flag_when(c, n) for n, c in flags.items()]), "is_unknown": unknown, "is_abnormal": abnormal, "is_masked": unknown | abnormal})
    masked = Y.apply_masks(marked.withColumn("target_kw", F.col(spec.target)), {c: Y.named_rule(r, c) for c, r in (masks or {}).items()})
    features = [c for c in rows.columns if c not in (*PLACE, spec.target)]
    base = masked.select(F.lit(spec.dataset_id).alias("dataset"), "turbine_id", "timestamp", "target_kw", "quality_flags", "is_unknown", "is_abnormal", "is_masked", *features)
    known = entities if entities is not None else rows.sparkSession.createDataFrame([(spec.dataset_id, e) for e in spec.entities], "dataset string, turbine_id string")
    full = P.fill_grid(base, known, spec.resolution_minutes)
    return full.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_unknown", "is_abnormal", "is_masked")})


def reading_report(gold: DataFrame) -> DataFrame:
    """Per dataset: rows with each reading flag, and unknown, abnormal and masked ones."""
    names = list(Y.reading_flags([]))
    return gold.groupBy("dataset").agg(
        *[F.count_if(X.has_token("quality_flags", n)).alias(n) for n in names],
        F.count_if("is_unknown").alias("unknown_count"), F.count_if("is_abnormal").alias("abnormal_count"), F.count_if("is_masked").alias("masked_count"),
    )


def banner_silver(rows: DataFrame, keys: tuple[str, ...] = ("turbine_id", "timestamp"), time: str = "Date and time", entity: str = "turbine") -> DataFrame:
    """One row a key of a banner source's text rows (files.read_banner_tables): the best value of each column, with conflict and row counts."""
    from panelspan.functions import timeutil as T
    from panelspan.operators import cleaning as C

    columns = [c for c in rows.columns if c not in ("source_file", "source_row", "turbine", "device", "device_type", time)]
    placed = rows.withColumn("turbine_id", F.col(entity)).withColumn("timestamp", T.parse(time)).filter("turbine_id IS NOT NULL AND timestamp IS NOT NULL")
    return C.merge_best_value(placed.withColumn("__order", F.struct("source_file", "source_row")), list(keys), columns, "__order")


def banner_gold(silver: DataFrame, spec: SourceSpec, entities: DataFrame | None = None) -> DataFrame:
    """The farm panel of a banner source: numbers read leniently, a flag where readings were in conflict, the regular grid."""
    from panelspan.functions import scalars as M

    numbers = [c for c in silver.columns if c not in ("turbine_id", "timestamp", "row_conflict_count", "source_row_count")]
    flag = F.coalesce(X.flag_when(F.col("row_conflict_count") > 0, X.CONFLICT_RESOLVED), F.lit(""))
    target = M.lenient_double(F.col(f"`{spec.target}`")) if spec.target in numbers else F.lit(None).cast("double")
    base = silver.select(
        F.lit(spec.dataset_id).alias("dataset"), "turbine_id", "timestamp", target.alias("target_kw"), flag.alias("quality_flags"),
        *[M.lenient_double(F.col(f"`{c}`")).alias(c) for c in numbers if c != spec.target],
    )
    known = entities if entities is not None else silver.sparkSession.createDataFrame([(spec.dataset_id, e) for e in spec.entities], "dataset string, turbine_id string")
    return P.fill_grid(base, known, spec.resolution_minutes)


def station_silver(rows: DataFrame, stations: DataFrame, spec: SourceSpec, station: str = "StationId") -> DataFrame:
    """One row a turbine and time of a station source's text rows (files.read_station_tables), its duplicates resolved.

    stations: (station, turbine_id), unique by station; rows of others and those without a time go. The source's
    columns are read as numbers. A number on which duplicates differ is null; duplicate_count, duplicate_kind,
    conflict_columns and normalized_columns say what was found.
    """
    from panelspan.functions import scalars as M
    from panelspan.operators import cleaning as C

    order = ["__source_file_idx", "__source_row_nr"]
    numbers = [c for c in rows.columns if c not in (station, "timestamp", *order)]
    read = rows.select(F.trim(station).alias(station), "timestamp", *order, *[M.lenient_double(F.col(f"`{c}`")).alias(c) for c in numbers])
    placed = read.join(stations.select(F.col(station).cast("string").alias(station), "turbine_id"), station).filter("timestamp IS NOT NULL")
    return C.resolve_duplicates(placed.withColumn("dataset", F.lit(spec.dataset_id)), ["dataset", "turbine_id", "timestamp"], numbers, order)


def station_gold(silver: DataFrame, spec: SourceSpec, entities: DataFrame | None = None, site: DataFrame | None = None, local: DataFrame | None = None) -> DataFrame:
    """The farm panel of a station source: the target, flags of duplicates in conflict, the regular grid, and joined series.

    A conflict in the target is a flag of the row, one in another column a flag of its features. site has columns by
    (dataset, timestamp), local by (dataset, turbine_id, timestamp): shared series, event and intervention features.
    """
    found = ("duplicate_count", "duplicate_kind", "conflict_columns", "normalized_columns")
    features = [c for c in silver.columns if c not in ("dataset", "turbine_id", "timestamp", spec.target, *found)]
    odd = F.col("duplicate_kind") == "conflict"
    target_odd = odd & F.array_contains("conflict_columns", spec.target)
    feature_odd = odd & (F.size(F.array_remove("conflict_columns", spec.target)) > 0)
    row_flag = F.coalesce(X.flag_when(target_odd, X.DUPLICATE_RESOLVED), F.lit(""))
    feature_flag = F.coalesce(X.flag_when(feature_odd, f"{X.SOURCE_CONFLICT}__default"), F.lit(""))
    base = silver.select("dataset", "turbine_id", "timestamp", F.col(f"`{spec.target}`").alias("target_kw"), row_flag.alias("quality_flags"), feature_flag.alias("feature_quality_flags"), *[f"`{c}`" for c in features])
    known = entities if entities is not None else silver.sparkSession.createDataFrame([(spec.dataset_id, e) for e in spec.entities], "dataset string, turbine_id string")
    full = P.fill_grid(base, known, spec.resolution_minutes).withColumn("feature_quality_flags", F.coalesce("feature_quality_flags", F.lit("")))
    return P.attach_site_series(full, site, local) if site is not None else full
