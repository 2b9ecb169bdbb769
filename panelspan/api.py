"""The public functions: from a gold panel to task bundles, window indexes and persistence tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspan.operators import geometry, metrics, panel, protocols, windows
from panelspan.sources import files, layers
from panelspan.sources.specs import SOURCES, SourceSpec, TaskSpec, dataset


#: Static columns of an entity, beside its name and index.
STATIC = {
    "latitude": "double", "longitude": "double", "coord_x": "double", "coord_y": "double", "coord_kind": "string", "coord_crs": "string",
    "elevation_m": "double", "rated_power_kw": "double", "hub_height_m": "double", "rotor_diameter_m": "double",
}


def list_sources() -> list[str]:
    return sorted(SOURCES)


def get_dataset_spec(dataset_id: str) -> SourceSpec:
    return dataset(dataset_id)


def build_gold(observations: DataFrame, spec: SourceSpec, layout: str = "farm") -> DataFrame:
    """The regular farm panel of a dataset's observations (dataset, turbine_id, timestamp, target_kw, …)."""
    spark = observations.sparkSession
    # the entities of one registered source: a fixed list of some tens to hundreds
    entities = spark.createDataFrame([(spec.dataset_id, e) for e in spec.entities], "dataset string, turbine_id string")
    known = observations.join(F.broadcast(entities), ["dataset", "turbine_id"], "left_semi")
    return panel.with_farm_sync(panel.fill_grid(known, entities, spec.resolution_minutes, layout), len(spec.entities))


@dataclass
class Bundle:
    series: DataFrame
    known_future: DataFrame
    window_index: DataFrame
    report: DataFrame
    static: DataFrame
    pairwise: DataFrame
    context: DataFrame


PARTS = tuple(f.name for f in fields(Bundle))


def build_bundle(gold: DataFrame, spec: SourceSpec, task: TaskSpec, protocol: str, static: DataFrame | None = None) -> Bundle:
    """A task's series, calendar, window index with its report, entities in index order, their geometry, and a context row.

    A farm task has windows of all entities together, a turbine task those of each. static: turbine_id and columns of
    STATIC, where coord_x and coord_y, or latitude and longitude, place it; without positions there are no edges.
    """
    spark = gold.sparkSession
    series = protocols.select_protocol(gold, spec, protocol)
    history, forecast, stride = task.steps(spec.resolution_minutes)
    if task.mode == "farm":
        index = windows.farm_windows(panel.farm_summary(series, len(spec.entities)), history, forecast, stride)
        report = windows.farm_window_report(index)
    elif task.mode == "turbine":
        index = windows.entity_windows(series, history, forecast, stride)
        report = windows.entity_window_report(index)
    else:
        raise ValueError(f"unknown task mode {task.mode!r}")
    known = static if static is not None else spark.createDataFrame([], "turbine_id string")
    entities = protocols.static_table(known, STATIC, list(spec.entities), spark).withColumn("dataset", F.lit(spec.dataset_id))
    placed = geometry.with_local_xy(entities).filter("x IS NOT NULL AND y IS NOT NULL")
    pairwise = protocols.pairwise_table(placed)
    covariates = [c for c in series.columns if c not in protocols.BASE and not c.endswith("__mask")]
    masks = [c for c in series.columns if c.endswith("__mask")]
    row = (spec.dataset_id, task.task_id, protocol, history, forecast, stride, spec.resolution_minutes, covariates, masks, list(spec.entities), protocols.protocol_groups(spec, protocol))
    context = spark.createDataFrame(
        [row], "dataset string, task_id string, protocol string, history_steps int, forecast_steps int, stride_steps int, resolution_minutes int, covariates array<string>, masks array<string>, entities array<string>, groups map<string, array<string>>"
    )
    return Bundle(series, protocols.known_future(series), index, report, entities, pairwise, context)


def save_bundle(bundle: Bundle, layout: layers.Layout, task: TaskSpec, protocol: str) -> None:
    for name in PARTS:
        layers.write(getattr(bundle, name), layout.task(task.task_id, protocol, name))


def load_bundle(spark: SparkSession, layout: layers.Layout, task: TaskSpec, protocol: str) -> Bundle:
    return Bundle(*[spark.read.parquet(layout.task(task.task_id, protocol, n)) for n in PARTS])


def build_manifest(spark: SparkSession, root: str, layout: layers.Layout, required: dict[str, str]) -> dict:
    """Files below root: how many fit each required pattern, which patterns none fits, and a fingerprint; stored beside the layers."""
    listing = files.list_files(spark, root)
    counts, missing = layers.check_layout([r[0] for r in listing.select("path").orderBy("path").collect()], required)
    manifest = {"root": root, "counts": counts, "missing": missing, "fingerprint": layers.source_fingerprint(listing).first()[0]}
    layers.publish(spark, layers.report(manifest), f"{layout.root}/{layout.dataset}/manifest.json")
    return manifest


def build_silver(rows: DataFrame, layout: layers.Layout, name: str = "continuous") -> None:
    """A normalised source table, stored in the silver layer."""
    layers.write(rows, layout.silver(name))


def _silver(spark: SparkSession, layout: layers.Layout, *name: str) -> DataFrame:
    return spark.read.parquet(layout.silver("__".join(name)))


def load_series(spark: SparkSession, layout: layers.Layout) -> DataFrame:
    return spark.read.parquet(layout.gold)


def load_turbine_static(spark: SparkSession, layout: layers.Layout) -> DataFrame:
    return _silver(spark, layout, "turbine_static")


def load_shared_timeseries(spark: SparkSession, layout: layers.Layout, group: str) -> DataFrame:
    return _silver(spark, layout, "shared", group)


def load_duplicate_audit(spark: SparkSession, layout: layers.Layout) -> DataFrame:
    return _silver(spark, layout, "duplicate_audit")


def load_event_features(spark: SparkSession, layout: layers.Layout, group: str) -> DataFrame:
    return _silver(spark, layout, "event_features", group)


def load_interventions(spark: SparkSession, layout: layers.Layout, group: str) -> DataFrame:
    return _silver(spark, layout, "interventions", group)


def load_window_index(spark: SparkSession, layout: layers.Layout, task: TaskSpec, protocol: str) -> DataFrame:
    return load_bundle(spark, layout, task, protocol).window_index


def load_task_turbine_static(spark: SparkSession, layout: layers.Layout, task: TaskSpec, protocol: str) -> DataFrame:
    return load_bundle(spark, layout, task, protocol).static


def persistence(series: DataFrame, task: TaskSpec, minutes: int, rated_kw: float | None = None) -> dict[str, DataFrame]:
    """summary, per_horizon and per_entity error tables of last-value persistence over clean windows."""
    history, forecast, _ = task.steps(minutes)
    predictions = metrics.persistence_predictions(windows.eligible_anchors(series, history, forecast))
    rated = F.lit(rated_kw) if rated_kw else None
    return {n: metrics.errors(predictions, keys, rated) for n, keys in (("summary", ["dataset"]), ("per_horizon", ["dataset", "horizon"]), ("per_entity", ["dataset", "turbine_id"]))}


def quality_report(gold: DataFrame, spec: SourceSpec) -> dict:
    """Totals and coverage of a panel as one plain dict."""
    totals = panel.quality_totals(gold).first()
    coverage = panel.coverage_overall(gold, len(spec.entities)).first()
    return {**(totals.asDict() if totals else {}), **(coverage.asDict() if coverage else {})}
