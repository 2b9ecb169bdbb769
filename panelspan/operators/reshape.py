"""Pivots, channel arrays, window samples, tiles, site-wide collapse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspan.operators.panel import ENTITY


def pivot_entities(panel: DataFrame, ids: list[str], value: str = "target_kw") -> DataFrame:
    """One row a timestamp, one column for each registered entity, in the given order, present or not."""
    return panel.groupBy("dataset", "timestamp").pivot(ENTITY, ids).agg(F.first(value, ignorenulls=True))


def channels(panel: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as one double array, for dense exports ordered by (timestamp, entity)."""
    return panel.select("dataset", "timestamp", ENTITY, F.array(*[F.col(c).cast("double") for c in columns]).alias("channels"))


def window_samples(panel: DataFrame, history: int, forecast: int) -> DataFrame:
    """(dataset, entity, anchor_ts, past, future): target slices of every complete window."""
    w = Window.partitionBy("dataset", ENTITY).orderBy("timestamp")
    cell = F.coalesce(F.col("target_kw").cast("double"), F.lit(float("nan")))
    out = panel.select("dataset", ENTITY, F.col("timestamp").alias("anchor_ts"), F.collect_list(cell).over(w.rowsBetween(-(history - 1), 0)).alias("past"), F.collect_list(cell).over(w.rowsBetween(1, forecast)).alias("future"))
    return out.filter((F.size("past") == history) & (F.size("future") == forecast))


def collapse_site(panel: DataFrame, column: str, tolerance: float = 1e-9) -> DataFrame:
    """(dataset, timestamp, value, agrees): a site-wide column stored per entity, as one value, and whether all entities agree."""
    return panel.groupBy("dataset", "timestamp").agg(F.min(column).alias("value"), F.coalesce(F.max(column) - F.min(column) <= tolerance, F.lit(True)).alias("agrees"))


def tile(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows laid out row by row in a square of ceil(sqrt(n)) columns: (keys, tile_row, tile_col, value)."""
    w = Window.partitionBy(*keys)
    side = F.ceil(F.sqrt(F.count("*").over(w)))
    i = F.row_number().over(w.orderBy(order)) - 1
    return rows.select(*keys, i.alias("__i"), side.alias("__s"), F.col(value).alias("value")).select(*keys, F.floor(F.col("__i") / F.col("__s")).alias("tile_row"), F.pmod(F.col("__i"), F.col("__s")).alias("tile_col"), "value")


def padding(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The cells of each square that no row fills."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("side", F.ceil(F.sqrt("n")))
    cells = n.filter("side * side > n").select(*keys, "side", F.explode(F.sequence(F.col("n"), F.col("side") * F.col("side") - 1)).alias("i"))
    return cells.select(*keys, F.floor(F.col("i") / F.col("side")).alias("tile_row"), F.pmod("i", "side").alias("tile_col"))


def status_tile(rows: DataFrame, keys: list[str], order: str, status) -> DataFrame:
    """A square tile of status codes: (keys, tile_row, tile_col, value)."""
    return tile(rows.withColumn("__status", status), keys, order, "__status")


def dense(panel: DataFrame, columns: list[str], future_from=None, masks: tuple[str, ...] = ()) -> DataFrame:
    """(dataset, timestamp, turbine_id, channels): the columns as one array, missing values 0, for dense exports.

    From future_from on observations are unknown: they are 0 there and their masks 1.
    """
    ahead = F.lit(False) if future_from is None else F.col("timestamp") >= F.lit(future_from).cast("timestamp_ntz")
    cell = lambda c: F.when(ahead, F.lit(1.0 if c in masks else 0.0)).otherwise(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return panel.select("dataset", "timestamp", ENTITY, F.array(*[cell(c) for c in columns]).alias("channels"))


def selected_entity(selector: str | int, entities: list[str]) -> str:
    """A registered id, given as itself or by its place from 0."""
    if isinstance(selector, str) and selector in entities:
        return selector
    if str(selector).isdigit() and int(selector) < len(entities):
        return entities[int(selector)]
    raise ValueError(f"{selector!r} is neither one of {', '.join(entities)} nor a place among them")


def status_code(masked, target_issue, feature_issue):
    """2 masked, else 0 target issue, else 1 feature issue, else 3 clean."""
    return F.when(masked, 2).when(target_issue, 0).when(feature_issue, 1).otherwise(3)


def long_context(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Wide context columns as (keys, name, label) rows, nulls left out."""
    return rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("label")) for c in columns])).alias("x")).select(*keys, "x.name", "x.label").filter("label IS NOT NULL")


def label_lists(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Back to one row a key: the sorted labels of each name, as 'a, b'."""
    return rows.groupBy(*keys, "name").agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("labels"))
