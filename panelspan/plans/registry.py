"""All queries of the panel engine by name, with the SQL that each is held against, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelspan.operators import metrics, windows
from panelspan.plans import catalogue, catalogue_sources, views  # noqa: F401 (the second adds its queries to the first's)

SMALLEST = "/root/testdata/sf0.001"


def entry(spark: SparkSession) -> DataFrame:
    """Persistence errors by lead over daily panels: grid, clean windows, horizons, metrics."""
    panel = views.panel(spark, SMALLEST, minutes=1440)
    return metrics.errors(metrics.persistence_predictions(windows.eligible_anchors(panel, 5, 2)), ["dataset", "horizon"])


def queries() -> dict:
    return dict(catalogue.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalogue.ORACLES)
