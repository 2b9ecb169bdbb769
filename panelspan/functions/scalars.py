"""Numeric, angle, mask and name expressions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RADIANS = math.pi / 180
EARTH_METRES = 6_371_000.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lenient_double(c: Column | str) -> Column:
    """A number read leniently: trimmed; '', 'NaN', '-' and what is no number are null, and so is NaN."""
    x = F.trim(_col(c).cast("string"))
    n = F.when(~x.isin("", "NaN", "nan", "-"), x).try_cast("double")
    return F.when(~F.isnan(n), n)


def sanitize(c: Column | str) -> Column:
    """Lower case, other runs than a-z0-9 as one underscore, none at the ends; 'unknown' if nothing is left."""
    x = F.regexp_replace(F.lower(F.trim(_col(c))), r"[^a-z0-9]+", "_")
    x = F.regexp_replace(x, r"^_+|_+$", "")
    return F.when(x != "", x).otherwise(F.lit("unknown"))


def sanitize_name(value: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", value.strip().lower()).strip("_") or "unknown"


def feature_names(values: DataFrame, column: str, prefix: str) -> DataFrame:
    """(value, name) of the distinct trimmed non-empty values: prefix__name, with _2, _3 … on collisions, in value order."""
    v = values.select(F.trim(F.col(column)).alias("value")).filter("value <> ''").distinct()
    base = F.concat(F.lit(prefix + "__"), sanitize("value"))
    rank = F.row_number().over(Window.partitionBy("base").orderBy("value"))
    named = v.withColumn("base", base).withColumn("n", rank)
    return named.select("value", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("n").cast("string"))).alias("name"))


def sin_cos(degrees: Column) -> tuple[Column, Column]:
    angle = degrees * F.lit(RADIANS)
    return F.sin(angle), F.cos(angle)


def row_mean(*columns: Column | str) -> Column:
    """The mean of all columns; null if any is null."""
    total = _col(columns[0])
    for c in columns[1:]:
        total = total + _col(c)
    return total / len(columns)


def companion_mask(c: Column | str) -> Column:
    """1 where the value is missing."""
    return _col(c).isNull().cast("byte")


def per_unit(c: Column | str, rated: Column | str) -> Column:
    """Clipped to 0 … rated and divided by it; null stays null (least and greatest would skip it)."""
    x, r = _col(c), _col(rated)
    return F.when(x.isNotNull() & r.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), r) / r)


def log_count(c: Column | str) -> Column:
    return F.when(_col(c).isNotNull(), F.log1p(F.greatest(_col(c).cast("double"), F.lit(0.0))))


def zscore(c: Column | str, mean: Column, std: Column) -> Column:
    """Standardised; a spread of 0 counts as 1, a missing or non-finite result as 0."""
    z = (_col(c) - mean) / F.when(std > 0, std).otherwise(F.lit(1.0))
    return F.coalesce(F.when(~F.isnan(z) & (F.abs(z) != float("inf")), z), F.lit(0.0))


def any_of(*conditions: Column) -> Column:
    """Whether any condition holds; a null one doesn't."""
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def all_of(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def local_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres east and north of an origin, equirectangular."""
    x = (lon - lon0) * RADIANS * F.cos(lat0 * RADIANS) * EARTH_METRES
    return x, (lat - lat0) * RADIANS * EARTH_METRES
