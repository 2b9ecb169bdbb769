"""Dimension lookups, annotations, unions and differences of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, dimension: DataFrame, key: str, required: bool = True) -> DataFrame:
    """rows with the dimension's columns; those without a match are dropped, or kept with nulls.

    No broadcast hint: Catalyst and AQE broadcast the dimension if its size allows.
    """
    return rows.join(dimension, key, "inner" if required else "left")


def unmatched(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """The distinct keys of rows that the dimension lacks, nulls included."""
    return rows.select(key).distinct().join(dimension.select(key), key, "left_anti")


def members(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys are among the wanted ones; Spark broadcasts those if their size allows."""
    return rows.join(wanted.select(*keys), keys, "left_semi")


def annotate(rows: DataFrame, provenance: DataFrame, key: str) -> DataFrame:
    """rows with provenance columns by variant; an unknown variant is an error."""
    unknown = [r[0] for r in unmatched(rows, provenance, key).limit(10).collect()]
    if unknown:
        raise ValueError(f"unknown {key}: {unknown}")
    return lookup(rows, provenance, key)


def diagonal_union(frames: list[DataFrame]) -> DataFrame:
    """All rows in the union of the columns, in order of first sight; columns of different types become the wider one, or text."""
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for c, t in f.dtypes:
            kinds.setdefault(c, set()).add(t)
    order = ["tinyint", "smallint", "int", "bigint", "float", "double"]
    wide = {c: next(iter(ts)) if len(ts) == 1 else max(ts, key=order.index) if ts <= set(order) else "string" for c, ts in kinds.items()}
    same = [f.select(*[F.col(f"`{c}`").cast(wide[c]).alias(c) for c in f.columns]) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), same).select(*[F.col(f"`{c}`") for c in kinds])


def key_difference(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): keys that are missing from found, and keys that found has beyond the expected."""
    e, f = expected.select(*keys).distinct(), found.select(*keys).distinct()
    gone = e.join(f, keys, "left_anti").withColumn("side", F.lit("missing"))
    return gone.unionByName(f.join(e, keys, "left_anti").withColumn("side", F.lit("extra")))
