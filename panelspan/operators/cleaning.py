"""Duplicate and conflicting readings: best-value merge, conflict nulling, audits, effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspan.functions import flags as X

ALL_KINDS = ("conflict", "normalized_equal", "identical")


def present(c: str) -> Column:
    """A raw cell that isn't blank or a missing mark."""
    x = F.trim(F.col(c).cast("string"))
    return F.coalesce((x != "") & ~x.isin("NaN", "nan", "-"), F.lit(False))


def _differs(x: Column) -> Column:
    """More than one distinct value: its least isn't its greatest, which needs no distinct count."""
    return F.coalesce(F.min(x) != F.max(x), F.lit(False))


def _raw(c: str) -> Column:
    return F.when(present(c), F.trim(F.col(c).cast("string")))


def merge_best_value(rows: DataFrame, keys: list[str], columns: list[str], order: str, counted: list[str] | None = None) -> DataFrame:
    """One row a key: each column's value from the row with most cells present, the earliest on ties.

    counted: the columns whose presence ranks rows (default: columns). Adds
    row_conflict_count, columns with more than one distinct raw string, and source_row_count.
    One aggregation with partial results before its one shuffle.
    """
    filled = sum((present(c).cast("int") for c in counted or columns), F.lit(0))
    rank = F.struct((-filled).alias("f"), F.col(order).alias("o"))
    best = [F.min(F.when(present(c), F.struct(rank.alias("r"), F.col(c).alias("v"))))["v"].alias(c) for c in columns]
    conflict = sum((_differs(_raw(c)).cast("int") for c in columns), F.lit(0))
    return rows.groupBy(*keys).agg(*best, conflict.cast("int").alias("row_conflict_count"), F.count("*").alias("source_row_count"))


def merge_conflicts(rows: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """(keys, column_name, kept_value, other_value): one row for each losing distinct raw value, in value order.

    Only rows of keys that have a conflict are taken apart, and of those only the columns in conflict.
    """
    filled = sum((present(c).cast("int") for c in columns), F.lit(0))
    names = F.filter(F.array(*[F.when(_differs(_raw(c)), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    odd = rows.groupBy(*keys).agg(names.alias("__names")).filter(F.size("__names") > 0)
    cell = F.coalesce(*[F.when(F.col("column_name") == c, _raw(c)) for c in columns])
    cells = rows.join(odd, keys).select(*rows.columns, F.explode("__names").alias("column_name"))
    cells = cells.select(*keys, "column_name", (-filled).alias("__f"), F.col(order).alias("__o"), cell.alias("value")).filter("value IS NOT NULL")
    per = cells.groupBy(*keys, "column_name").agg(F.min(F.struct("__f", "__o", "value"))["value"].alias("kept_value"), F.collect_set("value").alias("values"))
    losing = F.array_sort(F.array_except("values", F.array("kept_value")))
    return per.select(*keys, "column_name", "kept_value", F.explode(losing).alias("other_value"))


def normalised(c: str, kind: str) -> Column:
    """What values are compared by: numbers and booleans rounded to 12 digits (half even), texts trimmed with '' as null."""
    if kind in ("string",):
        x = F.trim(F.col(c))
        return F.when(x != "", x)
    x = F.col(c).cast("double")
    return F.bround(F.when(~F.isnan(x), x), 12)


def resolve_duplicates(rows: DataFrame, keys: list[str], payload: list[str], order: list[str]) -> DataFrame:
    """One row a key with every payload column resolved, and what was found on the way.

    More than one normalised value: null, a conflict. Raw values that differ only before
    normalising: normalized_equal. Else identical. Values are the first row's by the given
    order, which must be total for the result to be reproducible. Adds duplicate_count,
    duplicate_kind (null for single rows), conflict_columns and normalized_columns.
    Keys with a null are left alone: each of their rows stays.
    """
    kinds = dict(rows.dtypes)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    # one struct holds the order and the whole payload, so the first row is one minimum
    first = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], *[F.col(c).alias(f"v{i}") for i, c in enumerate(payload)])
    aggs = [F.count("*").alias("duplicate_count"), F.min(first).alias("__first")]
    for c in payload:
        raw = F.col(c) if kinds[c] in ("tinyint", "smallint", "int", "bigint", "boolean", "string") else F.col(c).cast("string")
        some = (F.count(c) > 0) & (F.count(c) < F.count("*"))
        aggs += [_differs(normalised(c, kinds[c])).alias(f"__x_{c}"), (_differs(raw) | some).alias(f"__r_{c}")]
    out = rows.filter(whole).groupBy(*keys).agg(*aggs).select("*", *[F.col(f"__first.v{i}").alias(c) for i, c in enumerate(payload)])
    pick = lambda mark: F.filter(F.array(*[F.when(mark(c), F.lit(c)) for c in payload]), lambda x: x.isNotNull())
    out = out.withColumn("conflict_columns", pick(lambda c: F.col(f"__x_{c}"))).withColumn("normalized_columns", pick(lambda c: F.col(f"__r_{c}") & ~F.col(f"__x_{c}")))
    kind = F.when(F.col("duplicate_count") == 1, None).when(F.size("conflict_columns") > 0, "conflict").when(F.size("normalized_columns") > 0, "normalized_equal").otherwise("identical")
    out = out.withColumn("duplicate_kind", kind).withColumns({c: F.when(~F.col(f"__x_{c}"), F.col(c)) for c in payload})
    done = out.select(*keys, *payload, "duplicate_count", "duplicate_kind", "conflict_columns", "normalized_columns")
    loose = rows.filter(~whole).select(*keys, *payload, F.lit(1).cast("long").alias("duplicate_count"), F.lit(None).cast("string").alias("duplicate_kind"), F.array().cast("array<string>").alias("conflict_columns"), F.array().cast("array<string>").alias("normalized_columns"))
    return done.unionByName(loose)


def duplicate_audit(resolved: DataFrame, keys: list[str], table: str) -> DataFrame:
    """One row for each key that had duplicates."""
    return resolved.filter("duplicate_count > 1").select(F.lit(table).alias("source_table"), *keys, "duplicate_count", "duplicate_kind", "conflict_columns", "normalized_columns")


def duplicate_effects(audit: DataFrame, scope: str, group: str) -> DataFrame:
    """The conflicts' effects: a row flag for scope 'row', a feature flag with the group's name otherwise."""
    flag = X.DUPLICATE_RESOLVED if scope == "row" else f"{X.SOURCE_CONFLICT}__{group}"
    return audit.filter("duplicate_kind = 'conflict'").withColumn("effect_scope", F.lit(scope)).withColumn("flag", F.lit(flag)).drop("normalized_columns", "duplicate_kind")


def expand_site_effects(effects: DataFrame, panel_keys: DataFrame) -> DataFrame:
    """Site effects (dataset, timestamp, …) for each entity that the panel has at that time."""
    return panel_keys.select("dataset", "turbine_id", "timestamp").distinct().join(effects, ["dataset", "timestamp"])


def effects_for_entities(effects: DataFrame, entities: DataFrame) -> DataFrame:
    """Site effects (dataset, …) for every registered entity (dataset, turbine_id), whether the panel has it then or not."""
    return effects.join(entities.select("dataset", "turbine_id").distinct(), "dataset")


def aggregate_effects(effects: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Distinct columns and flags of each key, in order of first sight."""
    w = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "conflict_columns", "flag")))
    out = effects.groupBy(*keys).agg(w.alias("e"))
    return out.select(*keys, F.array_distinct(F.flatten(F.transform("e", lambda x: x["conflict_columns"]))).alias("conflict_columns"), X.join_flag_arrays(F.transform("e", lambda x: x["flag"])).alias("flags"))


def duplicate_report(audit: DataFrame) -> DataFrame:
    """Duplicated keys by table and kind."""
    return audit.groupBy("source_table", "duplicate_kind").agg(F.count("*").alias("key_count"), F.sum("duplicate_count").alias("row_count"))


def split_on_duplicates(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of duplicated keys, the rest): one window count for both; a null key counts as single."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    counted = rows.withColumn("__n", F.when(null, F.lit(1)).otherwise(F.count("*").over(Window.partitionBy(*keys))))
    return counted.filter("__n > 1").drop("__n"), counted.filter("__n = 1").drop("__n")


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an explicit order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")
