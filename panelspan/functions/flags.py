"""Pipe-separated flag lists as column expressions: join, test, strip, count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: flag tokens by level
MISSING_ROW, MISSING_TARGET = "missing_row", "missing_target"
CONFLICT_RESOLVED, DUPLICATE_RESOLVED = "conflict_resolved", "duplicate_conflict_resolved"
MISSING_COVARIATES, SOURCE_CONFLICT = "missing_past_covariates", "feature_source_conflict"
PARTIAL_INPUT, PARTIAL_OUTPUT = "partial_input", "partial_output"
MASKED_INPUT, MASKED_OUTPUT = "masked_input", "masked_output"
ROW_ISSUES = "row_quality_issues"
FEATURE_ISSUES_INPUT, FEATURE_ISSUES_OUTPUT = "feature_quality_issues_input", "feature_quality_issues_output"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(flags: Column | str) -> Column:
    """The non-blank tokens of a flag list, trimmed, in order; a null has none."""
    parts = F.transform(F.split(F.coalesce(_col(flags), F.lit("")), r"[|]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def join_flags(*flags: Column | str) -> Column:
    """All tokens of the lists, each once, in order of first sight."""
    return F.array_join(F.array_distinct(tokens(F.concat_ws("|", *map(_col, flags)))), "|")


def join_flag_arrays(lists: Column | str) -> Column:
    """The same over an array of flag lists."""
    return F.array_join(F.array_distinct(tokens(F.array_join(_col(lists), "|"))), "|")


def has_token(flags: Column | str, token: str) -> Column:
    return F.array_contains(tokens(flags), token)


def strip_flags(flags: Column | str, ignored: list[str]) -> Column:
    """The list without the ignored tokens, each of the others once."""
    return F.array_join(F.array_distinct(F.filter(tokens(flags), lambda x: ~x.isin(ignored))), "|")


def flag_when(condition: Column, token: str) -> Column:
    """The token where the condition holds, else null; concat_ws skips nulls."""
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(token))


def flag_list(*parts: Column) -> Column:
    """flag_when parts as one list, '' if none holds."""
    return F.concat_ws("|", *parts)


def clean_text(c: Column | str, missing: tuple[str, ...] = ("", "-")) -> Column:
    """Trimmed text, null if it is a missing mark."""
    x = F.trim(_col(c))
    return F.when(~x.isin(list(missing)), x)
