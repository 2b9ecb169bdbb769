"""Column policies and mask rules: what is kept, dropped or nulled, and whether all columns are covered."""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECISIONS = {"keep": "keep", "drop": "drop", "keep+mask": "keep+mask", "mask+keep": "keep+mask"}
_OPS = {"eq": operator.eq, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}


@dataclass(frozen=True)
class PolicyRow:
    asset: str
    table: str
    column: str
    decision: str
    rule: str = ""


def load_policy(rows: list[dict[str, str]]) -> list[PolicyRow]:
    """Checked policy rows: known decisions, no column twice."""
    out, seen = [], set()
    for r in rows:
        p = PolicyRow(*(str(r.get(k) or "").strip() for k in ("asset", "table", "column", "decision", "rule")))
        if p.decision not in DECISIONS:
            raise ValueError(f"unknown decision {p.decision!r} for {p.column!r}")
        if (p.asset, p.table, p.column) in seen:
            raise ValueError(f"column {p.column!r} is there twice")
        seen.add((p.asset, p.table, p.column))
        out.append(PolicyRow(p.asset, p.table, p.column, DECISIONS[p.decision], p.rule))
    return out


def uncovered(inventory: DataFrame, policy: DataFrame) -> DataFrame:
    """Inventoried columns without a policy row; must be empty."""
    return inventory.join(policy.select("asset", "table", "column"), ["asset", "table", "column"], "left_anti")


def kept_columns(policy: list[PolicyRow], asset: str, table: str, always: tuple[str, ...] = ()) -> list[str]:
    """always first, then what isn't dropped in policy order."""
    own = [p.column for p in policy if (p.asset, p.table) == (asset, table) and p.decision != "drop"]
    return list(dict.fromkeys([*always, *own]))


def project(df: DataFrame, kept: list[str]) -> DataFrame:
    """The kept columns that df has; Catalyst prunes the scan to them."""
    there = set(df.columns)
    return df.select(*[F.col(f"`{c}`") for c in kept if c in there])


# fixed values: the named mask rules, by the cells they null
def named_rule(rule: str, column: str, power: str = "Patv", speed: str = "Wspd") -> Column:
    c = F.col(f"`{column}`")
    if rule == "sdwpf_unknown_patv_wspd":
        return (F.col(power) <= 0) & (F.col(speed) > 2.5)
    if rule == "sdwpf_wdir_out_of_range":
        return (c < -180) | (c > 180)
    if rule == "sdwpf_ndir_out_of_range":
        return (c < -720) | (c > 720)
    if rule == "sdwpf_pitch_gt_89":
        return c > 89
    raise ValueError(f"unknown mask rule {rule!r}")


# fixed values: the flags of unknown and of abnormal readings of a day/clock panel, and what they stand for
def reading_flags(columns: list[str]) -> dict[str, Column]:
    """Flag -> whether a row has it, in flag order: no power though the wind blows, a blade turned out of the wind,
    a nacelle or a wind direction outside its possible range; what can't be compared has no flag."""
    pitch = [F.coalesce(named_rule("sdwpf_pitch_gt_89", c), F.lit(False)) for c in ("Pab1", "Pab2", "Pab3") if c in columns]
    return {
        "sdwpf_unknown_patv_wspd": F.coalesce(named_rule("sdwpf_unknown_patv_wspd", "Patv"), F.lit(False)),
        "sdwpf_unknown_pitch": reduce(operator.or_, pitch, F.lit(False)),
        "sdwpf_abnormal_ndir": F.coalesce(named_rule("sdwpf_ndir_out_of_range", "Ndir"), F.lit(False)),
        "sdwpf_abnormal_wdir": F.coalesce(named_rule("sdwpf_wdir_out_of_range", "Wdir"), F.lit(False)),
    }


def apply_masks(df: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """Null the cells whose condition holds; an unknown condition keeps the cell. All conditions see the unmasked row."""
    return df.withColumns({c: F.when(F.coalesce(m, F.lit(False)), F.lit(None)).otherwise(F.col(f"`{c}`")) for c, m in masks.items() if c in df.columns})


_CLAUSE = re.compile(r"^\s*(eq|lt|le|gt|ge)\s*:\s*(.+?)\s*$")


def literal(text: str):
    """true/false, an integer, a number, or the text itself."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def predicate(column: str, clauses: str) -> Column:
    """A mask of op:value clauses joined by | (any holds); null comparisons are false."""
    parts = []
    for clause in clauses.split("|"):
        m = _CLAUSE.match(clause)
        if not m:
            raise ValueError(f"not a mask clause: {clause!r}")
        parts.append(F.coalesce(_OPS[m[1]](F.col(f"`{column}`"), F.lit(literal(m[2]))), F.lit(False)))
    return reduce(operator.or_, parts)


def apply_feature_policy(df: DataFrame, decisions: dict[str, str], masks: dict[str, str], expected: list[str], allow_extra: bool = False) -> DataFrame:
    """Drop and mask features; the features decided on must be the expected ones, unless extra ones are allowed."""
    missing, extra = sorted(set(expected) - set(decisions)), sorted(set(decisions) - set(expected))
    if missing or extra and not allow_extra:
        raise ValueError(f"features without a decision: {missing}; decisions without a feature: {extra}")
    masked = apply_masks(df, {c: predicate(c, m) for c, m in masks.items() if c in df.columns})
    return masked.drop(*[c for c, d in decisions.items() if d == "drop"])


def outside_rule(column: str, low: float = -10.0, high: float = 95.0) -> Column:
    """Outside a closed interval."""
    c = F.col(f"`{column}`")
    return F.coalesce((c < low) | (c > high), F.lit(False))


def rule_diagnostics(df: DataFrame, columns: list[str], low: float = -10.0, high: float = 95.0) -> DataFrame:
    """Rows that a rule hits in any column, and rows not hit that miss an input: the rule goes first."""
    hit = reduce(operator.or_, [outside_rule(c, low, high) for c in columns])
    gone = reduce(operator.or_, [F.col(f"`{c}`").isNull() for c in columns])
    return df.agg(F.count_if(hit).alias("rule_rows"), F.count_if(~hit & gone).alias("missing_rows"), F.count("*").alias("rows"))


def normalise_headers(names: list[str]) -> list[str]:
    """Trimmed names without blank ones; duplicates after trimming are an error."""
    out = [n.strip() for n in names if n.strip()]
    twice = sorted({n for n in out if out.count(n) > 1})
    if twice:
        raise ValueError(f"duplicate columns after trimming: {twice}")
    return out


def schema_inventory(headers: DataFrame) -> DataFrame:
    """(asset, table, column, file_count, examples) from header rows (path, asset, table, column)."""
    return headers.groupBy("asset", "table", "column").agg(F.count_distinct("path").alias("file_count"), F.slice(F.array_sort(F.collect_set("path")), 1, 3).alias("examples"))
