"""Predicates over a model catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINETUNED = "finetuned"


def in_range(column: Column, low, high) -> Column:
    """Inclusive on both sides; nulls never match; the bounds are in order."""
    if low is not None and high is not None and low > high:
        raise ValueError(f"no such range: {low} to {high}")
    parts = [column >= F.lit(low)] * (low is not None) + [column <= F.lit(high)] * (high is not None)
    return parts[0] & parts[-1] if parts else F.lit(True)


def not_finetuned(tag: Column) -> Column:
    return ~F.array_contains(F.coalesce(tag, F.array().cast("array<string>")), FINETUNED)


def has_any_tag(tag: Column, tags: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(tag, F.array(*map(F.lit, tags))), F.lit(False))


def json_equals(json: Column, key: str, value) -> Column:
    """Whether a key of the model's configuration has a value; a missing key never does."""
    return F.coalesce(F.get_json_object(json, f"$.{key}") == F.lit(str(value)), F.lit(False))


def any_of(df: DataFrame, conditions: list[Column]) -> DataFrame:
    """One scan for each condition, one after another: a row that meets two comes twice."""
    out = df.filter(conditions[0])
    for c in conditions[1:]:
        out = out.unionAll(df.filter(c))
    return out


def is_in(column: Column, values: list) -> Column:
    """Membership of a short list; nulls never are members."""
    return F.coalesce(column.isin(values), F.lit(False))


def at_indices(df: DataFrame, indices: list[int], keep: bool = True, idx: str = "row_idx") -> DataFrame:
    """Rows whose number is in a set, or all others; the set is as long as the statement that has it."""
    return df.filter(is_in(F.col(idx), indices) if keep else ~is_in(F.col(idx), indices))


def counted(df: DataFrame, condition: Column, stated: int) -> DataFrame:
    """Rows that meet a condition, of which there must be as many as stated."""
    out = df.filter(F.coalesce(condition, F.lit(False)))
    n = out.count()
    if n != stated:
        raise ValueError(f"{stated} rows were stated, {n} meet the condition")
    return out
