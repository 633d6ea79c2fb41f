"""Conditions of a statement as columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import filters
from .lexer import StatementError
from .nodes import Between, Both, Compare, Either, Finetuned, In, IsNull

COMPARE = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def _column(df: DataFrame, name: str) -> Column | None:
    return F.col(name) if name.split(".")[0] in df.columns else None


def condition(df: DataFrame, node: Any, strict: bool = False) -> Column:
    """``strict``: < and > leave their bound out, as in SQL; else they take it in.

    A name that is no column is a key of the model's JSON and can be compared
    for equality only.
    """
    if isinstance(node, (Both, Either)):
        out = condition(df, node.parts[0], strict)
        for part in node.parts[1:]:
            other = condition(df, part, strict)
            out = out & other if isinstance(node, Both) else out | other
        return out
    if isinstance(node, Finetuned):
        return filters.not_finetuned(F.col("tag")) if node.negated else F.lit(True)
    c = _column(df, node.column)
    if isinstance(node, IsNull):
        c = c if c is not None else F.get_json_object("json_model", f"$.{node.column}")
        return c.isNotNull() if node.negated else c.isNull()
    if isinstance(node, In):
        c = c if c is not None else F.get_json_object("json_model", f"$.{node.column}")
        return c.isNotNull() & ~filters.is_in(c, list(node.values)) if node.negated else filters.is_in(c, list(node.values))
    if isinstance(node, Between):
        if c is None:
            raise StatementError(f"no such column: {node.column}")
        return filters.in_range(c, node.low, node.high)
    assert isinstance(node, Compare)
    if c is None:
        if node.op != "=" or "json_model" not in df.columns:
            raise StatementError(f"no such column: {node.column}")
        return filters.json_equals(F.col("json_model"), node.column, node.value)
    op = node.op if strict else {"<": "<=", ">": ">="}.get(node.op, node.op)
    return getattr(c, COMPARE[op])(F.lit(node.value))


def filtered(df: DataFrame, node: Any, strict: bool = False) -> DataFrame:
    """OR at the top gives a scan for each alternative, and rows that meet two come twice."""
    if node is None:
        return df
    if isinstance(node, Either):
        return filters.any_of(df, [condition(df, p, strict) for p in node.parts])
    return df.filter(condition(df, node, strict))
