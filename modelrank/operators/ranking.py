"""Orders, limits and reductions of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REDUCERS = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


def order(df: DataFrame, key: str, descending: bool = False, tie: str = "json_model") -> DataFrame:
    """By one key, nulls last, then by the model."""
    c = F.col(key)
    first = c.desc_nulls_last() if descending else c.asc_nulls_last()
    return df.orderBy(first, *([F.col(tie)] if tie in df.columns and tie != key else []))


def limit(df: DataFrame, n: int | None) -> DataFrame:
    """The first rows; 0 or nothing means all."""
    return df.limit(n) if n else df


def top_per(df: DataFrame, by: list[str], key: str, n: int, descending: bool = False, tie: str = "model") -> DataFrame:
    """The first ``n`` rows of each group, with their rank."""
    c = F.col(key)
    w = Window.partitionBy(*by).orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def over_benchmark(df: DataFrame, by: list[str], function: str | None = None, metric: str = "err") -> DataFrame:
    """One value for each model over the readers of a benchmark; the mean unless told otherwise."""
    return df.groupBy(*by).agg(REDUCERS[(function or "avg").lower()](metric).alias(metric))


def other_than(df: DataFrame, seen: DataFrame, key: str = "json_model") -> DataFrame:
    return df.join(seen.select(key).distinct(), key, "left_anti")


def accuracy(err: Column) -> Column:
    return 1 - err


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def running_mean(df: DataFrame, by: list[str], order_by: str, value: str, weight: str) -> DataFrame:
    """Weighted mean of all rows so far."""
    w = Window.partitionBy(*by).orderBy(order_by).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(F.col(value) * F.col(weight)).over(w) / F.sum(weight).over(w))


def in_order(df: DataFrame, column: str, values: list[str], tie: str | None = None) -> DataFrame:
    """Rows by a given order of a column's values, others last."""
    place = F.lit(len(values))
    for i, v in reversed(list(enumerate(values))):
        place = F.when(F.col(column) == v, i).otherwise(place)
    return df.orderBy(place, column, *([tie] if tie else []))


def matrix(df: DataFrame, row: str, column: str, value: str, columns: list[str] | None = None) -> DataFrame:
    """One row for each ``row`` and a column for each value of ``column``."""
    return df.groupBy(row).pivot(column, columns).agg(F.first(value)).orderBy(row)


def union_of_keys(tables: list[DataFrame]) -> DataFrame:
    """Tables under each other; a key that one lacks is empty there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in out.columns])
