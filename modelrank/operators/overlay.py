"""Edits of single rows over a base dataset, and what they spare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import check_indices


def edits(seq: int, changes: DataFrame, base_indices: list[int], change_indices: list[int], features: bool, labels: bool, like: DataFrame | None = None) -> DataFrame:
    """(seq, base_idx, embed, label): row ``change_indices[i]`` of ``changes``
    takes the place of row ``base_indices[i]``, with features, label or both.
    ValueError: an index that ``changes`` doesn't have.  A column that it lacks
    is null, of the type that it has in ``like``."""
    check_indices(base_indices)
    check_indices(change_indices)
    if len(base_indices) != len(change_indices):
        raise ValueError("as many rows come as go")
    spark = changes.sparkSession
    pairs = spark.createDataFrame(list(zip(base_indices, change_indices)), "base_idx long, change_idx long")
    rows = changes.withColumnRenamed("row_idx", "change_idx").join(F.broadcast(pairs), "change_idx")  # one row for each edit of the statement
    there = rows.select("change_idx").distinct().count()
    if there < len(change_indices):
        raise ValueError(f"{len(change_indices) - there} of the rows to change to don't exist")
    types = {f.name: f.dataType for held in (like, changes) if held is not None for f in held.schema.fields}

    def value(name: str, wanted: bool):
        return F.col(name) if wanted and name in changes.columns else F.lit(None).cast(types[name])

    return rows.select(F.lit(seq).alias("seq"), "base_idx", value("embed", features).alias("embed"), value("label", labels).alias("label"))


def apply_overlay(base: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("row_idx",)) -> DataFrame:
    """Base rows with the last edit of their features and the last of their label.

    ``changes`` has seq, base_idx and, null where an edit leaves them, embed and
    label.  Features and labels are overlaid each on its own.
    """
    last = changes.groupBy("base_idx").agg(*[F.expr(f"max_by({c}, seq) FILTER (WHERE {c} IS NOT NULL)").alias(f"__{c}") for c in ("embed", "label")])
    out = base.join(last, base[keys[0]] == last["base_idx"], "left")
    return out.select(*[F.coalesce(f"__{c}", c).alias(c) if c in ("embed", "label") else base[c] for c in base.columns])


def relabel(nearest: DataFrame, label_edits: DataFrame, side: str = "train") -> DataFrame:
    """Stored nearest neighbours with edited labels of the training rows, or of
    the test rows: no distance is computed.

    ``label_edits`` has reader_idx, idx, label and seq; the last one counts, and
    readers that don't occur are passed over.
    """
    label = f"{side}_label"
    last = label_edits.groupBy("reader_idx", "idx").agg(F.max_by("label", "seq").alias("__label"))
    on = (nearest[f"{side}_reader"] == last["reader_idx"]) & (nearest[f"{side}_idx"] == last["idx"])
    return nearest.join(last, on, "left").select(*[F.coalesce("__label", c).alias(c) if c == label else nearest[c] for c in nearest.columns])


def closing_label_edits(only_labels: list[bool]) -> tuple[int, int]:
    """How many edits come first, and how many label-only ones close the list."""
    n = 0
    while n < len(only_labels) and only_labels[-1 - n]:
        n += 1
    return len(only_labels) - n, n


def slice_edits(changes: DataFrame, start: int, stop: int) -> DataFrame:
    """Edits of the rows [start, stop), counted from the slice's begin."""
    inside = (F.col("base_idx") >= start) & (F.col("base_idx") < stop)
    return changes.filter(inside).withColumn("base_idx", F.col("base_idx") - start)
