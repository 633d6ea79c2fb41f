"""The nearest training row of every test row, for many models at once.

Rows are packed in blocks of a bounded number of rows, kept apart by model,
and every test block meets every training block of its model.  The pairs are
dealt over a square grid: a test block goes to every cell of its row of the
grid, a training block to every cell of its column, so a cell holds a share of
both sides, each block is copied as often as the root of the cores, and one
model fills them all.  A pair of blocks is one matrix product; what leaves it
is one row for each test row, and a minimum over training blocks follows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.scratch import importable

EUCLIDEAN, COSINE = "Euclidean NN", "Cosine NN"
BLOCK_ROWS = 4096
KEYS = ("model", "test_reader", "test_idx")


def _rows(df: DataFrame) -> DataFrame:
    """With model and reader_idx where they are missing."""
    for name, value in (("model", F.lit("")), ("reader_idx", F.lit(0))):
        df = df if name in df.columns else df.withColumn(name, value)
    return df.select("model", F.col("reader_idx").cast("int").alias("reader_idx"), F.col("row_idx").cast("long").alias("row_idx"), F.col("label").cast("long").alias("label"), V.doubles(F.col("embed")).alias("embed"))


def _blocks(df: DataFrame, rows: int) -> DataFrame:
    """(model, readers, ids, labels, vectors): up to ``rows`` rows of a model in one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for model, part in batch.groupby("model"):
                for a in range(0, len(part), rows):
                    some = part.iloc[a : a + rows]
                    v = np.array(some["embed"].tolist(), np.float64)
                    yield pd.DataFrame({"model": [model], "readers": [some["reader_idx"].astype("<i8").to_numpy().tobytes()], "ids": [some["row_idx"].astype("<i8").to_numpy().tobytes()], "labels": [some["label"].astype("<i8").to_numpy().tobytes()], "vectors": [v.astype("<f8").tobytes()], "width": [v.shape[1]]})

    importable(df.sparkSession)
    return df.mapInPandas(run, "model string, readers binary, ids binary, labels binary, vectors binary, width long")


def _numbers(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<i8")


def nearest_of(test: np.ndarray, train: np.ndarray, readers: np.ndarray, ids: np.ndarray, cosine: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each test row the place of its nearest training row and the squared
    distance; ties go to the smaller (reader, id).  Null components are NaN
    here, and such rows are farther than all others."""
    order = np.lexsort((ids, readers))
    train = train[order]
    if cosine:
        with np.errstate(invalid="ignore", divide="ignore"):
            test, train = (x / np.sqrt((x * x).sum(1, keepdims=True)) for x in (test, train))
    approx = (test * test).sum(1)[:, None] - 2 * test @ np.nan_to_num(train).T + np.nan_to_num((train * train).sum(1))
    approx[:, np.isnan(train).any(1)] = np.inf
    approx[np.isnan(test).any(1)] = np.inf
    least = approx.min(1)
    place, value = np.zeros(len(test), np.int64), np.full(len(test), np.inf)
    scale = 1e-9 * (1 + (test * test).sum(1))
    row, column = np.nonzero(approx <= (least + np.nan_to_num(scale))[:, None])
    exact = ((test[row] - train[column]) ** 2).sum(1)
    exact = np.where(np.isnan(exact), np.inf, exact)
    best = np.lexsort((column, exact, row))
    first = best[np.unique(row[best], return_index=True)[1]]
    place[row[first]], value[row[first]] = order[column[first]], exact[first]
    return place, value


def nearest(test: DataFrame, train: DataFrame, metric: str = EUCLIDEAN, rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each test row of each model: model, test_reader, test_idx,
    test_label, train_reader, train_idx, train_label, distance (squared).

    Both sides have row_idx, label, embed and may have model and reader_idx.
    Ties go to the smaller (reader_idx, row_idx).  Without training rows there
    is no result.
    """
    if metric not in (EUCLIDEAN, COSINE):
        raise ValueError(f"no such classifier: {metric}")
    cosine = metric == COSINE
    side = max(1, math.isqrt(test.sparkSession.sparkContext.defaultParallelism))
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    place = F.pmod(F.xxhash64("readers", "ids"), F.lit(side)).cast("int")
    a = _blocks(_rows(test), rows).select("model", place.alias("i"), every.alias("j"), *[F.col(c).alias(f"t_{c}") for c in ("readers", "ids", "labels", "vectors", "width")])
    b = _blocks(_rows(train), rows).select("*", place.alias("j"), every.alias("i"))
    pairs = a.join(b, ["model", "i", "j"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                x = np.frombuffer(r.t_vectors, "<f8").reshape(-1, r.t_width)
                y = np.frombuffer(r.vectors, "<f8").reshape(-1, r.width)
                if r.t_width != r.width:
                    raise ValueError(f"vectors of {r.t_width} and {r.width} values")
                readers, ids = _numbers(r.readers), _numbers(r.ids)
                place, value = nearest_of(x, y, readers, ids, cosine)
                yield pd.DataFrame({"model": r.model, "test_reader": _numbers(r.t_readers), "test_idx": _numbers(r.t_ids), "test_label": _numbers(r.t_labels), "distance": value, "train_reader": readers[place], "train_idx": ids[place], "train_label": _numbers(r.labels)[place]})

    found = pairs.mapInPandas(run, "model string, test_reader int, test_idx long, test_label long, distance double, train_reader int, train_idx long, train_label long")
    return merged(found)


def merged(found: DataFrame) -> DataFrame:
    """The nearest over blocks and readers: by distance, then reader and row."""
    least = F.min(F.struct("distance", "train_reader", "train_idx", "train_label", "test_label"))
    out = found.groupBy(*KEYS).agg(least.alias("b"))
    return out.select(*KEYS, "b.test_label", "b.train_reader", "b.train_idx", "b.train_label", "b.distance")


def nearest_sql(test: DataFrame, train: DataFrame, metric: str = EUCLIDEAN) -> DataFrame:
    """The same in expressions alone: every pair is a row, so only for small tables."""
    a, b = (_rows(x) for x in (test, train))
    if metric == COSINE:
        a, b = (x.withColumn("embed", V.l2_normalize(F.col("embed"))) for x in (a, b))
    a = a.select("model", F.col("reader_idx").alias("test_reader"), F.col("row_idx").alias("test_idx"), F.col("label").alias("test_label"), F.col("embed").alias("x"))
    b = b.select("model", F.col("reader_idx").alias("train_reader"), F.col("row_idx").alias("train_idx"), F.col("label").alias("train_label"), F.col("embed").alias("y"))
    return merged(a.join(b, "model").withColumn("distance", F.coalesce(V.squared_distance(F.col("x"), F.col("y")), F.lit(float("inf")))))


def errors(found: DataFrame, *by: str) -> DataFrame:
    """(*by, n, raw_error, err): how many test rows got a wrong label, and their share."""
    wrong = F.sum((F.col("test_label") != F.col("train_label")).cast("long"))
    out = found.groupBy(*by).agg(F.count("*").alias("n"), wrong.alias("raw_error"))
    return out.withColumn("err", F.col("raw_error") / F.col("n"))
