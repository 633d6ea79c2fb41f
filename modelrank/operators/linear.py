"""Linear probe: one softmax layer, full-batch gradient descent from zero.

Every epoch is one pass of partial gradients over blocks of rows; the driver
holds the weights (classes by width, for each model), which don't grow with
the data.  Where a model's rows are few, all epochs run in one task instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.scratch import importable, kept

LEARNING_RATE, EPOCHS = 0.1, 100
#: Values (rows by width) up to which one task trains a model.
SMALL_VALUES = 50_000_000


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradient(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Summed over rows; the last row of w is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    p = softmax(x @ w)
    p[np.arange(len(y)), y] -= 1
    return x.T @ p


def fit(x: np.ndarray, y: np.ndarray, classes: int, rate: float, epochs: int) -> np.ndarray:
    w = np.zeros((x.shape[1] + 1, classes))
    for _ in range(epochs):
        w -= rate * gradient(w, x, y) / len(x)
    return w


def _rows(df: DataFrame) -> DataFrame:
    df = df if "model" in df.columns else df.withColumn("model", F.lit(""))
    return df.select("model", F.col("row_idx").cast("long").alias("row_idx"), F.col("label").cast("long").alias("label"), V.doubles(F.col("embed")).alias("embed"))


def _arrays(pdf: pd.DataFrame, classes: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(pdf["embed"].tolist(), np.float64).reshape(len(pdf), -1)
    return np.nan_to_num(x), np.array([classes[v] for v in pdf["label"]], np.int64)


def linear_probe(train: DataFrame, test: DataFrame, learning_rate: float = LEARNING_RATE, epochs: int = EPOCHS, small: int = SMALL_VALUES) -> DataFrame:
    """(model, n, raw_error, err) of the probe; classes are the labels of both sides."""
    spark = train.sparkSession
    importable(spark)
    train, test = _rows(train), _rows(test)
    labels = sorted(r.label for r in train.select("label").unionAll(test.select("label")).distinct().collect())
    classes = {v: i for i, v in enumerate(labels)}
    sizes = train.groupBy("model").agg((F.count("*") * F.max(F.size("embed"))).alias("values"), F.max(F.size("embed")).alias("width")).collect()
    if max((r["values"] for r in sizes), default=0) <= small:

        def learn(pdf: pd.DataFrame) -> pd.DataFrame:
            x, y = _arrays(pdf.sort_values("row_idx"), classes)
            return pd.DataFrame({"model": [pdf["model"].iloc[0]], "w": [fit(x, y, len(classes), learning_rate, epochs).astype("<f8").tobytes()]})

        weights = {r.model: np.frombuffer(bytes(r.w), "<f8").reshape(-1, len(classes)) for r in train.groupBy("model").applyInPandas(learn, "model string, w binary").collect()}
    else:
        train = kept(train, "probe")
        weights = {r.model: np.zeros((r.width + 1, len(classes))) for r in sizes}
        counts = {r.model: r["count"] for r in train.groupBy("model").count().collect()}
        for _ in range(epochs):
            held = spark.sparkContext.broadcast(weights)

            def part(batches, held=held):
                for batch in batches:
                    for model, pdf in batch.groupby("model"):
                        x, y = _arrays(pdf, classes)
                        yield pd.DataFrame({"model": [model], "g": [gradient(held.value[model], x, y).ravel().tolist()]})

            def add(pdf: pd.DataFrame) -> pd.DataFrame:
                return pd.DataFrame({"model": [pdf["model"].iloc[0]], "g": [np.sum(pdf["g"].tolist(), axis=0).tolist()]})

            summed = train.mapInPandas(part, "model string, g array<double>").groupBy("model").applyInPandas(add, "model string, g array<double>").collect()
            weights = weights | {r.model: weights[r.model] - learning_rate * np.array(r.g).reshape(weights[r.model].shape) / counts[r.model] for r in summed}
            held.unpersist()
    model = spark.sparkContext.broadcast(weights)

    def predict(batches):
        for batch in batches:
            for name, pdf in batch.groupby("model"):
                if name in model.value:
                    x, y = _arrays(pdf, classes)
                    got = (np.hstack([x, np.ones((len(x), 1))]) @ model.value[name]).argmax(1)
                    yield pd.DataFrame({"model": name, "wrong": (got != y).astype("int64")})

    out = test.mapInPandas(predict, "model string, wrong long").groupBy("model").agg(F.count("*").alias("n"), F.sum("wrong").alias("raw_error"))
    return out.withColumn("err", F.col("raw_error") / F.col("n"))
