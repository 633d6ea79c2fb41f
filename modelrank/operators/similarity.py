"""Distances between tasks, from the diagonal Fisher information of a probe.

A task has ``hessian`` and ``scale``, arrays of doubles of one length.  All
distances are expressions; a pair of tasks is a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

TINY = 1e-8


def _kl(v: Column, w: Column) -> Column:
    """Divergence of two centred normal distributions, by their variances."""
    return F.zip_with(v, w, lambda a, b: (a / b - 1 + F.log(b) - F.log(a)) * 0.5)


def variance(hessian: Column) -> Column:
    return F.transform(hessian, lambda h: F.lit(1.0) / h)


def _scaled(h: Column, g: Column) -> Column:
    return F.zip_with(h, g, lambda a, b: a / (a + b + F.lit(TINY)))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - V.dot(a, b) / (V.norm(a) * V.norm(b))


def _centred(v: Column) -> Column:
    return V.let(V.mean(v), lambda middle: F.transform(v, lambda x: x - middle))


def _correlation(a: Column, b: Column) -> Column:
    return cosine_distance(_centred(a), _centred(b))


def _entropy(p: Column) -> Column:
    return F.transform(p, lambda x: F.when(x > 0, -x * F.log(x)).otherwise(0.0) + F.when(x < 1, -(1 - x) * F.log(1 - x)).otherwise(0.0))


def kl(h: Column, g: Column, s: Column, t: Column) -> Column:
    v, w = variance(h), variance(g)
    return V.total(F.zip_with(_kl(v, w), _kl(w, v), lambda a, b: F.greatest(a, b)))


def asymmetric_kl(h: Column, g: Column, s: Column, t: Column) -> Column:
    return V.total(_kl(variance(h), variance(g)))


def jsd(h: Column, g: Column, s: Column, t: Column) -> Column:
    v, w = variance(h), variance(g)
    middle = F.zip_with(v, w, lambda a, b: (a + b) * 0.5)
    return V.mean(F.zip_with(_kl(v, middle), _kl(w, middle), lambda a, b: (a + b) * 0.5))


def cosine(h: Column, g: Column, s: Column, t: Column) -> Column:
    return cosine_distance(_scaled(h, g), _scaled(g, h))


def normalized_cosine(h: Column, g: Column, s: Column, t: Column) -> Column:
    return cosine_distance(F.zip_with(variance(h), s, lambda a, b: a * b), F.zip_with(variance(g), t, lambda a, b: a * b))


def correlation(h: Column, g: Column, s: Column, t: Column) -> Column:
    return _correlation(variance(h), variance(g))


def entropy(h: Column, g: Column, s: Column, t: Column) -> Column:
    return F.lit(math.log(2)) - V.mean(_entropy(_scaled(h, g)))


DISTANCES = {f.__name__: f for f in (kl, asymmetric_kl, jsd, cosine, normalized_cosine, correlation, entropy)}


def _sides(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select(F.col("task").alias("task_from"), F.col("hessian").alias("h"), F.col("scale").alias("s"))
    right = b.select(F.col("task").alias("task_to"), F.col("hessian").alias("g"), F.col("scale").alias("t"))
    return left.crossJoin(right)


def cdist(a: DataFrame, b: DataFrame, distance: str = "cosine") -> DataFrame:
    """(task_from, task_to, distance) for every task of a and of b; 0 where one has no embedding."""
    value = DISTANCES[distance](F.col("h"), F.col("g"), F.col("s"), F.col("t"))
    return _sides(a, b).select("task_from", "task_to", F.coalesce(F.when(F.col("h").isNotNull() & F.col("g").isNotNull(), value), F.lit(0.0)).alias("distance"))


def pdist(tasks: DataFrame, distance: str = "cosine") -> DataFrame:
    """All pairs of tasks.  A symmetric distance is computed once for a pair,
    mirrored, and 0 from a task to itself."""
    tasks = tasks.filter(F.col("hessian").isNotNull())
    if distance == "asymmetric_kl":
        return cdist(tasks, tasks, distance)
    value = DISTANCES[distance](F.col("h"), F.col("g"), F.col("s"), F.col("t"))
    once = _sides(tasks, tasks).filter("task_from < task_to").select("task_from", "task_to", value.alias("distance"))
    mirror = once.select(F.col("task_to").alias("task_from"), F.col("task_from").alias("task_to"), "distance")
    same = tasks.select(F.col("task").alias("task_from"), F.col("task").alias("task_to"), F.lit(0.0).alias("distance"))
    return once.unionAll(mirror).unionAll(same)


def layerwise_kl(layers: DataFrame) -> DataFrame:
    """(layer, kl) of two tasks' filter variances, arrays v and w for each layer."""
    return layers.select("layer", V.total(_kl(F.col("v"), F.col("w"))).alias("kl"))


def layerwise_cosine(layers: DataFrame) -> DataFrame:
    return layers.select("layer", cosine_distance(F.col("v"), F.col("w")).alias("cosine"))


def normalised_embeddings(tasks: DataFrame) -> DataFrame:
    """Hessians over the root mean square of each place among all tasks; a task without one is zero."""
    width = F.max(F.size("hessian"))
    n = tasks.agg(F.count("*").alias("n"), width.alias("w"))
    scale = tasks.select(F.posexplode("hessian").alias("place", "h")).groupBy("place").agg(F.sum(F.col("h") * F.col("h")).alias("q"))
    scales = scale.crossJoin(n).select("place", F.sqrt(F.col("q") / F.col("n")).alias("r"))
    held = scales.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "r"))), lambda x: x["r"]).alias("r"))  # one value for each place
    zero = F.transform(F.col("r"), lambda x: F.lit(0.0))
    return tasks.crossJoin(F.broadcast(held)).select("task", F.zip_with(F.coalesce("hessian", zero), F.col("r"), lambda h, r: h / r).alias("hessian"))


def fisher_embedding(df: DataFrame, by: str = "task", epochs: int = 50, rate: float = 0.5) -> DataFrame:
    """(task, hessian, scale): the diagonal Fisher information of a linear probe
    on each task's rows (task, embed, label), E[(p - y)**2 x**2], averaged over
    classes; scale is 1.  A task is one group, trained whole."""
    import numpy as np
    import pandas as pd

    from ..sources.scratch import importable
    from .linear import fit, softmax

    importable(df.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["embed"].tolist(), np.float64)
        names = {v: i for i, v in enumerate(sorted(pdf["label"].unique()))}
        y = pdf["label"].map(names).to_numpy()
        w = fit(x, y, len(names), rate, epochs)
        p = softmax(np.hstack([x, np.ones((len(x), 1))]) @ w)
        p[np.arange(len(y)), y] -= 1
        h = ((p * p).mean(1)[:, None] * x * x).mean(0)
        return pd.DataFrame({"task": [pdf["task"].iloc[0]], "hessian": [h.tolist()], "scale": [[1.0] * len(h)]})

    kind = df.schema[by].dataType.simpleString()
    return df.select(F.col(by).alias("task"), V.doubles(F.col("embed")).alias("embed"), "label").groupBy("task").applyInPandas(run, f"task {kind}, hessian array<double>, scale array<double>")
