"""Ways to choose models for a task, and how they compare.

``proxies``: (model, task, err).  ``records``: (model, task, accuracy,
elapsed_time), what fine-tuning gave.  Every strategy returns (strategy,
model).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.readers import random_subset

#: Seconds that a search counts for in comparisons.
SEARCH_SECONDS = {"leep": 5400.0, "nearest_task": 70.0, "random": 0.0, "enumeration": 0.0, "meta_learned": 0.0, "proxy": 0.0}


def _named(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.lit(name).alias("strategy"), "model")


def enumeration(models: DataFrame) -> DataFrame:
    return _named(models, "enumeration")


def random_search(models: DataFrame, k: int, key: str, seed: int = 0) -> DataFrame:
    """``k`` models without replacement, fixed by the seed."""
    return _named(random_subset(models, k, key, seed), "random")


def proxy(proxies: DataFrame, task: str, k: int) -> DataFrame:
    """The first ``k`` of the stored ranking of a task."""
    return _named(proxies.filter(F.col("task") == task).orderBy("err", "model").limit(k), "proxy")


def best_of_tasks(records: DataFrame, k: int) -> DataFrame:
    """The ``k`` best models of every task by fine-tuned accuracy."""
    w = Window.partitionBy("task").orderBy(F.desc("accuracy"), "model")
    return records.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def meta_learned(records: DataFrame, proxies: DataFrame, task: str, k: int) -> DataFrame:
    """Of the models that are among the ``k`` best of any other task, the first in the target's ranking."""
    seen = best_of_tasks(records.filter(F.col("task") != task), k).select("model").distinct()
    return _named(proxies.filter(F.col("task") == task).join(seen, "model", "left_semi").orderBy("err", "model").limit(1), "meta_learned")


def nearest_task(distances: DataFrame, records: DataFrame, task: str) -> DataFrame:
    """The best fine-tuned model of the task nearest to the target."""
    near = distances.filter((F.col("task_from") == task) & (F.col("task_to") != task)).orderBy("distance", "task_to").limit(1)
    best = best_of_tasks(records, 1).select(F.col("task").alias("task_to"), "model")
    return _named(near.join(best, "task_to"), "nearest_task")


def leep(outputs: DataFrame) -> DataFrame:
    """(model, leep): mean log of the expected empirical prediction.

    ``outputs``: (model, row, label, probs), the source model's class
    probabilities for each row.  Sums for each (model, label, class) are made
    where the rows are; the conditional probabilities, an array for each model
    and label, then go to the rows.  No row is shuffled by its number.
    """
    long = outputs.select("model", "label", F.posexplode("probs").alias("z", "p"))
    joint = long.groupBy("model", "label", "z").agg(F.sum("p").alias("j"))
    marginal = joint.groupBy("model", "z").agg(F.sum("j").alias("m"))
    conditional = joint.join(marginal, ["model", "z"]).select("model", "label", "z", F.coalesce(F.col("j") / F.nullif("m", F.lit(0.0)), F.lit(0.0)).alias("c"))
    arrays = conditional.groupBy("model", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("z", "c"))), lambda x: x["c"]).alias("c"))
    expected = outputs.join(arrays, ["model", "label"]).select("model", V.dot(F.col("probs"), F.col("c")).alias("e"))
    return expected.groupBy("model").agg(F.avg(F.log("e")).alias("leep"))


def leep_choice(outputs: DataFrame) -> DataFrame:
    return _named(leep(outputs).orderBy(F.desc("leep"), "model").limit(1), "leep")


def distilled(errors: DataFrame) -> DataFrame:
    """The model with the best probe on a distilled set, given (model, err)."""
    return _named(errors.orderBy("err", "model").limit(1), "distillation")


def records_of(records: DataFrame, task: str, splits: tuple[str, str] = ("train", "test"), start: int | None = None, stop: int | None = None) -> DataFrame:
    """Fine-tune records of a dataset, its splits and perhaps a slice."""
    out = records.filter(F.col("task") == task)
    if "train_split" in records.columns:
        out = out.filter((F.col("train_split") == splits[0]) & (F.col("test_split") == splits[1]))
    return out if start is None else out.filter((F.col("start") == start) & (F.col("stop") == stop))


def compare(choices: list[DataFrame], records: DataFrame, task: str) -> DataFrame:
    """(strategy, models, search_time, finetune_time, best_accuracy): what following each strategy costs and gives."""
    every = choices[0]
    for c in choices[1:]:
        every = every.unionByName(c)
    held = every.join(records_of(records, task), "model")
    seconds = F.lit(0.0)
    for name, s in SEARCH_SECONDS.items():
        seconds = F.when(F.col("strategy") == name, s).otherwise(seconds)
    return held.groupBy("strategy").agg(F.count("*").alias("models"), F.sum("elapsed_time").alias("finetune_time"), F.max("accuracy").alias("best_accuracy")).withColumn("search_time", seconds)


def extrapolated_time(records: DataFrame, models: int) -> DataFrame:
    """Fine-tune time of a pool if all were like those on record."""
    return records.agg((F.sum("elapsed_time") * models / F.count("*")).alias("seconds"))


def by_strategy(results: DataFrame, column: str) -> DataFrame:
    return results.groupBy("strategy").agg(F.avg(column).alias(f"{column}_mean"), F.min(column).alias(f"{column}_min"), F.max(column).alias(f"{column}_max"))


def error_bound(err: Column, classes: Column) -> Column:
    """Best error that can be reached, estimated from the error of 1-NN."""
    share = (classes - 1) / classes
    return share * (1 - F.sqrt(F.greatest(F.lit(0.0), 1 - err / share)))


def accuracy_bound(proxies: DataFrame, classes: DataFrame) -> DataFrame:
    """(task, bound): from the least proxy error of each task; ``classes``: (task, classes)."""
    least = proxies.groupBy("task").agg(F.min("err").alias("err"))
    return least.join(classes, "task").select("task", (1 - error_bound(F.col("err"), F.col("classes"))).alias("bound"))


def gap_to_best(records: DataFrame) -> DataFrame:
    """(task, model, gap): how far each record is from the best of its task."""
    return records.select("task", "model", (F.max("accuracy").over(Window.partitionBy("task")) - F.col("accuracy")).alias("gap"))


def with_records(proxies: DataFrame, records: DataFrame) -> DataFrame:
    """Proxy results with the mean fine-tuned accuracy by model and task, if there is any."""
    mean = records.groupBy("model", "task").agg(F.avg("accuracy").alias("accuracy"))
    return proxies.join(mean, ["model", "task"], "left")
