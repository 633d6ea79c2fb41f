"""Successive halving: more data for fewer models, round after round.

The loop runs in the driver over a handful of losses.  A round compares test
rows only with the training rows that are new to it, for the models that are
left, and merges the result with the best so far, which is kept in the shared
folder.  A linear probe is trained anew on the longer prefix.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.readers import proportional_slices
from ..sources.scratch import kept
from .linear import linear_probe
from .neighbours import EUCLIDEAN, errors, merged, nearest

ETA, LINEAR = 2, "Linear"
#: Fixed values of the cost model, in milliseconds: loading data, one test row by either proxy, overhead of a run.
LOAD_DATA, NEIGHBOUR_ROW, LINEAR_ROW, OVERHEAD = 700.0, 0.1, 5.0, 800.0


def rounds_of(models: int) -> int:
    if models < 2:
        raise ValueError("halving needs more than one model")
    n, held = 0, 1
    while held < models:
        held *= ETA
        n += 1
    return n


def schedule(budget: int, models: int) -> list[tuple[int, int, int, int]]:
    """(round, models left, pulls of the round, pulls so far)."""
    out, left, total, rounds = [], models, 0, rounds_of(models)
    for k in range(rounds):
        pulls = budget // (left * rounds)
        total += pulls
        out.append((k, left, pulls, total))
        left = math.ceil(left / ETA)
    return out


def bounds(rows: int, models: int) -> tuple[int, int]:
    """Budget and chunk so that the last model sees all rows."""
    budget = models * rounds_of(models)
    return budget, math.ceil(rows / sum(total for *_, total in schedule(budget, models)))


def default_budget(rows: int, chunk: int, models: int) -> int:
    return math.ceil(math.ceil(rows / chunk) / math.log2(models))


def schedule_table(spark: SparkSession, budget: int, models: int, chunk: int = 1) -> DataFrame:
    """The schedule as rows: round, survivors, pulls, total_pulls, samples."""
    rows = [(k, left, pulls, total, total * chunk) for k, left, pulls, total in schedule(budget, models)]
    return spark.createDataFrame(rows, "round int, survivors long, pulls long, total_pulls long, samples long")


def _between(starts: list[int], stops: list[int]):
    """Rows of each reader from its start up to its stop."""
    out = F.lit(False)
    for i, (a, b) in enumerate(zip(starts, stops)):
        out = out | ((F.col("reader_idx") == i) & (F.col("row_idx") >= a) & (F.col("row_idx") < b))
    return out


def successive_halving(test: DataFrame, train: DataFrame, models: list[str], chunk: int | None = None, budget: int | None = None, metric: str = EUCLIDEAN) -> DataFrame:
    """(model, round, start, stop, n, raw_error, err) of the longest prefix that
    each model got; ``test`` and ``train`` are embedded rows (model, row_idx,
    embed, label, and reader_idx where there are several).  No chunk or budget
    means one that fits the data.  Survivors: least errors, ties by name."""
    spark = test.sparkSession
    train = train if "reader_idx" in train.columns else train.withColumn("reader_idx", F.lit(0))
    sizes = [r.n for r in train.groupBy("reader_idx").agg((F.max("row_idx") + 1).alias("n")).orderBy("reader_idx").collect()]
    whole = bounds(sum(sizes), len(models))
    chunk = chunk or whole[1]
    budget = budget or (default_budget(sum(sizes), chunk, len(models)) if chunk != whole[1] else whole[0])
    left, pulls, before, best, out = list(models), [0], [0] * len(sizes), None, None
    for k, count, pull, _ in schedule(budget, len(models)):
        if not pull:
            break
        pulls.append(pull)
        after = [s[-1][1] for s in proportional_slices(sizes, pulls, chunk)]
        some_test, some_train = (x.filter(F.col("model").isin(left)) for x in (test, train))
        if metric == LINEAR:
            losses = linear_probe(some_train.filter(_between([0] * len(sizes), after)), some_test).collect()
        else:
            found = nearest(some_test, some_train.filter(_between(before, after)), metric)
            if best is not None:
                found = merged(found.unionByName(best.filter(F.col("model").isin(left))))
            best = kept(found, "halving")
            losses = errors(best, "model").collect()
        order = {m: i for i, m in enumerate(sorted(models))}
        rows = [(r.model, k, 0, sum(after), r.n, r.raw_error, r.err) for r in sorted(losses, key=lambda r: (r.raw_error, order[r.model]))]
        table = spark.createDataFrame(rows, "model string, round int, start long, stop long, n long, raw_error long, err double")
        out = table if out is None else out.unionByName(table)
        left = [r[0] for r in rows][: math.ceil(len(rows) / ETA)]
        before = after
        if len(left) < 2:
            break
    if out is None:
        raise ValueError("the budget is too small for one round")
    last = Window.partitionBy("model").orderBy(F.desc("round"))
    return out.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")


def cost_without(costs: DataFrame, models: int, train: int, test: int, linear: bool, devices: int) -> DataFrame:
    """Seconds to try every model on everything; ``costs`` has model, load_cost and inference_cost."""
    row = LINEAR_ROW if linear else NEIGHBOUR_ROW
    held = _first(costs, "rank", models - 1)
    each = F.lit(OVERHEAD + LOAD_DATA + row * test) + 2 * F.avg("load_cost") + F.avg("inference_cost") * (train + test)
    return held.agg((each * models / devices / 1000).alias("seconds"))


def _first(costs: DataFrame, rank: str, n: int) -> DataFrame:
    return costs.filter(F.col(rank) <= n)


def cost_with(costs: DataFrame, models: int, test: int, linear: bool, budget: int, chunk: int, devices: int) -> DataFrame:
    """(seconds_mean, seconds_max, seconds_min) under halving: by mean costs, and
    if the dearest or the cheapest models survive.

    ``costs`` has rank (the order of the models), load_cost and inference_cost.
    The mean costs leave the last model out, as do the dearest ones.
    """
    spark, row = costs.sparkSession, LINEAR_ROW if linear else NEIGHBOUR_ROW
    base = _first(costs, "rank", models - 1).agg(F.avg("load_cost").alias("load"), F.avg("inference_cost").alias("infer"))
    plan = schedule_table(spark, budget, models, chunk).withColumn("at_once", F.least(F.lit(devices), F.col("survivors")))
    ranks = {}
    for c in ("load_cost", "inference_cost"):
        ranks[f"{c}_down"] = F.row_number().over(Window.partitionBy("__one").orderBy(F.desc(c), "rank"))
        ranks[f"{c}_up"] = F.row_number().over(Window.partitionBy("__one").orderBy(c, "rank"))
    ranked = costs.withColumn("__one", F.lit(1)).withColumns(ranks)  # a row for each model

    def mean(c: str, way: str, less: int):
        return F.avg(F.when(F.col(f"{c}_{way}") <= F.col("survivors") - less, F.col(c)))

    per = plan.crossJoin(F.broadcast(ranked)).groupBy("round", "survivors", "samples", "at_once").agg(
        mean("load_cost", "down", 1).alias("load_max"), mean("inference_cost", "down", 1).alias("infer_max"), mean("load_cost", "up", 0).alias("load_min"), mean("inference_cost", "up", 0).alias("infer_min")
    )
    per = per.crossJoin(base)

    def step(load: str, infer: str, extra: float):
        return F.sum(F.col("survivors") * (F.lit(LOAD_DATA + row * test + extra) + F.col(load) + F.col(infer) * F.col("samples")) / F.col("at_once"))

    tests = F.first(F.lit(models) * (F.col("infer") * test + F.lit(LOAD_DATA) + F.col("load")) / devices)
    return per.agg(*[((step(a, b, x) + tests) / 1000).alias(f"seconds_{n}") for n, a, b, x in (("mean", "load", "infer", OVERHEAD), ("max", "load_max", "infer_max", 0.0), ("min", "load_min", "infer_min", 0.0))])
