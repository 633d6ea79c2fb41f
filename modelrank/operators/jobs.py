"""What is to be done: questions, what is known of them, and what they wait for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fan_out(models: DataFrame, classifiers: DataFrame, readers: DataFrame) -> DataFrame:
    """Every model with every classifier on every reader; both lists are small beside the models."""
    return models.crossJoin(F.broadcast(classifiers)).crossJoin(F.broadcast(readers))


def with_known(requests: DataFrame, known: DataFrame, key: str = "job_hash") -> DataFrame:
    """Requests with the answers there are; a hash that is known twice is an error."""
    twice = known.groupBy(key).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0][key]} is known twice")
    return requests.join(known, key, "left")


def remaining(requests: DataFrame, done: DataFrame, key: str = "job_hash") -> DataFrame:
    """Each different request that isn't done."""
    return requests.dropDuplicates([key]).join(done, key, "left_anti")


def dependency_status(dependencies: DataFrame, status: DataFrame) -> DataFrame:
    """(request, ready, failed): ready if all that it waits for is finished, failed if any of it failed."""
    held = dependencies.join(status, "dependency", "left")
    done, lost = F.coalesce(F.col("status") == "finished", F.lit(False)), F.coalesce(F.col("status") == "failed", F.lit(False))
    return held.groupBy("request").agg(F.bool_and(done).alias("ready"), F.bool_or(lost).alias("failed"))


def check_question(has_test: bool, classifiers: list[str]) -> None:
    if has_test != bool(classifiers):
        raise ValueError("test data and classifiers go together")
    if len(set(classifiers)) < len(classifiers):
        raise ValueError("a classifier is named twice")
