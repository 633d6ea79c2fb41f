"""Algebra of classification tasks.

A task is rows (task_id, image, labels) with labels an array of int, and a
table of names (task_id, label, name).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DISJOINT, LABELS, LABEL_NAMES = "DISJOINT", "LABELS", "LABEL_NAMES"


def _exploded(tasks: DataFrame) -> DataFrame:
    return tasks.select("task_id", "image", F.posexplode("labels").alias("place", "label"))


def universe(tasks: DataFrame) -> DataFrame:
    """(task_id, label): the labels that occur."""
    return tasks.select("task_id", F.explode("labels").alias("label")).distinct()


def label_map(tasks: DataFrame, names: DataFrame, mode: str) -> DataFrame:
    """(task_id, label, new_label) of the union of tasks, from 0 on.

    DISJOINT keeps labels of different tasks apart, in order of task and
    label; LABELS and LABEL_NAMES give equal labels, or labels of equal names,
    the same new one, in their order.  Labels are few beside the images.
    """
    held = universe(tasks).withColumn("__one", F.lit(1))
    if mode == DISJOINT:
        order = [F.col("task_id"), F.col("label")]
    elif mode == LABELS:
        order = [F.col("label")]
    elif mode == LABEL_NAMES:
        held = held.join(names, ["task_id", "label"])
        order = [F.col("name")]
    else:
        raise ValueError(f"no such mode: {mode}")
    place = F.dense_rank().over(Window.partitionBy("__one").orderBy(*order)) - 1
    return held.select("task_id", "label", place.cast("int").alias("new_label"))


def remapped(tasks: DataFrame, mapping: DataFrame) -> DataFrame:
    """Labels by a map (task_id, label, new_label); images left without any label go."""
    held = _exploded(tasks).join(mapping, ["task_id", "label"])
    return held.groupBy("task_id", "image").agg(F.array_sort(F.collect_set("new_label")).alias("labels"))


def merge_duplicates(tasks: DataFrame) -> DataFrame:
    """(image, labels): the labels of an image over all its rows one after another, repeats kept."""
    rows = F.array_sort(F.collect_list(F.struct("task_id", "labels")))
    return tasks.groupBy("image").agg(F.flatten(F.transform(rows, lambda r: r["labels"])).alias("labels"))


def union(tasks: DataFrame, names: DataFrame, mode: str = DISJOINT, merge: bool = True) -> DataFrame:
    out = remapped(tasks, label_map(tasks, names, mode))
    return merge_duplicates(out) if merge else out.select("image", "labels")


def intersection(tasks: DataFrame, names: DataFrame, mode: str = LABELS) -> DataFrame:
    """Rows of all tasks with only the labels, or labels of the names, that every task has."""
    n = tasks.select("task_id").distinct().count()
    held = universe(tasks) if mode == LABELS else universe(tasks).join(names, ["task_id", "label"])
    by = "label" if mode == LABELS else "name"
    common = held.groupBy(by).agg(F.count_distinct("task_id").alias("n")).filter(F.col("n") == n).select(by)
    place = F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy(by)) - 1
    mapping = held.join(common.withColumn("new_label", place.cast("int")), by).select("task_id", "label", "new_label")
    return remapped(tasks, mapping)


def binary(tasks: DataFrame) -> DataFrame:
    """One task for each label of each task: is it that one (1) or not (0)."""
    return tasks.join(universe(tasks).withColumnRenamed("label", "of_label"), "task_id").select("task_id", "of_label", "image", F.array_contains("labels", F.col("of_label")).cast("int").alias("label"))


def one_per_group(tasks: DataFrame, groups: DataFrame) -> DataFrame:
    """One task for each group of labels: (task_id, group, image, labels) with the
    group's labels numbered from 0.  ``groups``: (label, group)."""
    place = F.dense_rank().over(Window.partitionBy("group").orderBy("label")) - 1
    numbered = groups.withColumn("new_label", place.cast("int"))
    held = _exploded(tasks).join(numbered, "label")
    return held.groupBy("task_id", "group", "image").agg(F.array_sort(F.collect_set("new_label")).alias("labels"))


def by_attribute(tasks: DataFrame, groups: DataFrame) -> DataFrame:
    """Labels replaced by the number of their group in order of name: a coarser task."""
    place = F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy("group")) - 1
    names = groups.select("group").distinct().withColumn("new_label", place.cast("int"))
    held = _exploded(tasks).join(groups, "label").join(names, "group")
    return held.groupBy("task_id", "image").agg(F.array_sort(F.collect_set("new_label")).alias("labels"))


def by_taxonomy(tasks: DataFrame, levels: DataFrame, names: list[str]) -> DataFrame:
    """(level, task_id, image, labels): a task for each level of a taxonomy;
    ``levels`` has label and, for each level, the group that it is in."""
    out = None
    for name in names:
        one = by_attribute(tasks, levels.select("label", F.col(name).alias("group"))).select(F.lit(name).alias("level"), "task_id", "image", "labels")
        out = one if out is None else out.unionByName(one)
    return out


def single_label(tasks: DataFrame) -> DataFrame:
    """Without the images that have more than one label."""
    return tasks.filter(F.size("labels") == 1)


def groups_by_size(tasks: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, images, place): groups of labels by how many images they have, most first."""
    sizes = _exploded(tasks).join(groups, "label").groupBy("group").agg(F.count_distinct("image").alias("images"))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("images"), "group")) - 1
    return sizes.withColumn("place", place.cast("int"))


def align(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with only the labels that both have, by label; ValueError if there is none."""
    common = universe(train).select("label").distinct().join(universe(test).select("label").distinct(), "label", "left_semi")
    if not common.limit(1).count():
        raise ValueError("train and test have no label in common")

    def only(df: DataFrame) -> DataFrame:
        held = _exploded(df).join(common, "label", "left_semi")
        return held.groupBy("task_id", "image").agg(F.array_sort(F.collect_set("label")).alias("labels"))

    return only(train), only(test)


def drop_label(tasks: DataFrame, label: int = -1) -> DataFrame:
    return tasks.filter(~F.array_contains("labels", label))
