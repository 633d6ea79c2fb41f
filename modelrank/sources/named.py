"""Datasets and models that have names, and how rows of a named dataset are read.

Image libraries download data; here a named dataset is a folder
``root/<package>/<split>`` of Parquet files with row_idx and the features that
the package has.  Labels that a name derives from other features are
expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from . import readers as R

@dataclass(frozen=True)
class Dataset:
    """A name, the package that it is read from, how its splits are made (with rows of
    train, and percent of them for train and validation), and its derived label."""

    name: str
    package: str
    kind: str
    rows: int = 0
    train: int = 0
    validation: int = 0
    derived: str = ""


#: The named datasets.
BENCHMARK = [
    Dataset("Caltech101", "caltech101:3.0.1", "train_test", rows=3060, train=90),
    Dataset("CIFAR-10", "cifar10:3.0.2", "train_test", rows=50000, train=100),
    Dataset("CIFAR-100", "cifar100:3.0.2", "train_test", rows=50000, train=90),
    Dataset("CLEVR distance prediction", "clevr:3.1.0", "train_test", rows=70000, train=90, derived="closest_object"),
    Dataset("CLEVR counting", "clevr:3.1.0", "train_test", rows=70000, train=90, derived="object_count"),
    Dataset("Diabetic Rethinopathy", "diabetic_retinopathy_detection/btgraham-300:3.0.0", "full"),
    Dataset("Dmlab Frames", "dmlab:2.0.1", "full"),
    Dataset("dSprites orientation prediction", "dsprites:2.0.0", "train", rows=737280, train=80, validation=10, derived="orientation"),
    Dataset("dSprites location prediction", "dsprites:2.0.0", "train", rows=737280, train=80, validation=10, derived="location"),
    Dataset("Describable Textures Dataset (DTD)", "dtd:3.0.1", "full"),
    Dataset("EuroSAT", "eurosat/rgb:2.0.0", "train", rows=27000, train=60, validation=20),
    Dataset("KITTI distance prediction", "kitti:3.2.0", "full", derived="closest_vehicle"),
    Dataset("102 Category Flower Dataset", "oxford_flowers102:2.1.1", "full"),
    Dataset("Oxford IIIT Pet dataset", "oxford_iiit_pet:3.2.0", "train_test", rows=3680, train=80),
    Dataset("PatchCamelyon", "patch_camelyon:2.0.0", "full"),
    Dataset("Resisc45", "resisc45:3.0.0", "train", rows=31500, train=60, validation=20),
    Dataset("Small NORB azimuth prediction", "smallnorb:2.0.0", "halved_test", derived="azimuth"),
    Dataset("Small NORB elevation prediction", "smallnorb:2.0.0", "halved_test", derived="elevation"),
    Dataset("SUN397", "sun397/tfds:4.0.0", "full"),
    Dataset("SVHN", "svhn_cropped:3.0.0", "train_test", rows=73257, train=90),
    Dataset("CIFAR-10Splitted", "cifar10_splitted:1.0.0", "own"),
    Dataset("CIFAR-10Ordered", "cifar10_ordered:1.0.0", "train_test", rows=50000, train=100),
    Dataset("CIFAR-9", "cifarn:3.0.3", "train_test", rows=45000, train=100),
    Dataset("CIFAR-9TH", "cifar9_th:1.0.0", "train_test", rows=5000, train=100),
    Dataset("CIFAR-10Ordered2", "cifar10_ordered2:1.0.0", "train_test", rows=50000, train=100),
    Dataset("CIFAR-8", "cifar8:1.0.0", "train_test", rows=40000, train=100),
    Dataset("CIFAR-8TH", "cifar8_th:1.0.0", "train_test", rows=10000, train=100),
    Dataset("CIFAR-10Ordered3", "cifar10_ordered3:1.0.0", "train_test", rows=50000, train=100),
    Dataset("CIFAR-7", "cifar7:1.0.0", "train_test", rows=35000, train=100),
    Dataset("CIFAR-7TH", "cifar7_th:1.0.0", "train_test", rows=15000, train=100),
    Dataset("Diabetic Rethinopathy Splitted", "diabetic_retinopathy_detection_splitted:1.0.0", "own"),
    Dataset("Diabetic Rethinopathy Ordered", "diabetic_retinopathy_detection_ordered:1.0.0", "full"),
]
#: Rows of the splits of datasets that have splits of their own.
OWN_SPLITS = {
    "CIFAR-10Splitted": {f"train_{i}": 5000 for i in range(10)} | {f"test_{i}": 1000 for i in range(10)},
    "Diabetic Rethinopathy Splitted": dict(zip([*(f"train_{i}" for i in range(5)), *(f"validation_{i}" for i in range(5))], [25810, 2443, 5292, 873, 708, 8130, 720, 1579, 237, 240])),
}
#: Predefined image models: name, address, side of the image, batch size.
IMAGE_MODELS = [
    ("Inception V3", "https://tfhub.dev/google/tf2-preview/inception_v3/feature_vector/4", 299, 256),
    ("ResNet V2 50", "https://tfhub.dev/google/imagenet/resnet_v2_50/feature_vector/4", 224, 512),
    ("ResNet V2 101", "https://tfhub.dev/google/imagenet/resnet_v2_101/feature_vector/4", 224, 512),
    ("ResNet V2 152", "https://tfhub.dev/google/imagenet/resnet_v2_152/feature_vector/4", 224, 512),
    ("EfficientNet B0", "https://tfhub.dev/tensorflow/efficientnet/b0/feature-vector/1", 224, 128),
    ("EfficientNet B1", "https://tfhub.dev/tensorflow/efficientnet/b1/feature-vector/1", 240, 128),
    ("EfficientNet B2", "https://tfhub.dev/tensorflow/efficientnet/b2/feature-vector/1", 260, 256),
    ("EfficientNet B3", "https://tfhub.dev/tensorflow/efficientnet/b3/feature-vector/1", 300, 128),
    ("EfficientNet B4", "https://tfhub.dev/tensorflow/efficientnet/b4/feature-vector/1", 380, 64),
    ("EfficientNet B5", "https://tfhub.dev/tensorflow/efficientnet/b5/feature-vector/1", 456, 64),
    ("EfficientNet B6", "https://tfhub.dev/tensorflow/efficientnet/b6/feature-vector/1", 528, 8),
    ("EfficientNet B7", "https://tfhub.dev/tensorflow/efficientnet/b7/feature-vector/1", 600, 16),
]
#: Predefined text models: name, address, batch size.
TEXT_MODELS = [
    ("ELMo", "https://tfhub.dev/google/elmo/3", 2),
    ("NNLM 50", "https://tfhub.dev/google/nnlm-en-dim50/2", 2048),
    ("NNLM 50 Normalization", "https://tfhub.dev/google/nnlm-en-dim50-with-normalization/2", 2048),
    ("NNLM 128", "https://tfhub.dev/google/nnlm-en-dim128/2", 2048),
    ("NNLM 128 Normalization", "https://tfhub.dev/google/nnlm-en-dim128-with-normalization/2", 2048),
    ("Universal Sentence Encoder", "https://tfhub.dev/google/universal-sentence-encoder/4", 2048),
    ("Universal Sentence Encoder Large", "https://tfhub.dev/google/universal-sentence-encoder-large/5", 16),
]


#: Datasets whose splits are taken whole, as published: name, package, splits.
WHOLE = [
    ("QMNIST", "qmnist", ("train", "test", "test10k", "test50k", "nist")),
    ("USPS", "usps", ("train", "test")),
    ("MNIST", "mnist", ("train", "test")),
    ("iNaturalist 2018", "inat2018", ("train", "val")),
    ("CUB-200 2011", "cub", ("train", "test")),
    ("iMaterialist Fashion 2018", "imat2018fashion", ("train", "val")),
]


def read_whole(spark: SparkSession, root: str, name: str, split: str) -> DataFrame:
    """A published split of a dataset of ``WHOLE``: row_idx, features, label and whatever attributes the folder has."""
    held = {n: (package, splits) for n, package, splits in WHOLE}
    if name not in held or split not in held[name][1]:
        raise ValueError(f"no such dataset or split: {name}, {split}")
    return spark.read.parquet(f"{root}/{held[name][0]}/{split}")


def attribute_tasks(df: DataFrame, levels: list[str], image: str = "row_idx") -> DataFrame:
    """(level, task_id, image, labels): a task for each attribute of a dataset,
    such as the order, family and genus of a species; labels are numbered in
    order of the attribute's values, and rows without one are left out."""
    out = None
    for i, level in enumerate(levels):
        values = df.filter(F.col(level).isNotNull()).select(F.col(level).alias("__v")).distinct()
        # a row for each value of an attribute
        numbered = values.withColumn("__n", (F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy("__v")) - 1).cast("int"))
        one = df.join(numbered, F.col(level) == F.col("__v")).select(F.lit(level).alias("level"), F.lit(i).alias("task_id"), F.col(image).alias("image"), F.array("__n").alias("labels"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no attribute is named")
    return out


#: Labels derived from the features of a package.
DERIVED: dict[str, Callable[[], Column]] = {
    "closest_object": lambda: L.closest_object(F.transform("objects", lambda o: o["pixel_coords"][2])),
    "object_count": lambda: L.object_count(F.col("objects")),
    "orientation": lambda: L.grid_position(F.col("label_orientation"), 40),
    "location": lambda: L.grid_position(F.col("label_x_position"), 32),
    "closest_vehicle": lambda: L.closest_vehicle(F.transform("objects", lambda o: o["type"]), F.transform("objects", lambda o: o["location"][2])),
    "azimuth": lambda: F.col("label_azimuth"),
    "elevation": lambda: F.col("label_elevation"),
}


def names() -> list[str]:
    return [d.name for d in BENCHMARK]


def dataset_of(name: str) -> Dataset:
    held = next((d for d in BENCHMARK if d.name == name), None)
    if held is None:
        raise ValueError(f"no such dataset: {name}")
    return held


def splits_of(name: str) -> dict[str, list[R.Part]]:
    held = dataset_of(name)
    if held.kind == "own":
        return {split: [R.Part(split, 0, n)] for split, n in OWN_SPLITS[name].items()}
    return R.split_parts(held.kind, held.rows, held.train, held.validation)


def read_named(spark: SparkSession, root: str, name: str, split: str) -> DataFrame:
    """Rows of a split of a named dataset, with its label."""
    parts = splits_of(name)
    if split not in parts:
        raise ValueError(f"{name} has no split {split}")
    held = dataset_of(name)
    folder = f"{root}/{held.package.split(':')[0]}"
    df = R.read_split({p.split: spark.read.parquet(f"{folder}/{p.split}") for p in parts[split]}, parts[split])
    return df.withColumn("label", DERIVED[held.derived]()) if held.derived else df


def image_models(spark: SparkSession) -> DataFrame:
    """Catalog rows of the predefined image models; sizes known, parameters not."""
    rows = [(f'{{"image_size":{s},"name":"{n}","url":"{u}"}}', b, s, "TensorFlow") for n, u, s, b in IMAGE_MODELS]
    return spark.createDataFrame(rows, "json_model string, batch_size long, image_size long, source string")


def text_models(spark: SparkSession) -> DataFrame:
    rows = [(f'{{"name":"{n}","url":"{u}"}}', b, "TensorFlow") for n, u, b in TEXT_MODELS]
    return spark.createDataFrame(rows, "json_model string, batch_size long, source string")
