"""Datasets: row numbers, slices, samples, batches, splits and where rows come from."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from .scratch import kept

RESERVED = ("embed", "label")


def with_row_idx(df: DataFrame, *order: str | Column, name: str = "row_idx") -> DataFrame:
    """Rows numbered from 0 in a given order, without gathering them in one task:
    ranges are sorted apart, and a range's offset is the size of those before."""
    held = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    held = kept(held.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["n"] for r in held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row for each range
    offsets, total = [], 0
    for p in sorted(sizes):
        offsets += [F.lit(p), F.lit(total).cast("long")]
        total += sizes[p]
    if not offsets:
        return held.withColumn(name, F.lit(0).cast("long")).drop("__at")
    return held.withColumn(name, F.element_at(F.create_map(*offsets), part) + place).drop("__at")


def slice_rows(df: DataFrame, start: int, stop: int, idx: str = "row_idx") -> DataFrame:
    """Rows of [start, stop)."""
    if not 0 <= start <= stop:
        raise ValueError(f"no such slice: [{start}, {stop})")
    return df.filter((F.col(idx) >= start) & (F.col(idx) < stop))


def permuted(df: DataFrame, seed: int, key: str = "row_idx", name: str = "place") -> DataFrame:
    """A permutation that the seed fixes, by an integer formula over the key."""
    mixed = F.pmod((F.col(key) + F.lit(seed)) * F.lit(2654435761), F.lit(1 << 32))
    return with_row_idx(df.withColumn("__mixed", mixed), "__mixed", key, name=name).drop("__mixed")


def sample_range(df: DataFrame, start: int, stop: int, seed: int | None = None) -> DataFrame:
    """Rows [start, stop) of the rows as they are or as the seed deals them."""
    n = df.count()
    if not 0 <= start <= stop <= n:
        raise ValueError(f"no such range in {n} rows: [{start}, {stop})")
    if seed is None:
        return slice_rows(df, start, stop)
    return slice_rows(permuted(df, seed), start, stop, "place").drop("place")


def random_subset(df: DataFrame, k: int, key: str, seed: int = 0) -> DataFrame:
    """``k`` rows without replacement, fixed by the seed."""
    return df.orderBy(F.pmod((F.col(key) + F.lit(seed)) * F.lit(2654435761), F.lit(1 << 32)), key).limit(k)


def batch_numbers(df: DataFrame, size: int, drop_remainder: bool = False, idx: str = "row_idx") -> DataFrame:
    """The batch of each row; the last may be short, or left out."""
    out = df.withColumn("batch", F.floor(F.col(idx) / F.lit(size)).cast("long"))
    return out.filter(F.col("batch") < df.count() // size) if drop_remainder else out


def repeat(df: DataFrame, epochs: int) -> DataFrame:
    """Every row once for each epoch."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def positional_split(df: DataFrame, ratio: float, idx: str = "row_idx") -> tuple[DataFrame, DataFrame]:
    cut = int(df.count() * ratio)
    return df.filter(F.col(idx) < cut), df.filter(F.col(idx) >= cut)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """The weight of each row so that classes weigh the same and all rows weigh 1."""
    counts = df.groupBy(label).agg(F.count("*").alias("__n"))
    classes = counts.agg(F.count("*").alias("__c"))
    return df.join(counts.crossJoin(F.broadcast(classes)), label).withColumn("weight", 1.0 / F.col("__n") / F.col("__c")).drop("__n", "__c")


def balanced_sample(df: DataFrame, n: int, key: str, label: str = "label", seed: int = 0) -> DataFrame:
    """About ``n`` rows with classes alike, with replacement: each row comes as
    often as its weight says, and once more by a draw that the seed fixes."""
    expected = F.col("weight") * n
    draw = F.pmod((F.col(key) + F.lit(seed)) * F.lit(2654435761), F.lit(1 << 32)) / F.lit(float(1 << 32))
    times = (F.floor(expected) + F.when(draw < expected - F.floor(expected), 1).otherwise(0)).cast("int")
    return class_weights(df, label).withColumn("__t", times).filter("__t > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__t")))).drop("__t", "weight")


@dataclass(frozen=True)
class Part:
    """A slice of a named split; no stop means to the end, fractions are of its size."""

    split: str
    start: int | float = 0
    stop: int | float | None = None


def split_parts(kind: str, train_size: int = 0, train_percent: int = 0, validation_percent: int = 0) -> dict[str, list[Part]]:
    """The named splits of a dataset that has all three splits ("full"), train
    and test ("train_test"), only train ("train"), or train and test where
    half of test is for validation ("halved_test")."""
    n = train_percent * train_size // 100
    m = validation_percent * train_size // 100
    if kind == "full":
        val, trainval, test = [Part("validation")], [Part("train"), Part("validation")], [Part("test")]
        train, val200 = [Part("train")], [Part("validation", 0, 200)]
    elif kind == "train_test":
        train, val, trainval, test = [Part("train", 0, n)], [Part("train", n)], [Part("train")], [Part("test")]
        val200 = [Part("train", n, n + 200)]
    elif kind == "train":
        train, val, trainval, test = [Part("train", 0, n)], [Part("train", n, n + m)], [Part("train", 0, n + m)], [Part("train", n + m)]
        val200 = [Part("train", n, n + 200)]
    elif kind == "halved_test":
        train, val, test = [Part("train")], [Part("test", 0, 0.5)], [Part("test", 0.5)]
        trainval, val200 = [*train, *val], [Part("test", 0, 200)]
    else:
        raise ValueError(f"no such kind of splits: {kind}")
    few = [Part("train", 0, 800)]
    return {"train": train, "val": val, "trainval": trainval, "test": test, "train800": few, "val200": val200, "train800val200": [*few, *val200]}


def read_split(splits: dict[str, DataFrame], parts: list[Part], idx: str = "row_idx") -> DataFrame:
    """The parts one after another; each split has its own row numbers."""
    out = None
    for p in parts:
        df = splits[p.split]
        n = df.count() if isinstance(p.start, float) or isinstance(p.stop, float) else 0
        start, stop = (int(x * n) if isinstance(x, float) else x for x in (p.start, p.stop))
        df = df.filter(F.col(idx) >= start) if stop is None else slice_rows(df, start, stop, idx)
        out = df if out is None else out.unionByName(df)
    return out


def proportional_slices(sizes: list[int], pulls: list[int], chunk: int) -> list[list[tuple[int, int]]]:
    """Slices of each reader for the pulls [0, r0, r1, ...]: the first reader
    grows by ``chunk`` for each pull made so far, others in proportion, and
    slices lie end to end until the reader is used up."""
    totals, held = [], 0
    for p in pulls:
        held += p
        totals.append(held)
    out = []
    for size in sizes:
        step, start, slices = math.ceil(size * chunk / sizes[0]), 0, []
        for total in totals[1:]:
            stop = min(size, start + step * total)
            slices.append((start, stop))
            if stop == size:
                break
            start = stop
        out.append(slices)
    return out


def concat_readers(readers: list[DataFrame]) -> DataFrame:
    """Readers in order, each row with the number of its reader; at least one."""
    if not readers:
        raise ValueError("no readers")
    out = None
    for i, df in enumerate(readers):
        df = df.withColumn("reader_idx", F.lit(i))
        out = df if out is None else out.unionByName(df)
    return out


def field_at(schema: StructType, path: list[str]) -> DataType:
    """The type at a nested path.  KeyError: unknown, or longer than the data
    is deep.  ValueError: into or up to a sequence, or only up to a struct."""
    at: DataType = schema
    for name in path:
        if isinstance(at, ArrayType):
            raise ValueError(f"{name}: a sequence can't be stepped into")
        if not isinstance(at, StructType) or name not in at.names:
            raise KeyError(name)
        at = at[name].dataType
    if isinstance(at, (StructType, ArrayType)):
        raise ValueError(f"{path} ends on a {at.typeName()}")
    return at


def data_type(schema: StructType, path: list[str]) -> str:
    at = field_at(schema, path)
    return "TEXT" if isinstance(at, StringType) else "IMAGE" if isinstance(at, BinaryType) else "OTHER"


def extract(df: DataFrame, embed: list[str] | None, label: list[str] | None, other: dict[str, list[str]] | None = None) -> DataFrame:
    """Nested fields under new names: embed, label and others.  One of the two is given at least."""
    if not embed and not label:
        raise ValueError("neither features nor labels are asked for")
    other = other or {}
    if any(n in RESERVED for n in other):
        raise ValueError(f"names that mean something already: {RESERVED}")
    paths = ({"embed": embed} if embed else {}) | ({"label": label} if label else {}) | other
    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(name) for name, path in paths.items()])


#: Named datasets: name -> function of the session to {split: DataFrame}.
DATASETS: dict[str, Callable[[SparkSession], dict[str, DataFrame]]] = {}


def dataset(name: str) -> Callable:
    """Register a function under a dataset's name."""

    def put(f: Callable[[SparkSession], dict[str, DataFrame]]) -> Callable:
        DATASETS[name] = f
        return f

    return put


def read_csv(spark: SparkSession, path: str, columns: dict[str, str], sep: str = ",", header: bool = False) -> DataFrame:
    """Columns by position, with their names and types."""
    return spark.read.csv(path, schema=", ".join(f"`{n}` {t}" for n, t in columns.items()), sep=sep, header=header)


def read_json_folder(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All JSON documents of a folder as one table."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_npz(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Row-aligned arrays of a folder of .npz files.  KeyError: a column is
    missing; ValueError: columns of different lengths."""
    import io

    import numpy as np
    import pandas as pd

    def run(batches):
        for batch in batches:
            for data in batch["content"]:
                held = np.load(io.BytesIO(data), allow_pickle=False)
                missing = [c for c in columns if c not in held.files]
                if missing:
                    raise KeyError(missing[0])
                arrays = {c: held[c] for c in columns}
                if len({len(a) for a in arrays.values()}) > 1:
                    raise ValueError("columns of different lengths")
                yield pd.DataFrame({c: [x.decode() if isinstance(x, bytes) else x.reshape(-1).tolist() if a.ndim > 1 else x.item() if hasattr(x, "item") else x for x in a] for c, a in arrays.items()})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("content")
    return files.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in columns.items()))


def read_image_folder(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    """(path, content, label): the label is the place of a file's folder among
    all ``folders`` in order of name, those without files included."""
    places = F.create_map(*[x for i, f in enumerate(sorted(folders)) for x in (F.lit(f), F.lit(i))])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    folder = F.element_at(F.split("path", "/"), -2)
    return files.select("path", "content", F.element_at(places, folder).alias("label"))


def rows_per_file(max_rows: int | None, max_values: int | None, values_per_row: int) -> int:
    caps = [c for c in (max_rows, max_values // values_per_row if max_values else None) if c]
    return min(caps) if caps else 0


def write_rows(df: DataFrame, path: str, max_rows: int | None = None, max_values: int | None = None, values_per_row: int = 1) -> None:
    """Parquet with so many rows a file at most; a folder that exists is replaced."""
    cap = rows_per_file(max_rows, max_values, values_per_row)
    writer = df.write.mode("overwrite")
    (writer.option("maxRecordsPerFile", cap) if cap else writer).parquet(path)


def check_indices(indices: list[int]) -> None:
    """Indices of an edit begin at 0 or later and ascend."""
    if any(i < 0 for i in indices) or any(b <= a for a, b in zip(indices, indices[1:])):
        raise ValueError("indices must be 0 or more and ascend")
