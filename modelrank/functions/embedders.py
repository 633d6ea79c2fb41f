"""Embedding functions: what a candidate model does to a dataset.

No deep-learning runtime is assumed.  The built-in embedders are functions of
a vector column or of text; a neural model comes in as a ``BatchEmbedder``,
which is loaded once in each task and gets numpy batches.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors as V

IMAGE, TEXT, OTHER = "IMAGE", "TEXT", "OTHER"


class BatchEmbedder(Protocol):
    """A model for Arrow batches: ``load`` on the worker, then arrays in and out."""

    name: str
    data_type: str

    def load(self) -> Callable[[np.ndarray], np.ndarray]: ...


@dataclass(frozen=True)
class VectorEmbedder:
    """A model that is an expression over a vector column."""

    name: str
    expression: Callable[[Column], Column]
    data_type: str = OTHER


def _unit(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda v: V.l2_normalize(f(v))


def builtin() -> dict[str, VectorEmbedder]:
    """prefix, stride and suffix views of a vector, each also at unit length."""
    base: dict[str, Callable[[Column], Column]] = {f"prefix{n}": (lambda v, n=n: V.prefix(v, n)) for n in (8, 16, 32, 64)}
    base |= {f"stride{n}": (lambda v, n=n: V.stride(v, n)) for n in (2, 4)}
    base["suffix32"] = lambda v: V.suffix(v, 32)
    return {k: VectorEmbedder(k, f) for k, f in base.items()} | {f"{k}_l2": VectorEmbedder(f"{k}_l2", _unit(f)) for k, f in base.items()}


REGISTRY: dict[str, VectorEmbedder] = builtin()


def register(embedder: VectorEmbedder) -> None:
    REGISTRY[embedder.name] = embedder


def described(model: str) -> str:
    """What an embedder computes, as text: the same for equal expressions, whatever their lambdas are numbered."""
    return _text(REGISTRY[model]) if model in REGISTRY else model


@lru_cache(maxsize=4096)
def _text(embedder: VectorEmbedder) -> str:
    return re.sub(r"_[0-9]+", "", str(embedder.expression(F.col("embed"))))


def check_types(reader_type: str, model_type: str) -> None:
    """A model for images doesn't take text, nor the other way round; OTHER goes with all."""
    if OTHER not in (reader_type, model_type) and reader_type != model_type:
        raise ValueError(f"a model for {model_type} can't read {reader_type}")


def embed(df: DataFrame, models: list[str], vector: str = "embed") -> DataFrame:
    """(model, *columns, vector): every model's view of every row, from one scan."""
    rest = [F.col(c) for c in df.columns if c != vector]
    views = [F.struct(F.lit(m).alias("model"), REGISTRY[m].expression(V.doubles(F.col(vector))).alias(vector)) for m in models]
    return df.select(*rest, F.inline(F.array(*views)))


def embed_batches(df: DataFrame, model: BatchEmbedder, column: str, reader_type: str = OTHER, to: str = "embed") -> DataFrame:
    """Run a loaded model over Arrow batches; other columns pass through."""
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    check_types(reader_type, model.data_type)
    rest = [c for c in df.columns if c != column]
    schema = StructType([df.schema[c] for c in rest] + [StructField(to, ArrayType(DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        apply = model.load()
        for batch in batches:
            out = np.asarray(apply(batch[column].to_numpy()), np.float64).reshape(len(batch), -1)
            yield batch[rest].assign(**{to: list(out)})

    return df.mapInPandas(run, schema)


_TOKEN = re.compile(r"\w+", re.UNICODE)


def tokenise(text: str, length: int) -> np.ndarray:
    """Ids, mask and types of a text, 3 by ``length``, cut or padded; ids are hashes."""
    out = np.zeros((3, length), np.int64)
    words = [w.lower() for w in _TOKEN.findall(text or "")][:length]
    out[0, : len(words)] = [zlib.crc32(w.encode()) % 30_000 + 1 for w in words]
    out[1, : len(words)] = 1
    return out


def library_tokeniser(path: str, length: int, pad_id: int = 0) -> Callable[[str], np.ndarray]:
    """The same with the ids, mask and types that a tokenizer file gives, special
    tokens included; needs the tokenizers library."""
    from tokenizers import Tokenizer

    held = Tokenizer.from_file(path)
    held.enable_truncation(length)
    held.enable_padding(pad_id=pad_id, length=length)

    def run(text: str) -> np.ndarray:
        e = held.encode(text or "")
        return np.array([e.ids, e.attention_mask, e.type_ids], np.int64)

    return run


@dataclass
class HashedText:
    """Hashed bag of words at unit length."""

    width: int = 64
    name: str = "hashed_text"
    data_type: str = TEXT

    def load(self) -> Callable[[np.ndarray], np.ndarray]:
        def apply(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), self.width))
            for row, text in zip(out, texts):
                for w in _TOKEN.findall(text or ""):
                    row[zlib.crc32(w.lower().encode()) % self.width] += 1
                row /= np.sqrt((row * row).sum()) or 1.0
            return out

        return apply


class Principal:
    """Principal components fitted on the whole data (Spark's own), then applied."""

    def __init__(self, k: int):
        self.k = k

    def fit_transform(self, df: DataFrame, vector: str) -> DataFrame:
        from pyspark.ml.feature import PCA
        from pyspark.ml.functions import array_to_vector, vector_to_array

        held = df.withColumn("__v", array_to_vector(V.doubles(F.col(vector))))
        model = PCA(k=self.k, inputCol="__v", outputCol="__p").fit(held)
        return model.transform(held).withColumn(vector, vector_to_array("__p")).drop("__v", "__p")
