"""What the text operators share: the scratch folder, batch mapping, shared files.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``; every executor and the driver see it, so a lost
executor costs only the tasks it ran.  Nothing here caches or checkpoints
locally.
"""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch


#: Bytes of an Arrow batch: with whole texts in it, Spark's own limit would
#: let a batch take a good part of an executor's memory on both sides.
BATCH_BYTES = 8 << 20


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package, one library thread in each, and
    keep batches of whole texts small."""
    scratch.importable(spark)
    spark.sparkContext.environment.setdefault("TOKENIZERS_PARALLELISM", "false")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_root(spark: SparkSession) -> str:
    importable(spark)
    return scratch.root(spark)


#: Paths that were given out in open scopes, innermost last.
_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the scratch folder and read back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path  # for dropped()
    return out


def delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote and that no later plan reads."""
    for df in tables:
        if path := getattr(df, "scratch", None):
            delete(df.sparkSession, path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Whatever is written to the scratch folder inside goes at the end, but for
    the paths that the caller takes out of the list."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes[:] = [x for x in _scopes if x is not made]
        for path in made:
            delete(spark, path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a folder or file, and the path within it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    scheme, rest = uri.split("://", 1)
    return pafs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


@contextmanager
def new_file(uri: str) -> Iterator[pa.NativeFile]:
    """A stream to a file that nobody else writes: ``uri`` has a part that is
    new for each attempt (see ``attempt``), so nothing is moved or replaced, and
    only names that committed rows carry are ever read."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        yield out


def attempt() -> str:
    """What tells this attempt of a task from all others."""
    return uuid.uuid4().hex


def put_file(uri: str, parts: list[bytes]) -> str:
    """Write a file under a name of this attempt's own; the name."""
    uri = f"{uri}-{attempt()}"
    with new_file(uri) as out:
        for part in parts:
            out.write(part)
    return uri


def open_file(uri: str) -> pa.NativeFile:
    """Random access; memory-mapped where the file system is local."""
    fs, path = filesystem(uri)
    return pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)


@contextmanager
def collector_paused() -> Iterator[None]:
    """No search for cycles among millions of small strings and lists that can have none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def blocks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes add up to about ``limit``."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


#: Bytes of text that a Python worker works on at once.
BLOCK_BYTES = 4 << 20


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the named column has about ``limit`` bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for a, b in blocks(lengths, limit):
            yield batch.slice(a, b - a)


def map_text(df: DataFrame, text: str, keep: list[str], fields: str, make: Callable[[], Callable[[list], list[pa.Array]]], block: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns of ``df`` plus ``fields`` computed from its text.

    ``make()`` runs once in each task and returns a function from a list of
    texts (str or None) to one Arrow array per field.  Other columns are not
    read, so names that they share with the fields do no harm; a field
    replaces a kept column of its name.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    importable(df.sparkSession)
    new = StructType.fromDDL(fields)
    keep = [c for c in keep if c not in new.names]
    held = df.select(F.col(f"`{text}`").cast("string").alias("__text"), *[F.col(f"`{c}`") for c in keep])
    schema = StructType([f for f in held.schema.fields if f.name != "__text"] + new.fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in text_blocks(batches, "__text", block):
            made = work(batch.column("__text").to_pylist())
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip([*kept, *made], arrow)], schema=arrow)

    return held.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 2 modulo 4; null ids don't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def hash_sample(df: DataFrame, limit: int) -> DataFrame:
    """Different rows of ``df``, ``limit`` at most, chosen by a hash of all their
    values: the same ones whatever the partitions, repeated rows once.

    The driver learns one number, the greatest hash that is taken.
    """
    hashed = df.withColumn("__h", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    hashes = stored(hashed.select("__h").distinct(), "hashes")
    n, low = hashes.count(), -(1 << 63)
    if n > limit:
        # few more than needed are sorted: the hashes are spread evenly
        some = hashes.filter(F.col("__h") < low + min((1 << 64) - 1, int((2 * limit + 64) / n * (1 << 64))))
        hashed = hashed.filter(F.col("__h") <= some.orderBy("__h").limit(limit).agg(F.max("__h")).first()[0])
    dropped(hashes)
    return hashed.dropDuplicates(["__h"]).drop("__h")
