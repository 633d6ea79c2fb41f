"""Tables between rounds of an iterative plan, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="modelrank-rounds-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one of this process, if all of Spark runs in it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{_own_folder()}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written and read back: executors may go, and lineage stays short."""
    path = f"{root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from the driver's checkout."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if repo not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (repo, env.get("PYTHONPATH", "")) if x)
