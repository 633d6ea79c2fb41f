"""Known answers that follow a stream of edits.

A folder of edit files is an append-only stream (seq, base_idx, embed, label).
Label edits need no distance: stored nearest neighbours are labelled anew.
Each micro-batch replaces the table of answers by its next version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.neighbours import errors
from ..operators.overlay import relabel

EDITS = "seq long, reader_idx int, idx long, label long"


def watch_label_edits(spark: SparkSession, folder: str, nearest: str, answers: str, checkpoint: str) -> StreamingQuery:
    """Refresh error rates in ``answers`` whenever label edits arrive in ``folder``.

    ``nearest`` is a table of stored neighbours.  All edits so far are read
    again with each batch, so a batch that is repeated gives the same answers.
    """

    def refresh(batch: DataFrame, number: int) -> None:
        every = spark.read.schema(EDITS).parquet(folder)
        found = relabel(spark.read.parquet(nearest), every)
        errors(found, "model").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{answers}/batch={number}")

    edits = spark.readStream.schema(EDITS).parquet(folder)
    return edits.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted_by_window(events: DataFrame, time: str, size: str, late: str, *by: str) -> DataFrame:
    """Rows in tumbling windows, for a stream or a table; rows later than ``late`` are left out of a stream."""
    held = events.withWatermark(time, late) if events.isStreaming else events
    return held.groupBy(F.window(time, size).alias("window"), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")
