"""Connected components by alternating star contractions, in DataFrame operations.

Every round is two aggregations and two joins whose outputs have no more rows
than the links have.  Rounds grow with the logarithm of the graph, and each
round's links are written to the shared folder, so lineage stays short and
nothing but two sums reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours, linked to the least node around it."""
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours, linked to the least of them; u > v in and out."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    rest = links.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for every node of the links (u, v): the least node of its component.

    Links from a node to itself are passed over; without links there are no rows.
    """
    now = stored(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, old = mark, now
        now = stored(_small_star(_large_star(now)), "links")
        dropped(old)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
