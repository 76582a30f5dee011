"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm.common import drop_stash, stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round. A node's smallest neighbour is a pre-aggregated minimum; the join back may be split by AQE where a hub is hot."""
    ends = edges.select("a", "b")
    if large:
        ends = ends.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = ends.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    met = ends.join(least, "a")
    if large:
        out = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) -> (node, root): every node that has an edge, and the smallest node it reaches.

    Each round is written to the shared folder, and only the edge count and a checksum reach the driver.
    """
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct()
    now, last = stash(down, "components"), None
    while True:
        told = now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if told == last or told[0] == 0:
            break
        then = stash(_star(_star(now, large=True), large=False), "components")
        drop_stash(now)
        now, last = then, told
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
