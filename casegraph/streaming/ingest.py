"""Records that arrive as a stream: an extension, the batch jobs need none of it.

Edge facts are built by the batch jobs themselves; what is new is what has to be remembered between batches. State is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.operators import edges


def read_records(spark: SparkSession, path: str, schema: str, *, files_per_batch: int = 16) -> DataFrame:
    """Record tables that arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def call_facts(raw: DataFrame) -> DataFrame:
    """Raw call records to edge facts; stateless, so the batch job serves."""
    return edges.calls(raw)


def merged_batches(facts: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands each batch of facts to a keyed merge, which may see a batch twice after a failure and then changes nothing."""
    return facts.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(facts: DataFrame, *, late: str = "1 day") -> DataFrame:
    """Dated facts less repeats of the same contact that come within the allowed lateness."""
    return facts.withWatermark("ts", late).dropDuplicatesWithinWatermark(["case_id", "src", "dst", "type", "ts"])


def hourly_contacts(facts: DataFrame, *, late: str = "1 day", hours: int = 1) -> DataFrame:
    """Contacts of each node by hour, final once the watermark has passed the hour: the counts that volume spikes are found in."""
    ends = facts.filter("ts is not null").withWatermark("ts", late).select("case_id", F.explode(F.array("src", "dst")).alias("node"), "ts")
    counts = ends.groupBy("case_id", "node", F.window("ts", f"{hours} hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("case_id", "node", F.col("w.start").alias("hour"), "n")
