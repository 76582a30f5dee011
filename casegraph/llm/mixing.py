"""Mixing sources to target weights by capped water-filling (DataFrame operations only).

Every source has a weight. The mix shares ``budget_ratio`` times the corpus size by
weight; a source whose share exceeds ``max_epochs`` times its own size is clamped there,
and the excess is shared again by weight until no source is above its clamp. Sorting
sources by clamp / weight makes that fixpoint one running sum: the water level is
the largest of (budget - clamps so far) / (weights still open).

A document is then taken floor(target / source size) whole times. The fraction that is left is
filled along a seeded random order of the source's documents; the document at which
the fraction ends is taken in part, so a source meets its target to the word. The random
order is summed in two levels (hash bucket, then inside the bucket), so a source that
holds a third of the corpus never meets in one task.

Defined results: null text has size 0; a null source is a source of its own and sorts last;
an empty table gives an empty result; sources of size 0 have target 0. Repeated rows are
documents of their own; rows that share an id stand in the order of size and text, rows without one are spread by their texts. Columns beyond those named are ignored or, in the
``keep`` list, carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegraph.llm.common import n_words, stash, table

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
SEED = 42
#: Hash buckets a source's documents are summed in; 3 hex digits.
BUCKET_DIGITS = 3


def water_fill(sizes: DataFrame, budget_ratio: float, max_epochs: int) -> DataFrame:
    """(source, source_size, weight) -> the same with ``target`` double."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_clamp = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_clamp.rowsBetween(Window.unboundedPreceding, -1)
    after = by_clamp.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    clamp = F.col("source_size") * max_epochs
    budget = F.sum("source_size").over(everything) * F.lit(float(budget_ratio))
    level = (budget - F.coalesce(F.sum(clamp).over(before), F.lit(0))) / F.sum("weight").over(after)
    return (
        sizes.withColumn("level", level)
        .withColumn("target", F.least(clamp.cast("double"), F.max("level").over(everything) * F.col("weight")))
        .drop("level")
    )


def cycled_weights(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Adds ``weight``: the given ones, repeating, along the sources in code point order, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("long"))


def mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = WEIGHTS,
    budget_ratio: float = 1.5,
    max_epochs: int = 2,
    seed: int = SEED,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, repeats (double) and ``keep``."""
    # Rows without an id are told apart by their texts, else they would all stand at one place.
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text-"), F.md5(F.col("text").cast("binary"))))
    order: Column = F.md5(F.concat_ws("-", F.lit(str(seed)), name))
    sized = stash(
        docs.select("doc_id", "source", n_words("text").alias("size"), order.alias("__order"), F.xxhash64("text").alias("__text"), *keep)
        .withColumn("__bucket", F.substring("__order", 1, BUCKET_DIGITS)),
        "mix-sizes",
    )
    buckets = sized.groupBy("source", "__bucket").agg(F.sum("size").alias("__bucket_size"))
    sizes = buckets.groupBy("source").agg(F.sum("__bucket_size").alias("source_size"))
    targets = water_fill(cycled_weights(sizes, weights), budget_ratio, max_epochs).drop("weight")
    running = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("source", "__bucket", F.coalesce(F.sum("__bucket_size").over(running), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("source", "__bucket").orderBy("__order", "doc_id", "size", "__text").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    o, t = offsets.alias("o"), targets.alias("t")
    joined = (
        placed.alias("p")
        .join(o, F.col("p.source").eqNullSafe(F.col("o.source")) & (F.col("p.__bucket") == F.col("o.__bucket")))
        .join(t, F.col("p.source").eqNullSafe(F.col("t.source")))
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    part = F.floor(F.col("target") - whole * F.col("source_size") + 0.5).cast("long")
    left = F.greatest(part - F.col("__before") - F.col("__inside"), F.lit(0))
    taken = (whole * F.col("size") + F.least(left, F.col("size"))).cast("long")
    return joined.select(
        "doc_id", F.col("p.source").alias("source"), "size", F.col("source_size").cast("long").alias("source_size"), "target",
        taken.alias("taken"), *keep,
    ).withColumn("repeats", F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0.0)))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('42-' || CAST(doc_id AS VARCHAR)) AS ord
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
        - coalesce(sum(2 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w),
t AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), max(level) OVER () * weight) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
  CAST(whole * size + least(size, greatest(CAST(floor(target - whole * source_size + 0.5) AS BIGINT) - before, 0)) AS BIGINT) AS taken
FROM p
"""
