"""Grouped statistics over the edge table (A1-A6). Everything is by case."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casegraph.operators.ranks import kth_smallest, numbered
from casegraph.sources.shared import kept

CONTACTS = ("CALLED", "MESSAGED")
TEMPORAL = ("CALLED", "MESSAGED", "TRANSFERRED_TO", "LOCATED_AT")
COLUMNS = ("case_id", "kind", "node_ids", "ts", "score", "n")


def _ends(edges: DataFrame, types: tuple[str, ...]) -> DataFrame:
    return edges.filter(F.col("type").isin(*types) & F.col("ts").isNotNull()).select("case_id", F.explode(F.array("src", "dst")).alias("node"), "ts")


def _told(df: DataFrame, kind: str, nodes, ts, score, n) -> DataFrame:
    return df.select("case_id", F.lit(kind).alias("kind"), nodes.alias("node_ids"), ts.cast("timestamp").alias("ts"), score.cast("double").alias("score"), n.cast("long").alias("n"))


def volume_spikes(edges: DataFrame, *, bucket_hours: int = 1) -> DataFrame:
    """A1: hours in which a node's contacts stand 2.5 deviations above its own non-empty hours. Nodes are reduced to hours before the window sees them."""
    hour = F.window("ts", f"{bucket_hours} hours")["start"]
    counts = _ends(edges, TEMPORAL).groupBy("case_id", "node", hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("case_id", "node")
    sd = F.coalesce(F.nullif(F.stddev_pop("n").over(own), F.lit(0.0)), F.lit(1.0))
    scored = counts.select("*", F.avg("n").over(own).alias("mean"), sd.alias("sd"), F.sum("n").over(own).alias("total"), F.count(F.lit(1)).over(own).alias("hours"))
    z = (F.col("n") - F.col("mean")) / F.col("sd")
    found = scored.withColumn("z", z).filter((F.col("total") >= 6) & (F.col("hours") >= 3) & (F.col("z") >= 2.5) & (F.col("n") >= F.greatest(F.lit(3.0), 2 * F.col("mean"))))
    return _told(found, "volume_spike", F.array("node"), F.col("hour"), F.round("z", 2), F.col("n"))


def handset_swaps(edges: DataFrame) -> DataFrame:
    """A2: devices registered to two phones or more."""
    pairs = edges.filter("type = 'REGISTERED_TO' and src like 'device:%'").select("case_id", "src", "dst").distinct()
    found = pairs.groupBy("case_id", "src").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("dst")).alias("phones")).filter("n >= 2")
    return _told(found, "handset_swap", F.concat(F.array("src"), F.col("phones")), F.lit(None), F.col("n"), F.col("n"))


def one_way_accounts(edges: DataFrame) -> DataFrame:
    """A3: accounts with three transfers or more, all in or all out."""
    ends = edges.filter("type = 'TRANSFERRED_TO'").select("case_id", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("out")))).alias("e"), "ts")
    counts = ends.groupBy("case_id", "e.node").agg(F.count(F.lit(1)).alias("n"), F.sum("e.out").alias("sent"), F.min("ts").alias("first"))
    found = counts.filter("n >= 3 and (sent = 0 or sent = n)")
    return _told(found, "one_way_account", F.array("node"), F.col("first"), F.col("n"), F.col("n"))


def large_transfers(edges: DataFrame) -> DataFrame:
    """A4: amounts of 5 medians, and of the median and two deviations, or more; in cases with five amounts or more."""
    sums = edges.filter("type = 'TRANSFERRED_TO' and amount is not null")
    stats = kept(sums.groupBy("case_id").agg(F.stddev_pop("amount").alias("sd"), F.count(F.lit(1)).alias("amounts")).filter("amounts >= 5"), "amounts")
    # The median of an even number is the mean of the two in the middle.
    middle = stats.select("case_id", F.explode(F.array(F.floor((F.col("amounts") - 1) / 2), F.floor(F.col("amounts") / 2))).alias("k"))
    medians = kth_smallest(sums.join(stats, "case_id", "left_semi"), middle, ["case_id"], "amount").groupBy("case_id").agg(F.avg("amount").alias("median"))
    stats = stats.join(medians, "case_id")
    limit = F.greatest(F.col("median") * 5, F.col("median") + 2 * F.coalesce(F.nullif("sd", F.lit(0.0)), F.lit(1.0)))
    found = sums.join(stats, "case_id").filter(F.col("amount") >= limit)
    return _told(found, "large_transfer", F.array("src", "dst"), F.col("ts"), F.round(F.col("amount") / F.greatest("median", F.lit(1.0)), 2), F.col("amounts"))


def went_silent(edges: DataFrame) -> DataFrame:
    """A5: numbers in contact 8 times or more over 3 days or more, then quiet for 3 days and 0.4 of that span, by the case's latest contact."""
    seen = _ends(edges, CONTACTS).groupBy("case_id", "node").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    latest = seen.groupBy("case_id").agg(F.max("b").alias("latest"))
    days = lambda x, y: (F.unix_micros(y) - F.unix_micros(x)) / 86_400_000_000
    found = seen.join(latest, "case_id").withColumn("span", days(F.col("a"), F.col("b"))).withColumn("quiet", days(F.col("b"), F.col("latest")))
    found = found.filter((F.col("n") >= 8) & (F.col("span") >= 3) & (F.col("quiet") >= F.greatest(F.lit(3.0), F.col("span") * 0.4)))
    return _told(found, "went_silent", F.array("node"), F.col("b"), F.round("quiet", 1), F.col("n"))


def anomalies(edges: DataFrame, *, bucket_hours: int = 1) -> DataFrame:
    """All of them; rank them with :func:`ranked`."""
    return reduce(DataFrame.union, [volume_spikes(edges, bucket_hours=bucket_hours), handset_swaps(edges), one_way_accounts(edges), large_transfers(edges), went_silent(edges)])


def ranked(found: DataFrame) -> DataFrame:
    """By score, then kind; the rank is by case."""
    return numbered(found, ["case_id"], [F.col("score").desc(), F.col("kind").asc(), F.array_join("node_ids", ",").asc(), F.col("ts").asc()])
