"""Rule-based findings over graph, metrics and documents (F1-F8). Each returns case_id, kind, severity, headline, node_ids, ts and is bounded by case."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casegraph.operators.graph import both_ways, pair_edges

# Kinds of documents that somebody wrote about people, and how an anomaly is told.
REPORT_KINDS = ("fir", "surveillance", "note", "intelligence")
ANOMALY_TOLD = {
    "volume_spike": ("medium", "Contact rate far above its own average"),
    "handset_swap": ("high", "One handset used with several numbers"),
    "one_way_account": ("medium", "Money moves through this account in one direction only"),
    "large_transfer": ("high", "Transfer far above the case median"),
    "went_silent": ("medium", "Contact stopped after regular activity"),
}
SEVERITIES = ("high", "medium", "low")


def _top(df: DataFrame, n: int, *order) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy("case_id").orderBy(*order))).filter(F.col("__k") <= n).drop("__k")


def _told(df: DataFrame, kind: str, severity, headline, nodes, ts=None) -> DataFrame:
    ts = F.lit(None).cast("timestamp") if ts is None else ts.cast("timestamp")
    return df.select("case_id", F.lit(kind).alias("kind"), severity.alias("severity"), headline.alias("headline"), nodes.alias("node_ids"), ts.alias("ts"))


def reported(named: DataFrame, documents: DataFrame) -> DataFrame:
    """named (case_id, node, doc_id) -> the nodes that a report names; from all facts, not from bounded sources."""
    reports = documents.filter(F.col("kind").isin(*REPORT_KINDS)).select("case_id", "doc_id")
    return named.join(reports, ["case_id", "doc_id"], "left_semi").select("case_id", "node").distinct()


def hidden_brokers(metrics: DataFrame, degree: DataFrame, in_reports: DataFrame, *, most_contacts: int = 6, rank: int = 5, limit: int = 3) -> DataFrame:
    """people at or above the fifth betweenness among people, with few contacts, named in no report."""
    people = metrics.filter("node like 'person:%'")
    down = Window.partitionBy("case_id").orderBy(F.col("betweenness").desc(), "node")
    # Fewer than five people: the last one's score is the cut.
    cut = people.withColumn("k", F.row_number().over(down)).filter(F.col("k") <= rank).groupBy("case_id").agg(F.min("betweenness").alias("cut"))
    found = people.join(cut, "case_id").filter("betweenness > 0 and betweenness >= cut").join(degree.select("case_id", "node", "neighbours"), ["case_id", "node"], "left").na.fill(0, ["neighbours"])
    found = found.filter(F.col("neighbours") <= most_contacts).join(in_reports, ["case_id", "node"], "left_anti")
    found = _top(found, limit, F.col("betweenness").desc(), "node")
    return _told(found, "hidden_broker", F.lit("high"), F.concat("node", F.lit(" connects this network but appears in no report")), F.array("node"))


def undocumented_people(known: DataFrame, degree: DataFrame, in_reports: DataFrame, *, least_contacts: int = 2, limit: int = 5) -> DataFrame:
    """people (case_id, node) that records know, with two contacts or more, in no report; the best connected first."""
    found = known.filter("node like 'person:%'").distinct().join(in_reports, ["case_id", "node"], "left_anti").join(degree, ["case_id", "node"]).filter(F.col("neighbours") >= least_contacts)
    found = _top(found, limit, F.col("neighbours").desc(), "node")
    return _told(found, "undocumented_person", F.lit("medium"), F.concat("node", F.lit(" is linked by records but named in no report")), F.array("node"))


def single_contacts(pairs_: DataFrame, membership: DataFrame, *, most_links: int = 2, limit: int = 2) -> DataFrame:
    """communities that one or two pairs join."""
    ma, mb = membership.select("case_id", F.col("node").alias("a"), F.col("community").alias("ca")), membership.select("case_id", F.col("node").alias("b"), F.col("community").alias("cb"))
    across = pairs_.join(ma, ["case_id", "a"]).join(mb, ["case_id", "b"]).filter("ca <> cb")
    joins = across.groupBy("case_id", F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.count(F.lit(1)).alias("links"), F.min(F.struct("a", "b")).alias("one"), F.max(F.struct("a", "b")).alias("two"))
    # Of two links the least and the largest are both; with more the pair is passed over.
    found = _top(joins.filter(F.col("links") <= most_links), limit, "links", "x", "y")
    return _told(found, "single_point_of_contact", F.lit("high"), F.format_string("Groups %s and %s meet in %d places", "x", "y", "links"), F.array_sort(F.array_distinct(F.array("one.a", "one.b", "two.a", "two.b"))))


def repeat_offenders(facts: DataFrame, *, least_cases: int = 3, limit: int = 5) -> DataFrame:
    """people with three prior cases or more; convictions counted apart, and they make it serious."""
    prior = facts.filter("type = 'MENTIONED_IN' and basis = 'criminal_history' and src like 'person:%'")
    told = prior.groupBy("case_id", "src").agg(
        F.countDistinct("dst").alias("cases"), F.count_distinct(F.when(F.col("disposition") == "convicted", F.col("dst"))).alias("convictions"), F.max("ts").alias("last")
    ).filter(F.col("cases") >= least_cases)
    found = _top(told, limit, F.col("convictions").desc(), F.col("cases").desc(), "src")
    headline = F.format_string("%s is named in %d prior cases, %d of them convictions", "src", "cases", "convictions")
    return _told(found, "repeat_offender", F.when(F.col("convictions") > 0, "high").otherwise("medium"), headline, F.array("src"), F.col("last"))


def prior_associations(edges: DataFrame, membership: DataFrame, *, limit: int = 5) -> DataFrame:
    """people accused together before; serious if they now stand in different communities."""
    pairs_ = edges.filter("type = 'CO_OCCURS' and array_contains(bases, 'co_accused')").select("case_id", "src", "dst").distinct()
    ms, md = membership.select("case_id", F.col("node").alias("src"), F.col("community").alias("cs")), membership.select("case_id", F.col("node").alias("dst"), F.col("community").alias("cd"))
    told = pairs_.join(ms, ["case_id", "src"], "left").join(md, ["case_id", "dst"], "left")
    severity = F.when(F.col("cs") != F.col("cd"), "high").otherwise("low")
    found = _top(told.withColumn("severity", severity), limit, "severity", "src", "dst")
    return _told(found, "prior_association", F.col("severity"), F.format_string("%s and %s were accused together before", "src", "dst"), F.array("src", "dst"))


def promoted(anomalies: DataFrame, *, limit: int = 12) -> DataFrame:
    """the first ranked anomalies as findings."""
    table = lambda i: F.create_map(*(F.lit(x) for k, v in ANOMALY_TOLD.items() for x in (k, v[i])))
    found = anomalies.filter(F.col("rank") <= limit)
    return found.select("case_id", "kind", F.element_at(table(0), F.col("kind")).alias("severity"), F.element_at(table(1), F.col("kind")).alias("headline"), "node_ids", "ts")


def ranked(*parts: DataFrame) -> DataFrame:
    """all findings, the serious first, numbered f1, f2, ..."""
    severity = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    # Every part is limited by case, so a case's findings are few.
    order = Window.partitionBy("case_id").orderBy(severity, "kind", "headline", F.array_join("node_ids", ","), "ts")
    return reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(order)).withColumn("id", F.concat(F.lit("f"), "rank"))


def edges_around(nodes: DataFrame, edges: DataFrame, *, limit: int = 40) -> DataFrame:
    """F8: (case_id, node, edge_ids): the first edges at each node; bounded before the list is built."""
    around = both_ways(pair_edges(edges), "id").select("case_id", F.col("u").alias("node"), "id").join(nodes.select("case_id", "node"), ["case_id", "node"], "left_semi")
    first = around.withColumn("k", F.row_number().over(Window.partitionBy("case_id", "node").orderBy("id"))).filter(F.col("k") <= limit)
    return first.groupBy("case_id", "node").agg(F.array_sort(F.collect_list("id")).alias("edge_ids"))
