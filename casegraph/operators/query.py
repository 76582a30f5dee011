"""Lookups and reports over nodes, edges and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegraph.functions.normalize import plural
from casegraph.operators.findings import REPORT_KINDS
from casegraph.operators.graph import both_ways
from casegraph.operators.ranks import numbered


def nodes_of_type(nodes: DataFrame, type_: str | None = None) -> DataFrame:
    """Q1."""
    return nodes if type_ is None else nodes.filter(F.col("type") == type_)


def search(nodes: DataFrame, query: str, *, type_: str | None = None, limit: int = 25) -> DataFrame:
    """Q2: nodes whose label or id holds the text, as it stands: equal labels first, then prefixes, then the rest; short labels first."""
    q, label = query.strip().lower(), F.lower("label")
    found = nodes_of_type(nodes, type_).filter(label.contains(q) | F.lower("id").contains(q))
    order = F.when(label == q, 0).when(label.startswith(q), 1).otherwise(2)
    return found.withColumn("match", order).orderBy("match", F.length("label"), "label", "id").limit(limit)


def edges_where(edges: DataFrame, *, node_id: str | None = None, types: tuple[str, ...] = (), start=None, end=None) -> DataFrame:
    """Q3: by either end, types and an inclusive time range; every condition reaches the scan."""
    if node_id is not None:
        edges = edges.filter((F.col("src") == node_id) | (F.col("dst") == node_id))
    if types:
        edges = edges.filter(F.col("type").isin(*types))
    if start is not None:
        edges = edges.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        edges = edges.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    return edges.orderBy("ts", "id")


def timeline(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Q7: dated edges with both labels."""
    label = lambda end: nodes.select("case_id", F.col("id").alias(end), F.coalesce("label", "id").alias(f"{end}_label"))
    dated = edges.filter("ts is not null").join(label("src"), ["case_id", "src"], "left").join(label("dst"), ["case_id", "dst"], "left")
    src, dst = F.coalesce("src_label", "src"), F.coalesce("dst_label", "dst")
    return dated.select("case_id", "id", "ts", "type", src.alias("src_label"), dst.alias("dst_label"), F.format_string("%s %s %s", src, F.col("type"), dst).alias("line"))


def without_documents(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q8: the graph without document nodes; edges stay if both ends do."""
    shown = nodes.filter("type <> 'document'")
    end = lambda c: shown.select("case_id", F.col("id").alias(c))
    return shown, edges.join(end("src"), ["case_id", "src"], "left_semi").join(end("dst"), ["case_id", "dst"], "left_semi")


def profiles(edges: DataFrame) -> DataFrame:
    """Q9: by node: incident edges, distinct neighbours, distinct edge types."""
    ends = edges.select("case_id", F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("e"), "type")
    return ends.groupBy("case_id", F.col("e.node").alias("node")).agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("e.other").alias("neighbours"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


def profile_documents(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """Q9: (case_id, id, place, doc_id, kind): the distinct documents among a node's sources, in the order of the sources."""
    cited = sources.select("case_id", "id", F.posexplode("sources").alias("at", "s")).groupBy("case_id", "id", F.col("s.doc_id").alias("doc_id")).agg(F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("case_id", "id").orderBy("at"))
    return cited.join(documents.select("case_id", "doc_id", "kind"), ["case_id", "doc_id"]).withColumn("place", place).drop("at")


def case_counts(**tables: DataFrame) -> DataFrame:
    """Q10: rows of each table by case."""
    out = None
    for name, df in tables.items():
        one = df.groupBy("case_id").agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.join(one, "case_id", "full")
    return out.na.fill(0)


def people_first(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Q11: nodes by degree, people and organisations before the rest."""
    degree = edges.select("case_id", F.explode(F.array("src", "dst")).alias("id")).groupBy("case_id", "id").agg(F.count(F.lit(1)).alias("degree"))
    out = nodes.join(degree, ["case_id", "id"], "left").na.fill(0, ["degree"]).withColumn("who", F.col("type").isin("person", "organization"))
    return numbered(out, ["case_id"], [F.col("who").desc(), F.col("degree").desc(), F.col("id").asc()])


def opening(nodes: DataFrame, pairs_: DataFrame, *, size: int = 26, people: float = 0.55) -> DataFrame:
    """Q12: the top people and organisations by neighbours, and the other nodes that join two of them or more, by how many; people nobody joins go."""
    degree = both_ways(pairs_).groupBy("case_id", F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    who = nodes.filter("type in ('person', 'organization')").join(degree, ["case_id", "id"])
    top = Window.partitionBy("case_id").orderBy(F.col("degree").desc(), "id")
    heads = who.withColumn("k", F.row_number().over(top)).filter(F.col("k") <= round(size * people)).select("case_id", "id")
    touch = both_ways(pairs_).join(heads.withColumnRenamed("id", "v"), ["case_id", "v"])
    joins = touch.join(heads.withColumnRenamed("id", "u"), ["case_id", "u"], "left_anti").groupBy("case_id", F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("joins")).filter("joins >= 2")
    first = Window.partitionBy("case_id").orderBy(F.col("joins").desc(), "id")
    bridges = joins.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= size - round(size * people)).select("case_id", "id", F.lit("bridge").alias("part"))
    chosen = heads.select("case_id", "id", F.lit("head").alias("part")).union(bridges)
    linked = both_ways(pairs_).join(chosen.select("case_id", F.col("id").alias("v")), ["case_id", "v"], "left_semi").select("case_id", F.col("u").alias("id")).distinct()
    return chosen.join(linked, ["case_id", "id"], "left_semi")


def type_histogram(nodes: DataFrame) -> DataFrame:
    """Q13."""
    return nodes.groupBy("case_id", "type").agg(F.count(F.lit(1)).alias("n"))


def threads(memory: DataFrame, *, limit: int = 20) -> DataFrame:
    """Q14: the open questions and requests and the conclusions of each case, the newest ``limit`` of each kind."""
    asked = memory.filter("kind = 'conclusion' or status = 'open'")
    k = F.row_number().over(Window.partitionBy("case_id", "kind").orderBy(F.col("updated").desc(), "id"))
    return asked.withColumn("place", k).filter(F.col("place") <= limit)


def overview(counts: DataFrame, findings: DataFrame, memory: DataFrame, *, top: int = 10) -> DataFrame:
    """Q14: a case's counts, its first findings, and how many threads are left open; :func:`threads` lists them, and the document registry its documents."""
    heads = findings.filter(F.col("rank") <= top).groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "headline"))), lambda x: x["headline"]), "; ").alias("headlines"))
    threads = memory.filter("status = 'open'").groupBy("case_id").agg(F.count(F.lit(1)).alias("open_threads"))
    return counts.join(heads, "case_id", "left").join(threads, "case_id", "left").na.fill(0, ["open_threads"])


def report(counts: DataFrame, documents: DataFrame, findings: DataFrame, memory: DataFrame, *, top: int = 10, limit: int = 20) -> DataFrame:
    """Q14: all of a case's overview in one table (case_id, section, place, item, note): counts, every document with its kind, the first findings with their severity, and its threads by kind with their status.

    counts has a column for each thing counted; documents (case_id, doc_id, kind, filename); findings (case_id, rank, headline, severity).
    """
    row = lambda df, section, place, item, note: df.select("case_id", section.alias("section"), place.cast("int").alias("place"), item.alias("item"), note.cast("string").alias("note"))
    names = [c for c in counts.columns if c != "case_id"]
    each = counts.select("case_id", F.posexplode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("n")) for c in names))).alias("i", "x"))
    papers_ = numbered(documents, ["case_id"], [F.col("doc_id").asc()], "place")
    return (
        row(each, F.lit("counts"), F.col("i") + 1, F.col("x.name"), F.col("x.n"))
        .union(row(papers_, F.lit("documents"), F.col("place"), F.concat_ws(" ", "doc_id", "filename"), F.col("kind")))
        .union(row(findings.filter(F.col("rank") <= top), F.lit("findings"), F.col("rank"), F.col("headline"), F.col("severity")))
        .union(row(threads(memory, limit=limit), F.col("kind"), F.col("place"), F.col("text"), F.col("status")))
    )


def influencers(metrics: DataFrame, nodes: DataFrame, metric: str, *, limit: int = 10, node_types: tuple[str, ...] = ("person",)) -> DataFrame:
    """The top nodes of some types by a metric, scores at six digits."""
    of_type = metrics.join(nodes.filter(F.col("type").isin(*node_types)).select("case_id", F.col("id").alias("node"), "label"), ["case_id", "node"])
    order = Window.partitionBy("case_id").orderBy(F.col(metric).desc(), "node")
    return of_type.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).withColumn("score", F.round(metric, 6))


def papers(named: DataFrame, documents: DataFrame) -> DataFrame:
    """Named (case_id, node, doc_id) -> (case_id, node, documents, kinds, in_report): how many documents name a node, of which kinds, and whether one is a report."""
    told = named.distinct().join(documents.select("case_id", "doc_id", "kind"), ["case_id", "doc_id"], "left")
    return told.groupBy("case_id", "node").agg(F.count(F.lit(1)).alias("documents"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.coalesce(F.bool_or(F.col("kind").isin(*REPORT_KINDS)), F.lit(False)).alias("in_report"))


def paper_line(documents: Column, kinds: Column, in_report: Column) -> Column:
    """What is said of a person's documents."""
    records = F.coalesce(F.nullif(F.array_join(kinds, ", "), F.lit("")), F.lit("records"))
    return F.when(F.coalesce(documents, F.lit(0)) == 0, "named in no source document at all").when(~in_report, F.concat(F.lit("named in no report, appears only in "), records, F.lit(" data"))).otherwise(F.concat(F.lit("named in "), plural(documents, "document")))


def explanations(top: DataFrame, pairs_: DataFrame, membership: DataFrame) -> DataFrame:
    """For ranked nodes, direct contacts and the groups among them, as columns and a sentence."""
    around = both_ways(pairs_).join(membership.select("case_id", F.col("node").alias("v"), "community"), ["case_id", "v"], "left")
    told = around.groupBy("case_id", F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("contacts"), F.count_distinct("community").alias("groups"))
    line = F.concat("label", F.lit(" has "), plural(F.col("contacts"), "direct contact"), F.lit(" in "), plural(F.col("groups"), "group"))
    return top.join(told, ["case_id", "node"], "left").na.fill(0, ["contacts", "groups"]).withColumn("why", line)
