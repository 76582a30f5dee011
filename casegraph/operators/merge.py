"""Facts merged into nodes and edges, with bounded provenance.

All merges are aggregates keyed by case and id, so merging what is already there changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegraph.functions import normalize as N

PER_DOCUMENT, IN_TOTAL = 3, 60


def natural_key(df: DataFrame) -> Column:
    """One edge for each src, type, dst and time; undated facts of a type between the same ends are one edge."""
    return F.concat_ws("|", "src", "type", "dst", F.coalesce(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")))


def edge_id(key: Column) -> Column:
    return F.concat(F.lit("e_"), F.substring(F.sha2(key, 256), 1, 16))


def bounded_sources(refs: DataFrame, keys: list[str], *, per_document: int = PER_DOCUMENT, in_total: int = IN_TOTAL) -> DataFrame:
    """Refs (keys, doc_id, start, end, seq) -> (keys, sources, source_count): distinct ones, the first few of each document, so many in all, and the true count.

    Both bounds cut rows before a list is built, so no list grows with the data.
    """
    spot = [*keys, "doc_id", "start", "end"]
    once = refs.groupBy(*spot).agg(F.min("seq").alias("seq"))
    in_doc = Window.partitionBy(*keys, "doc_id").orderBy("seq", "start", "end")
    in_key = Window.partitionBy(*keys).orderBy("seq", "doc_id", "start", "end")
    first = once.withColumn("k", F.row_number().over(in_doc)).filter(F.col("k") <= per_document)
    first = first.withColumn("k", F.row_number().over(in_key)).filter(F.col("k") <= in_total)
    lists = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", F.struct("doc_id", "start", "end").alias("s")))).alias("l"))
    lists = lists.select(*keys, F.transform("l", lambda x: x["s"]).alias("sources"))
    return lists.join(once.groupBy(*keys).agg(F.count(F.lit(1)).alias("source_count")), keys)


def clean_sources(sources: Column) -> Column:
    """U4: distinct sources; null if one lacks a document."""
    return F.when(~F.exists(sources, lambda s: s["doc_id"].isNull()), F.array_distinct(sources))


def last(value: Column) -> Column:
    """An aggregate: the last non-null value by (seq, doc_id), of equals there the greatest, so that no order of arrival or partition matters."""
    return F.max(F.when(value.isNotNull(), F.struct(F.col("seq"), F.col("doc_id"), value.alias("v"))))["v"]


def merge_edges(facts: DataFrame) -> DataFrame:
    """Largest weight and confidence, the last non-null value of the other fields and of each attribute, the set of bases."""
    # By the parts of the natural key: it is long, and one text an edge is enough.
    keyed = facts.withColumn("at", F.date_trunc("second", F.col("ts").cast("timestamp_ntz")))
    edges = keyed.groupBy("case_id", "src", "type", "dst", "at").agg(
        F.min("ts").alias("ts"), F.max("weight").alias("weight"), F.max("confidence").alias("confidence"),
        *(last(F.col(c)).alias(c) for c in LASTS),
        F.array_sort(F.collect_set("basis")).alias("bases"), F.count(F.lit(1)).alias("facts"),
    )
    edges = edges.withColumn("nat_key", natural_key(edges))
    return edges.select("case_id", "nat_key", "src", "dst", "type", "ts", "weight", "confidence", *LASTS, "bases", "facts", edge_id(F.col("nat_key")).alias("id"))


def edge_attrs(facts: DataFrame) -> DataFrame:
    """(case_id, nat_key, attrs) of the edges whose facts carry attributes: the last value of each."""
    keyed = facts.filter("attrs is not null").select("case_id", natural_key(facts).alias("nat_key"), "doc_id", "seq", F.explode("attrs"))
    lasts = keyed.groupBy("case_id", "nat_key", "key").agg(last(F.col("value")).alias("value")).filter("value is not null")
    return lasts.groupBy("case_id", "nat_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attrs"))


def edge_sources(facts: DataFrame) -> DataFrame:
    """(case_id, nat_key, sources, source_count): the documents and rows each edge rests on."""
    return bounded_sources(facts.withColumn("nat_key", natural_key(facts)).select("case_id", "nat_key", "doc_id", "start", "end", "seq"), ["case_id", "nat_key"])


def node_sources(facts: DataFrame) -> DataFrame:
    """(case_id, id, sources, source_count): the documents and rows that name each end of a fact."""
    return bounded_sources(facts.select("case_id", F.explode(F.array("src", "dst")).alias("id"), "doc_id", "start", "end", "seq"), ["case_id", "id"])


def merge_nodes(sightings: DataFrame) -> DataFrame:
    """Sightings (case_id, id, type, label, ts, seq) -> one node an id: best label, other spellings sorted, first and last seen."""
    nodes = sightings.groupBy("case_id", "id", "type").agg(
        N.best_label("type", "label", "seq").alias("label"), F.array_sort(F.collect_set("label")).alias("spellings"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("sightings"),
    )
    return nodes.withColumn("aliases", F.filter("spellings", lambda x: x != F.col("label"))).drop("spellings")


def merge_attrs(values: DataFrame) -> DataFrame:
    """(case_id, id, key, value, doc_id, seq) -> (case_id, id, attrs): the last non-empty value of each key."""
    lasts = values.filter("value is not null and value <> ''").groupBy("case_id", "id", "key").agg(last(F.col("value")).alias("value"))
    return lasts.groupBy("case_id", "id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attrs"))


def sightings(facts: DataFrame) -> DataFrame:
    """The ends of edge facts as node sightings, labelled with what their ids say."""
    ends = facts.select("case_id", F.explode(F.array("src", "dst")).alias("id"), "ts", "seq")
    return ends.select("case_id", "id", N.type_of("id").alias("type"), F.regexp_replace(F.substring_index("id", ":", -1), "_", " ").alias("label"), "ts", "seq")


def rejects(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(case_id, id, reason): sourceless or mistyped nodes and edges, self loops, edges whose ends are no nodes."""
    bad_node = F.when(F.col("source_count") < 1, "sourceless").when(~F.col("type").isin(*N.NODE_TYPES), "unknown type").when(~N.type_of("id").eqNullSafe(F.col("type")), "id and type differ")
    bad_edge = F.when(F.col("source_count") < 1, "sourceless").when(~F.col("type").isin(*N.EDGE_TYPES), "unknown type").when(F.col("src") == F.col("dst"), "self loop")
    told = nodes.select("case_id", "id", bad_node.alias("reason")).union(edges.select("case_id", "id", bad_edge.alias("reason"))).filter("reason is not null")
    known = nodes.select("case_id", F.col("id").alias("end"))
    ends = edges.select("case_id", "id", F.explode(F.array("src", "dst")).alias("end"))
    # Which ends are no nodes is asked once an end, not once an edge.
    missing = ends.select("case_id", "end").distinct().join(known, ["case_id", "end"], "left_anti")
    dangling = ends.join(missing, ["case_id", "end"], "left_semi").select("case_id", "id").distinct()
    return told.union(dangling.select("case_id", "id", F.lit("dangling end").alias("reason")))


def stale(results: DataFrame, revisions: DataFrame) -> DataFrame:
    """Results (case_id, graph_rev, ...) with whether the case has moved on since."""
    return results.join(revisions.select("case_id", F.col("graph_rev").alias("current_rev")), "case_id").withColumn("stale", F.col("graph_rev") != F.col("current_rev"))


def ingest_summary(new_nodes: DataFrame, old_nodes: DataFrame, new_edges: DataFrame, old_edges: DataFrame) -> DataFrame:
    """U8: (case_id, nodes_new, edges_new): keys that were not there before."""
    n = new_nodes.join(old_nodes, ["case_id", "id"], "left_anti").groupBy("case_id").agg(F.count(F.lit(1)).alias("nodes_new"))
    e = new_edges.join(old_edges, ["case_id", "nat_key"], "left_anti").groupBy("case_id").agg(F.count(F.lit(1)).alias("edges_new"))
    return n.join(e, "case_id", "full").na.fill(0)


#: What orders the rows that name a node or an edge: arrival, document, place in the row.
ORDER = ("seq", "doc_id", "place")


def _spots(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, spots, spot_count): the first distinct places of each document and how many there are. ``keys`` end with doc_id."""
    once = found.groupBy(*keys, "start", "end").agg(F.min("seq").alias("seq"))
    first = once.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("seq", "start", "end"))).filter(F.col("k") <= PER_DOCUMENT)
    first = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end"))).alias("spots"))
    return once.groupBy(*keys).agg(F.count(F.lit(1)).alias("spot_count")).join(first, keys)


def _attr_parts(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, attrs): the last value of each key in each document, with what orders it."""
    each = found.filter("attrs is not null").select(*keys, "seq", "place", F.explode("attrs")).filter("value is not null and value <> ''")
    lasts = each.groupBy(*keys, "key").agg(F.max(F.struct("seq", "place", "value")).alias("v"))
    return lasts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("key", "v.seq", "v.place", "v.value"))).alias("attrs"))


def node_parts(sightings: DataFrame) -> DataFrame:
    """Sightings (case_id, src, label, attrs, first_seen, last_seen, prose, doc_id, seq, place, start, end) -> what each document says of each node: a form that documents can be added to or taken from."""
    keys = ["case_id", "id", "doc_id"]
    s = sightings.withColumnRenamed("src", "id")
    noise = F.when(N.type_of("id").isin("phone", "account", "vehicle", "device"), F.length(F.regexp_replace("label", r"[\p{L}\p{N}]", ""))).otherwise(F.lit(0))
    spelled = s.groupBy(*keys, "label").agg(
        F.min(F.struct("seq", "place")).alias("at"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.count_if("prose").alias("mentions")
    )
    best = F.min(F.struct(noise.alias("noise"), (-F.length("label")).alias("short"), F.col("at.seq").alias("seq"), "doc_id", F.col("at.place").alias("place"), "label"))
    parts = spelled.groupBy(*keys).agg(
        best.alias("best"), F.array_sort(F.collect_list("label")).alias("spellings"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("mentions").alias("mentions")
    )
    return parts.join(_spots(s, keys), keys).join(_attr_parts(s, keys), keys, "left")


def edge_parts(facts: DataFrame) -> DataFrame:
    """The same for edges: what each document says of each edge."""
    keys = ["case_id", "nat_key", "doc_id"]
    f = facts.withColumn("nat_key", natural_key(facts))
    at = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col("seq"), F.col("place"), F.col(c).alias("v")))).alias(c)
    parts = f.groupBy(*keys).agg(
        *(F.first(c).alias(c) for c in ("src", "dst", "type", "ts")), F.max("weight").alias("weight"), F.max("confidence").alias("confidence"),
        *(at(c) for c in LASTS), F.array_sort(F.collect_set("basis")).alias("bases"), F.count(F.lit(1)).alias("facts"),
    )
    return parts.join(_spots(f, keys), keys).join(_attr_parts(f, keys), keys, "left")


#: Fields of an edge of which the last value counts.
LASTS = ("amount", "duration_sec", "basis", "offence", "disposition")


def _sources(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sources): the first so many places over all documents."""
    each = parts.select(*keys, "doc_id", F.explode("spots").alias("s"))
    first = each.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("s.seq", "doc_id", "s.start", "s.end"))).filter(F.col("k") <= IN_TOTAL)
    lists = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", F.struct("doc_id", "s.start", "s.end").alias("s")))).alias("l"))
    return lists.select(*keys, F.transform("l", lambda x: x["s"]).alias("sources"))


def _attrs(parts: DataFrame, keys: list[str]) -> DataFrame:
    each = parts.select(*keys, "doc_id", F.explode("attrs").alias("a"))
    lasts = each.groupBy(*keys, F.col("a.key").alias("key")).agg(F.max(F.struct("a.seq", "doc_id", "a.place", "a.value"))["value"].alias("value"))
    return lasts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attrs"))


def nodes_of_parts(parts: DataFrame) -> DataFrame:
    """One node an id: best label, all spellings, the last value of each attribute, widest window, mentions in prose, bounded sources."""
    keys = ["case_id", "id"]
    spelled = parts.select(*keys, F.explode("spellings").alias("x")).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("aliases"))
    nodes = parts.groupBy(*keys).agg(
        F.min("best")["label"].alias("label"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("mentions").alias("prose_mentions"), F.count_if(F.col("mentions") > 0).alias("prose_documents"), F.sum("spot_count").alias("source_count"),
    )
    out = nodes.join(spelled, keys).join(_sources(parts, keys), keys).join(_attrs(parts, keys), keys, "left")
    # A document names itself, which is no spelling of it.
    aliases = F.when(N.type_of("id") == "document", F.array().cast("array<string>")).otherwise(F.col("aliases"))
    return out.select(*keys, N.type_of("id").alias("type"), "label", aliases.alias("aliases"), "attrs", "first_seen", "last_seen", "prose_mentions", "prose_documents", "sources", "source_count")


def edges_of_parts(parts: DataFrame) -> DataFrame:
    """One edge a natural key."""
    keys = ["case_id", "nat_key"]
    last_of = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.seq"), F.col("doc_id"), F.col(f"{c}.place"), F.col(f"{c}.v"))))["v"].alias(c)
    edges = parts.groupBy(*keys).agg(
        *(F.first(c).alias(c) for c in ("src", "dst", "type", "ts")), F.max("weight").alias("weight"), F.max("confidence").alias("confidence"),
        *(last_of(c) for c in LASTS), F.array_sort(F.array_distinct(F.flatten(F.collect_set("bases")))).alias("bases"), F.sum("facts").alias("facts"), F.sum("spot_count").alias("source_count"),
    )
    out = edges.withColumn("id", edge_id(F.col("nat_key")))
    return out.join(_sources(parts, keys), keys).join(_attrs(parts, keys), keys, "left")
