"""Queries over the graph: views, degrees, walks, iterative metrics, lookups, findings. Each entry is (query, SQL or None)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegraph.operators import case, findings, graph, iterative, merge, query
from casegraph.plans import q_records as R
from casegraph.plans.standin import CALLS_SQL, EDGES_SQL, PAIRS_SQL, TRANSFERS_SQL, table
from casegraph.sources.shared import kept

NTZ = "timestamp_ntz"
CALLS = f"WITH {CALLS_SQL}, {EDGES_SQL.format(facts='call_facts')}, {PAIRS_SQL}"
TRANSFERS = f"WITH {TRANSFERS_SQL}, {EDGES_SQL.format(facts='transfer_facts')}, {PAIRS_SQL}"


def weighted(edges: DataFrame) -> DataFrame:
    return edges.withColumn("weight", F.lit(1.0))


def call_pairs(spark, d):
    return graph.pairs(weighted(R.call_edges(spark, d)))


def transfer_pairs(spark, d):
    return graph.pairs(weighted(R.transfer_edges(spark, d)))


def g2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return call_pairs(spark, d).select("case_id", "a", "b", "weight", F.round("distance", 9).alias("distance"), F.array_join("types", ",").alias("types"), "n")


G2_SQL = f"""{CALLS}, t AS (SELECT case_id, least(src, dst) AS a, greatest(src, dst) AS b, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM edges GROUP BY 1, 2, 3)
SELECT case_id, a, b, weight, round(1 / weight, 9) AS distance, types, n FROM pairs JOIN t USING (case_id, a, b)"""


def g3_g4_projection(spark: SparkSession, d: str) -> DataFrame:
    e = kept(weighted(R.call_edges(spark, d)), "edges")
    out = graph.project(graph.pairs(e), graph.owners(e, fold_devices=True))
    return out.select("case_id", "a", "b", "weight", "n")


OWNERS_SQL = r"""
held AS (SELECT case_id, dst AS identifier, src AS owner FROM (SELECT *, row_number() OVER (PARTITION BY case_id, dst ORDER BY confidence DESC, nat_key) AS k FROM edges WHERE type = 'OWNS' AND src LIKE 'person:%') WHERE k = 1),
devices AS (SELECT case_id, identifier, owner FROM (SELECT e.case_id, e.src AS identifier, h.owner, row_number() OVER (PARTITION BY e.case_id, e.src ORDER BY confidence DESC, nat_key) AS k
  FROM edges e JOIN held h ON e.case_id = h.case_id AND e.dst = h.identifier WHERE e.type = 'REGISTERED_TO' AND e.src LIKE 'device:%') WHERE k = 1),
owner AS (SELECT * FROM held UNION ALL SELECT * FROM devices)"""
G4_SQL = f"""{CALLS}, {OWNERS_SQL},
f AS (SELECT p.case_id, coalesce(oa.owner, a) AS x, coalesce(ob.owner, b) AS y, weight, n FROM pairs p LEFT JOIN owner oa ON p.case_id = oa.case_id AND p.a = oa.identifier LEFT JOIN owner ob ON p.case_id = ob.case_id AND p.b = ob.identifier)
SELECT case_id, least(x, y) AS a, greatest(x, y) AS b, sum(weight) AS weight, CAST(sum(n) AS BIGINT) AS n FROM f WHERE x <> y GROUP BY 1, 2, 3"""


def g5_g6_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(transfer_pairs(spark, d))


G5_SQL = f"{TRANSFERS} SELECT case_id, u AS node, sum(weight) AS weighted, count(*) AS neighbours FROM both_ways GROUP BY 1, 2"


def q4_hops(spark: SparkSession, d: str) -> DataFrame:
    p = kept(call_pairs(spark, d), "pairs")
    seeds = p.filter("a like 'device:%'").groupBy("case_id").agg(F.min("a").alias("seed"))
    return graph.hops(p, seeds, 2)


Q4_SQL = f"""{CALLS}, s AS (SELECT case_id, min(a) AS seed FROM pairs WHERE a LIKE 'device:%' GROUP BY 1),
h0 AS (SELECT case_id, seed, seed AS node, 0 AS hop FROM s),
h1 AS (SELECT DISTINCT h.case_id, seed, v AS node, 1 AS hop FROM h0 h JOIN both_ways b ON h.case_id = b.case_id AND h.node = b.u),
h2 AS (SELECT DISTINCT h.case_id, seed, v AS node, 2 AS hop FROM h1 h JOIN both_ways b ON h.case_id = b.case_id AND h.node = b.u)
SELECT case_id, seed, node, min(hop) AS hop FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1, 2, 3"""


def q4_edges(spark: SparkSession, d: str) -> DataFrame:
    """The call edges among what each case's first handset reaches in two steps."""
    e = kept(weighted(R.call_edges(spark, d)), "edges")
    p = kept(graph.pairs(e), "pairs")
    reached = kept(graph.hops(p, p.filter("a like 'device:%'").groupBy("case_id").agg(F.min("a").alias("seed")), 2), "reached")
    return graph.neighbourhood_edges(e, reached)


Q4_EDGES_SQL = f"{Q4_SQL.rsplit('SELECT case_id, seed, node, min(hop)', 1)[0].rstrip()}, r AS (SELECT DISTINCT case_id, seed, node FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)) SELECT DISTINCT e.case_id, x.seed, 'e_' || left(sha256(nat_key), 16) AS id FROM edges e JOIN r x ON e.case_id = x.case_id AND e.src = x.node JOIN r y ON e.case_id = y.case_id AND e.dst = y.node AND x.seed = y.seed"


def order_pairs(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    """The customer-supplier-nation graph of the orders."""
    o = table(spark, d, "orders").filter(where)
    j = o.join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    node = lambda t, k: F.concat(F.lit(f"{t}:"), k)
    pairs_ = F.explode(F.array(F.struct(node("customer", "o_custkey").alias("a"), node("supplier", "l_suppkey").alias("b")), F.struct(node("customer", "o_custkey").alias("a"), node("nation", "c_nationkey").alias("b"))))
    return j.select(pairs_.alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).cast("double").alias("weight")).select(F.lit("case_1").alias("case_id"), "a", "b", "weight", (1 / F.col("weight")).alias("distance"))


ORDERS_SQL = r"""
lines AS (SELECT 'customer:' || o_custkey AS c, 'supplier:' || l_suppkey AS s, 'nation:' || c_nationkey AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey),
pairs AS (SELECT c AS a, s AS b, CAST(count(*) AS DOUBLE) AS weight FROM lines GROUP BY 1, 2 UNION ALL SELECT c, n, CAST(count(*) AS DOUBLE) FROM lines GROUP BY 1, 2),
both_ways AS (SELECT a AS u, b AS v, weight FROM pairs UNION ALL SELECT b, a, weight FROM pairs)"""


def q5_paths(spark: SparkSession, d: str) -> DataFrame:
    p = kept(order_pairs(spark, d), "pairs")
    asked = p.groupBy("case_id").agg(F.min("a").alias("a"), F.max("a").alias("b"))
    return graph.simple_paths(p, asked, max_hops=3, limit=5).select("a", "b", F.array_join("path", ">").alias("path"), "hops", "weight", "rank")


Q5_SQL = f"""WITH RECURSIVE {ORDERS_SQL}, q AS (SELECT min(a) AS a, max(a) AS b FROM pairs),
w(a, b, node, path, hops, weight) AS (SELECT a, b, a, [a], 0, CAST(0 AS DOUBLE) FROM q
  UNION ALL SELECT w.a, w.b, v, list_append(path, v), hops + 1, w.weight + e.weight FROM w JOIN both_ways e ON w.node = e.u WHERE hops < 3 AND node <> b AND NOT list_contains(path, v)),
r AS (SELECT *, row_number() OVER (ORDER BY hops, weight DESC, array_to_string(path, '>')) AS rank FROM w WHERE node = b)
SELECT a, b, array_to_string(path, '>') AS path, CAST(hops AS INT) AS hops, weight, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5"""


def q6_path_edges(spark: SparkSession, d: str) -> DataFrame:
    """Shortest paths from a person to a location over the merged call edges, with the edges along them."""
    e = kept(weighted(R.call_edges(spark, d)), "edges")
    asked = e.filter("type = 'OWNS'").groupBy("case_id").agg(F.min("src").alias("a")).withColumn("b", F.lit("location:tower_1"))
    paths = kept(graph.simple_paths(graph.pairs(e), asked, max_hops=2, limit=1), "paths")
    return graph.path_edges(paths, e).select("case_id", "a", "b", F.size("edge_ids").cast("long").alias("n"), F.md5(F.array_join("edge_ids", ",")).alias("digest"))


Q6_SQL = f"""{CALLS}, o AS (SELECT case_id, min(src) AS a FROM edges WHERE type = 'OWNS' GROUP BY 1), p AS (SELECT o.case_id, o.a, e.dst AS phone FROM o JOIN edges e ON o.case_id = e.case_id AND o.a = e.src AND e.type = 'OWNS'),
x AS (SELECT p.case_id, p.a, 'e_' || left(sha256(nat_key), 16) AS id FROM p JOIN edges e ON p.case_id = e.case_id AND ((e.type = 'OWNS' AND e.src = p.a) OR (e.type = 'LOCATED_AT' AND e.src = p.phone AND e.dst = 'location:tower_1')))
SELECT case_id, a, 'location:tower_1' AS b, count(*) AS n, md5(string_agg(id, ',' ORDER BY id)) AS digest FROM x GROUP BY 1, 2 HAVING count(*) > 1"""


def g7_pagerank(spark: SparkSession, d: str) -> DataFrame:
    return iterative.pagerank(order_pairs(spark, d), iterations=6, tolerance=0).select("node", F.round("rank", 9).alias("rank"))


def g7_settled(spark: SparkSession, d: str) -> DataFrame:
    """With the tolerance and rounds of the operator: how many rounds that takes depends on the data, so no SQL says the same."""
    return iterative.pagerank(order_pairs(spark, d)).select("case_id", "node", F.round("rank", 9).alias("rank"))


def _pagerank_sql(rounds: int) -> str:
    sql = f"WITH {ORDERS_SQL}, t AS (SELECT u, sum(weight) AS total FROM both_ways GROUP BY 1), sh AS (SELECT b.u, b.v, b.weight / t.total AS share FROM both_ways b JOIN t ON b.u = t.u), n AS (SELECT count(*) AS n FROM t), r0 AS (SELECT u AS node, 1.0::DOUBLE / n AS rank FROM t, n)"
    for i in range(rounds):
        sql += f", r{i + 1} AS (SELECT v AS node, 0.15 / any_value(n) + 0.85 * sum(rank * share) AS rank FROM sh JOIN r{i} ON u = node, n GROUP BY 1)"
    return f"{sql} SELECT node, round(CAST(rank AS DOUBLE), 9) AS rank FROM r{rounds}"


def g8_g9_betweenness(spark: SparkSession, d: str) -> DataFrame:
    return iterative.betweenness(order_pairs(spark, d)).select("case_id", "node", F.round("betweenness", 9).alias("betweenness"), "estimated")


def g8_chains(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders in a row, a case for each customer: exact betweenness, and PageRank's sum, of very many small cases."""
    o = table(spark, d, "orders")
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    links = o.select(F.concat(F.lit("c"), "o_custkey").alias("case_id"), F.col("o_orderkey").alias("x"), after.alias("y"), (F.col("o_orderkey") % 5 + 1).cast("double").alias("weight")).filter("y is not null")
    p = kept(links.select("case_id", F.concat(F.lit("o"), "x").alias("a"), F.concat(F.lit("o"), "y").alias("b"), "weight", (1 / F.col("weight")).alias("distance")), "chains")
    out = iterative.betweenness(p).select("case_id", "node", F.round("betweenness", 9).alias("betweenness"), "estimated")
    sums = iterative.pagerank(p).groupBy("case_id").agg(F.round(F.sum("rank"), 6).alias("ranks"))
    return out.join(sums, "case_id")


G8_CHAINS_SQL = """WITH o AS (SELECT 'c' || o_custkey AS case_id, 'o' || o_orderkey AS node, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS DOUBLE) AS i, CAST(count(*) OVER (PARTITION BY o_custkey) AS DOUBLE) AS n FROM orders)
SELECT case_id, node, round(CASE WHEN n > 2 THEN 2 * i * (n - 1 - i) / ((n - 1) * (n - 2)) ELSE 0 END, 9) AS betweenness, false AS estimated, 1.0::DOUBLE AS ranks FROM o WHERE n > 1"""


def g10_cliques(spark: SparkSession, d: str) -> DataFrame:
    """The lines of each order, all linked with each other, a case for each customer: groups that never touch are the communities."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("case_id"), "l_orderkey", "l_linenumber")
    other = li.select("l_orderkey", F.col("l_linenumber").alias("more"))
    node = lambda c: F.concat_ws("-", F.lit("line"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0"), c)
    p = li.join(other, "l_orderkey").filter("l_linenumber < more").select("case_id", node("l_linenumber").alias("a"), node("more").alias("b"), F.lit(1.0).alias("weight")).distinct()
    return iterative.communities(p)


G10_CLIQUES_SQL = """WITH n AS (SELECT DISTINCT 'c' || o_custkey AS case_id, l_orderkey, 'line-' || lpad(l_orderkey::VARCHAR, 8, '0') || '-' || l_linenumber AS node FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT case_id, l_orderkey, count(*) AS size, min(node) AS least FROM n GROUP BY 1, 2 HAVING count(*) > 1),
r AS (SELECT *, 'c' || row_number() OVER (PARTITION BY case_id ORDER BY size DESC, least) AS community FROM g)
SELECT n.case_id, node, community FROM n JOIN r ON n.case_id = r.case_id AND n.l_orderkey = r.l_orderkey"""


def g10_communities(spark: SparkSession, d: str) -> DataFrame:
    return iterative.communities(order_pairs(spark, d))


def nodes_of(edges: DataFrame) -> DataFrame:
    return merge.merge_nodes(merge.sightings(edges.withColumn("seq", F.lit(0))))


NODES_SQL = "nodes AS (SELECT case_id, id, split_part(id, ':', 1) AS type, replace(split_part(id, ':', 2), '_', ' ') AS label, count(*) AS sightings FROM (SELECT case_id, unnest([src, dst]) AS id FROM edges) GROUP BY 1, 2)"


def q1_q13_types(spark: SparkSession, d: str) -> DataFrame:
    return query.type_histogram(nodes_of(R.call_edges(spark, d)))


Q13_SQL = f"{CALLS}, {NODES_SQL} SELECT case_id, type, count(*) AS n FROM nodes GROUP BY 1, 2"


def q2_search(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.lit("device").alias("type"), F.concat_ws(" ", "p_brand", "p_type").alias("label"))
    return query.search(p, " Brand#1", limit=25).select("id", "label", "match")


Q2_SQL = """SELECT id, label, 1 AS match FROM (SELECT 'part:' || p_partkey AS id, p_brand || ' ' || p_type AS label FROM part) WHERE lower(label) LIKE '%brand#1%' ORDER BY length(label), label, id LIMIT 25"""


def q3_edges(spark: SparkSession, d: str) -> DataFrame:
    e = query.edges_where(R.call_edges(spark, d), types=("CALLED", "LOCATED_AT"), start="2024-01-10 00:00:00", end="2024-01-12 00:00:00")
    return e.select("case_id", "id", "src", "dst", F.col("ts").cast(NTZ).alias("ts"))


Q3_SQL = f"{CALLS} SELECT case_id, 'e_' || left(sha256(nat_key), 16) AS id, src, dst, ts FROM edges WHERE type IN ('CALLED', 'LOCATED_AT') AND ts BETWEEN '2024-01-10' AND '2024-01-12'"


def q7_timeline(spark: SparkSession, d: str) -> DataFrame:
    e = kept(R.call_edges(spark, d), "edges")
    return query.timeline(e, nodes_of(e)).select("case_id", "id", F.col("ts").cast(NTZ).alias("ts"), "line")


Q7_SQL = f"{CALLS} SELECT case_id, 'e_' || left(sha256(nat_key), 16) AS id, ts, replace(split_part(src, ':', 2), '_', ' ') || ' ' || type || ' ' || replace(split_part(dst, ':', 2), '_', ' ') AS line FROM edges WHERE ts IS NOT NULL"


def q8_shown(spark: SparkSession, d: str) -> DataFrame:
    """Towers stand in for documents."""
    e = kept(R.call_edges(spark, d), "edges")
    n = nodes_of(e).withColumn("type", F.when(F.col("type") == "location", "document").otherwise(F.col("type")))
    shown, left = query.without_documents(n, e)
    return query.case_counts(nodes=shown, edges=left)


Q8_SQL = f"{CALLS}, {NODES_SQL}, n AS (SELECT case_id, count(*) AS nodes FROM nodes WHERE type <> 'location' GROUP BY 1), e AS (SELECT case_id, count(*) AS edges FROM edges WHERE type <> 'LOCATED_AT' GROUP BY 1) SELECT * FROM n JOIN e USING (case_id)"


def q9_profiles(spark: SparkSession, d: str) -> DataFrame:
    return query.profiles(R.call_edges(spark, d))


Q9_SQL = f"{CALLS} SELECT case_id, node, count(*) AS edges, count(DISTINCT other) AS neighbours, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM (SELECT case_id, src AS node, dst AS other, type FROM edges UNION ALL SELECT case_id, dst, src, type FROM edges) GROUP BY 1, 2"


def q11_ranking(spark: SparkSession, d: str) -> DataFrame:
    e = kept(R.call_edges(spark, d), "edges")
    return query.people_first(nodes_of(e), e).select("case_id", "id", "degree", "rank")


Q11_SQL = f"{CALLS}, {NODES_SQL} SELECT case_id, id, sightings AS degree, CAST(row_number() OVER (PARTITION BY case_id ORDER BY (type = 'person') DESC, sightings DESC, id) AS INT) AS rank FROM nodes"


def q12_opening(spark: SparkSession, d: str) -> DataFrame:
    """Customers are people, suppliers what joins them."""
    e = kept(weighted(R.transfer_edges(spark, d)).filter("type = 'TRANSFERRED_TO'"), "edges")
    n = nodes_of(e).withColumn("type", F.when(F.col("id").like("account:c%"), "person").otherwise("account"))
    return query.opening(n, graph.pairs(e))


Q12_SQL = f"""WITH {TRANSFERS_SQL}, edges AS (SELECT DISTINCT case_id, src, dst FROM tr),
h AS (SELECT case_id, src AS id FROM (SELECT case_id, src, row_number() OVER (PARTITION BY case_id ORDER BY count(*) DESC, src) AS k FROM edges GROUP BY 1, 2) WHERE k <= 14),
j AS (SELECT e.case_id, dst AS id, count(*) AS joins FROM edges e JOIN h ON e.case_id = h.case_id AND e.src = h.id GROUP BY 1, 2 HAVING count(*) >= 2),
b AS (SELECT case_id, id FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY joins DESC, id) AS k FROM j) WHERE k <= 12)
SELECT case_id, id, 'bridge' AS part FROM b UNION ALL SELECT DISTINCT h.case_id, h.id, 'head' FROM h JOIN edges e ON h.case_id = e.case_id AND h.id = e.src JOIN b ON b.case_id = e.case_id AND b.id = e.dst"""


def g12_g13_influencers(spark: SparkSession, d: str) -> DataFrame:
    """The suppliers by weighted degree, with contacts and the nations among their customers as groups."""
    p = kept(order_pairs(spark, d), "pairs")
    member = p.filter("b like 'nation:%'").groupBy("case_id", F.col("a").alias("node")).agg(F.min("b").alias("community"))
    deg = graph.degrees(p.filter("b like 'supplier:%'"))
    n = deg.select("case_id", F.col("node").alias("id"), F.substring_index("node", ":", 1).alias("type"), F.upper("node").alias("label"))
    top = query.influencers(deg, n, "weighted", node_types=("supplier",))
    return query.explanations(top, p, member).select("node", "score", "rank", "contacts", "groups", "why")


G12_SQL = f"""WITH {ORDERS_SQL}, m AS (SELECT a AS node, min(b) AS community FROM pairs WHERE b LIKE 'nation:%' GROUP BY 1),
t AS (SELECT b AS node, sum(weight) AS score, count(*) AS contacts, count(DISTINCT community) AS groups FROM pairs JOIN m ON a = node WHERE b LIKE 'supplier:%' GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, node) AS rank FROM t)
SELECT node, score, CAST(rank AS INT) AS rank, contacts, groups, upper(node) || ' has ' || contacts || ' direct contact' || CASE WHEN contacts = 1 THEN '' ELSE 's' END || ' in ' || groups || ' group' || CASE WHEN groups = 1 THEN '' ELSE 's' END AS why FROM r WHERE rank <= 10"""


def order_people(spark: SparkSession, d: str):
    """The customers as people, with a stand-in betweenness (weighted degree), nations as communities, and reports on every third customer."""
    p = kept(order_pairs(spark, d).withColumn("a", F.replace("a", F.lit("customer"), F.lit("person"))), "pairs")
    deg = kept(graph.degrees(p), "degrees")
    metrics = deg.select("case_id", "node", F.col("weighted").alias("betweenness"))
    member = p.filter("b like 'nation:%'").select("case_id", F.col("a").alias("node"), F.col("b").alias("community"))
    named = deg.filter("node like 'person:%'").select("case_id", "node", F.concat(F.lit("doc:"), F.substring_index("node", ":", -1).cast("int") % 3).alias("doc_id"))
    docs = named.select("case_id", "doc_id").distinct().withColumn("kind", F.when(F.col("doc_id") == "doc:0", "fir").otherwise("cdr"))
    return p, deg, metrics, member, named, findings.reported(named, docs)


def f_people(spark: SparkSession, d: str) -> DataFrame:
    p, deg, metrics, member, named, reported = order_people(spark, d)
    out = findings.hidden_brokers(metrics, deg, reported, most_contacts=60).union(findings.undocumented_people(named, deg, reported))
    return out.select("kind", "severity", F.array_join("node_ids", ",").alias("nodes"))


F_PEOPLE_SQL = f"""WITH {ORDERS_SQL}, dg AS (SELECT replace(u, 'customer', 'person') AS node, sum(weight) AS w, count(*) AS nb FROM both_ways WHERE u LIKE 'customer:%' GROUP BY 1),
c AS (SELECT min(w) AS cut FROM (SELECT w FROM dg ORDER BY w DESC, node LIMIT 5)), free AS (SELECT * FROM dg WHERE CAST(split_part(node, ':', 2) AS INT) % 3 <> 0)
(SELECT 'hidden_broker' AS kind, 'high' AS severity, node AS nodes FROM free, c WHERE w >= cut AND nb <= 60 ORDER BY w DESC, node LIMIT 3)
UNION ALL (SELECT 'undocumented_person', 'medium', node FROM free WHERE nb >= 2 ORDER BY nb DESC, node LIMIT 5)"""


def f3_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers in 400 groups by their keys: groups that one or two orders join."""
    p = kept(order_pairs(spark, d).filter("b like 'supplier:%'"), "pairs")
    ends = p.select("case_id", F.explode(F.array("a", "b")).alias("node")).distinct()
    out = findings.single_contacts(p, ends.withColumn("community", F.concat(F.lit("c"), F.substring_index("node", ":", -1).cast("int") % 400)))
    return out.select("kind", "headline", F.array_join("node_ids", ",").alias("nodes"))


F3_SQL = f"""WITH {ORDERS_SQL}, g AS (SELECT a, b, 'c' || (CAST(split_part(a, ':', 2) AS INT) % 400) AS ca, 'c' || (CAST(split_part(b, ':', 2) AS INT) % 400) AS cb FROM pairs WHERE b LIKE 'supplier:%'),
j AS (SELECT least(ca, cb) AS x, greatest(ca, cb) AS y, count(*) AS links, min(struct_pack(a := a, b := b)) AS one, max(struct_pack(a := a, b := b)) AS two FROM g WHERE ca <> cb GROUP BY 1, 2)
SELECT 'single_point_of_contact' AS kind, 'Groups ' || x || ' and ' || y || ' meet in ' || links || ' places' AS headline, array_to_string(list_sort(list_distinct([one.a, one.b, two.a, two.b])), ',') AS nodes FROM j WHERE links <= 2 ORDER BY links, x, y LIMIT 2"""


def f4_f5_priors(spark: SparkSession, d: str) -> DataFrame:
    from casegraph.operators import edges

    facts = kept(edges.history(R.history_raw(spark, d)), "facts")
    member = facts.select("case_id", F.col("src").alias("node")).distinct().withColumn("community", F.concat(F.lit("c"), F.length("node") % 2))
    out = findings.repeat_offenders(facts).union(findings.prior_associations(merge.merge_edges(facts), member))
    return out.select("case_id", "kind", "severity", "headline", F.array_join("node_ids", ",").alias("nodes"), F.col("ts").cast(NTZ).alias("ts"))


F4_SQL = f"""WITH {R.HISTORY_SQL},
p AS (SELECT case_id, src, count(DISTINCT dst) AS cases, count(DISTINCT dst) FILTER (disposition = 'convicted') AS conv, max(ts) AS last FROM history_facts WHERE type = 'MENTIONED_IN' GROUP BY 1, 2 HAVING count(DISTINCT dst) >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY conv DESC, cases DESC, src) AS k FROM p),
n AS (SELECT DISTINCT case_id, src FROM history_facts),
a AS (SELECT DISTINCT case_id, src, dst FROM history_facts WHERE type = 'CO_OCCURS'),
m AS (SELECT a.*, CASE WHEN ns.src IS NOT NULL AND nd.src IS NOT NULL AND length(a.src) % 2 <> length(a.dst) % 2 THEN 'high' ELSE 'low' END AS severity FROM a LEFT JOIN n ns ON a.case_id = ns.case_id AND a.src = ns.src LEFT JOIN n nd ON a.case_id = nd.case_id AND a.dst = nd.src),
b AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY severity, src, dst) AS k FROM m)
SELECT case_id, 'repeat_offender' AS kind, CASE WHEN conv > 0 THEN 'high' ELSE 'medium' END AS severity, src || ' is named in ' || cases || ' prior cases, ' || conv || ' of them convictions' AS headline, src AS nodes, last AS ts FROM r WHERE k <= 5
UNION ALL SELECT case_id, 'prior_association', severity, src || ' and ' || dst || ' were accused together before', src || ',' || dst, NULL FROM b WHERE k <= 5"""


def f6_f7_ranked(spark: SparkSession, d: str) -> DataFrame:
    from casegraph.operators import anomalies

    found = anomalies.ranked(anomalies.anomalies(kept(R.call_edges(spark, d), "edges")))
    return findings.ranked(findings.promoted(found)).select("case_id", "id", "kind", "severity", "headline", F.array_join("node_ids", ",").alias("nodes"))


F6_SQL = f"""{R.CALL_EDGES_SQL}, {R.SPIKES_SQL}, {R.SWAPS_SQL}, {R.ONE_WAY_SQL}, {R.LARGE_SQL}, {R.SILENT_SQL},
found AS (SELECT * FROM spikes UNION ALL SELECT * FROM swaps UNION ALL SELECT * FROM one_way UNION ALL SELECT * FROM large UNION ALL SELECT * FROM silent),
k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, kind, nodes, ts) AS r FROM found),
t AS (SELECT *, CASE kind WHEN 'handset_swap' THEN 'high' WHEN 'large_transfer' THEN 'high' ELSE 'medium' END AS severity,
  CASE kind WHEN 'volume_spike' THEN 'Contact rate far above its own average' WHEN 'handset_swap' THEN 'One handset used with several numbers' WHEN 'one_way_account' THEN 'Money moves through this account in one direction only'
    WHEN 'large_transfer' THEN 'Transfer far above the case median' ELSE 'Contact stopped after regular activity' END AS headline FROM k WHERE r <= 12)
SELECT case_id, 'f' || row_number() OVER (PARTITION BY case_id ORDER BY severity, kind, headline, nodes, ts) AS id, kind, severity, headline, nodes FROM t"""


def f8_edges(spark: SparkSession, d: str) -> DataFrame:
    e = kept(weighted(R.call_edges(spark, d)), "edges")
    out = findings.edges_around(graph.degrees(graph.pairs(e)), e)
    return out.select("case_id", "node", F.size("edge_ids").cast("long").alias("n"), F.md5(F.array_join("edge_ids", ",")).alias("digest"))


F8_SQL = f"""{CALLS}, x AS (SELECT case_id, unnest([src, dst]) AS node, 'e_' || left(sha256(nat_key), 16) AS id FROM edges), r AS (SELECT *, row_number() OVER (PARTITION BY case_id, node ORDER BY id) AS k FROM x)
SELECT case_id, node, count(*) AS n, md5(string_agg(id, ',' ORDER BY id)) AS digest FROM r WHERE k <= 40 GROUP BY 1, 2"""

def g4_absorbed(spark: SparkSession, d: str) -> DataFrame:
    out = graph.absorbed(graph.owners(kept(R.call_edges(spark, d), "edges"), fold_devices=True))
    return out.select("case_id", "node", F.array_join("absorbed", ",").alias("absorbed"), "n")


G4_ABSORBED_SQL = f"""{CALLS}, {OWNERS_SQL} SELECT case_id, owner AS node, string_agg(identifier, ',' ORDER BY identifier) AS absorbed, count(*) AS n FROM owner GROUP BY 1, 2"""


def order_papers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers named in documents, one for each priority and status of their orders; the kind follows from the priority."""
    o = table(spark, d, "orders").select(F.lit("case_1").alias("case_id"), F.concat(F.lit("person:"), "o_custkey").alias("node"), F.concat_ws("-", "o_orderpriority", "o_orderstatus").alias("doc_id"), F.col("o_orderkey").alias("seq"))
    kind = F.when(F.col("doc_id").startswith("1"), "fir").when(F.col("doc_id").startswith("2"), "cdr").otherwise("financial")
    return o, o.select("case_id", "doc_id").distinct().withColumn("kind", kind)


PAPERS_SQL = "op AS (SELECT 'case_1' AS case_id, 'person:' || o_custkey AS node, o_orderpriority || '-' || o_orderstatus AS doc_id, o_orderkey AS seq FROM orders), od AS (SELECT *, CASE WHEN doc_id LIKE '1%' THEN 'fir' WHEN doc_id LIKE '2%' THEN 'cdr' ELSE 'financial' END AS kind FROM op)"


def g13_papers(spark: SparkSession, d: str) -> DataFrame:
    named, documents = order_papers(spark, d)
    out = query.papers(named.select("case_id", "node", "doc_id"), documents)
    return out.select("node", "documents", F.array_join("kinds", ",").alias("kinds"), "in_report", query.paper_line(F.col("documents"), F.col("kinds"), F.col("in_report")).alias("line"))


G13_SQL = f"""WITH {PAPERS_SQL}, t AS (SELECT node, count(DISTINCT doc_id) AS documents, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, bool_or(kind = 'fir') AS in_report FROM od GROUP BY 1)
SELECT *, CASE WHEN in_report THEN 'named in ' || documents || ' document' || CASE WHEN documents = 1 THEN '' ELSE 's' END ELSE 'named in no report, appears only in ' || replace(kinds, ',', ', ') || ' data' END AS line FROM t"""


def q9_documents(spark: SparkSession, d: str) -> DataFrame:
    named, documents = order_papers(spark, d)
    refs = named.select("case_id", F.col("node").alias("id"), "doc_id", F.lit(0).alias("start"), F.lit(9).alias("end"), "seq")
    return query.profile_documents(merge.bounded_sources(refs, ["case_id", "id"]), documents).select("id", "doc_id", "kind", "place")


Q9_DOCUMENTS_SQL = f"WITH {PAPERS_SQL} SELECT node AS id, doc_id, any_value(kind) AS kind, CAST(row_number() OVER (PARTITION BY node ORDER BY min(seq), doc_id) AS INT) AS place FROM od GROUP BY 1, 2"


def g14_recompute(spark: SparkSession, d: str) -> DataFrame:
    """Every result of the call records, row by row: (case_id, graph_rev, result, item, value)."""
    e = kept(weighted(R.call_edges(spark, d)), "edges")
    named = e.filter("src like 'person:%'").select("case_id", F.col("src").alias("node"), F.concat(F.lit("doc:"), F.length("src") % 3).alias("doc_id")).distinct()
    documents = named.select("case_id", "doc_id").distinct().withColumn("kind", F.when(F.col("doc_id") == "doc:0", "fir").otherwise("cdr"))
    out = case.recompute(e, named, documents, e.groupBy("case_id").agg(F.count(F.lit(1)).alias("graph_rev")))
    told = {
        "metrics": ("node", F.format_string("%.6f %.6f %.3f %d", "betweenness", "rank", "weighted", "neighbours")), "communities": ("node", F.col("community")),
        "anomalies": (F.concat_ws(" ", "kind", F.array_join("node_ids", ","), "ts"), F.format_string("%d %.3f", "rank", "score")), "findings": (F.col("id"), F.concat_ws(": ", "severity", "headline")),
    }
    rows = [out[name].select("case_id", "graph_rev", F.lit(name).alias("result"), (F.col(item) if isinstance(item, str) else item).alias("item"), value.alias("value")) for name, (item, value) in told.items()]
    return reduce(DataFrame.union, rows)


QUERIES = {
    "g2_pairs": (g2_pairs, G2_SQL),
    "g3_g4_projection": (g3_g4_projection, G4_SQL),
    "g5_g6_degrees": (g5_g6_degrees, G5_SQL),
    "g7_pagerank": (g7_pagerank, _pagerank_sql(6)),
    "g14_recompute": (g14_recompute, None),
    "g4_absorbed": (g4_absorbed, G4_ABSORBED_SQL),
    "g13_papers": (g13_papers, G13_SQL),
    "q9_profile_documents": (q9_documents, Q9_DOCUMENTS_SQL),
    "g7_pagerank_settled": (g7_settled, None),
    "g8_g9_betweenness": (g8_g9_betweenness, None),
    "g8_exact_chains": (g8_chains, G8_CHAINS_SQL),
    "g10_cliques": (g10_cliques, G10_CLIQUES_SQL),
    "g10_communities": (g10_communities, None),
    "g12_g13_influencers": (g12_g13_influencers, G12_SQL),
    "q1_q13_types": (q1_q13_types, Q13_SQL),
    "q2_search": (q2_search, Q2_SQL),
    "q3_edges": (q3_edges, Q3_SQL),
    "q4_hops": (q4_hops, Q4_SQL),
    "q4_neighbourhood_edges": (q4_edges, Q4_EDGES_SQL),
    "q5_paths": (q5_paths, Q5_SQL),
    "q6_path_edges": (q6_path_edges, Q6_SQL),
    "q7_timeline": (q7_timeline, Q7_SQL),
    "q8_q10_shown": (q8_shown, Q8_SQL),
    "q9_profiles": (q9_profiles, Q9_SQL),
    "q11_ranking": (q11_ranking, Q11_SQL),
    "q12_opening": (q12_opening, Q12_SQL),
    "f1_f2_people": (f_people, F_PEOPLE_SQL),
    "f3_single_contacts": (f3_contacts, F3_SQL),
    "f4_f5_priors": (f4_f5_priors, F4_SQL),
    "f6_f7_ranked": (f6_f7_ranked, F6_SQL),
    "f8_edges_around": (f8_edges, F8_SQL),
}
