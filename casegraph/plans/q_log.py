"""Queries over audit chains, memory, conversations and answers. Each entry is (query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.operators import caselog, query
from casegraph.operators.ranks import numbered
from casegraph.plans.standin import table
from casegraph.sources.shared import kept

NTZ = "timestamp_ntz"


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as audit entries."""
    o = table(spark, d, "orders")
    return o.select(
        F.concat(F.lit("c"), "o_custkey").alias("case_id"), F.col("o_orderkey").alias("position"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ts"), F.col("o_orderpriority").alias("actor"), F.lit("ingest").alias("action"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("doc:"), "o_orderkey")).alias("ref"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("payload_sha256"),
    )


def chain(spark: SparkSession, d: str) -> DataFrame:
    """The first half of the entries, and the rest appended to its tails."""
    entries = _entries(spark, d)
    none = spark.createDataFrame([], "case_id string, seq long, hash string")
    old = kept(caselog.append(entries.filter("ts < '1998-01-01'"), none), "chain")
    tails = caselog.latest(old, 1).select("case_id", "seq", "hash")
    return old.union(caselog.append(entries.filter("ts >= '1998-01-01'"), tails))


def l1_append(spark: SparkSession, d: str) -> DataFrame:
    return chain(spark, d).select("case_id", "seq", "ts", "ref", "prev_hash", "hash")


L1_SQL = r"""WITH RECURSIVE e AS (SELECT 'c' || o_custkey AS case_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate >= '1998-01-01', o_orderkey) AS seq, strftime(o_orderdate, '%Y-%m-%d') AS ts, o_orderpriority AS actor,
  CASE WHEN o_orderstatus <> 'P' THEN 'doc:' || o_orderkey END AS ref, sha256(o_orderkey::VARCHAR) AS payload FROM orders),
j AS (SELECT *, '{"action":"ingest","actor":"' || actor || '","payload_sha256":"' || payload || '","prev_hash":"' AS head, '","ref":' || coalesce('"' || ref || '"', 'null') || ',"seq":' || seq || ',"ts":"' || ts || '"}' AS rest FROM e),
c(case_id, seq, ts, ref, prev_hash, hash) AS (SELECT case_id, seq, ts, ref, repeat('0', 64), sha256(repeat('0', 64) || head || repeat('0', 64) || rest) FROM j WHERE seq = 1
  UNION ALL SELECT j.case_id, j.seq, j.ts, j.ref, c.hash, sha256(c.hash || head || c.hash || rest) FROM c JOIN j ON c.case_id = j.case_id AND j.seq = c.seq + 1)
SELECT * FROM c"""


def l2_verify(spark: SparkSession, d: str) -> DataFrame:
    """Chains with one entry altered, one missing, or one link broken, by customer."""
    c = chain(spark, d)
    kind = F.regexp_replace("case_id", "c", "").cast("int") % 5
    c = c.withColumn("k", kind).filter("not (k = 1 and seq = 3)")
    c = c.withColumn("ref", F.when((F.col("k") == 2) & (F.col("seq") == 4), "doc:other").otherwise(F.col("ref"))).withColumn("prev_hash", F.when((F.col("k") == 3) & (F.col("seq") == 2), F.repeat(F.lit("1"), F.lit(64))).otherwise(F.col("prev_hash")))
    return caselog.verify(c)


L2_SQL = """WITH n AS (SELECT 'c' || o_custkey AS case_id, o_custkey % 5 AS k, count(*) AS n FROM orders GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN k = 1 AND n >= 4 THEN 3 WHEN k = 2 AND n >= 4 THEN 4 WHEN k = 3 AND n >= 2 THEN 2 END AS broken_at FROM n)
SELECT case_id, CASE WHEN k = 1 AND n >= 3 THEN n - 1 ELSE n END AS entries, broken_at IS NULL AS ok, CAST(broken_at AS INT) AS broken_at,
  CASE WHEN broken_at IS NULL THEN NULL WHEN k = 1 THEN 'sequence gap' WHEN k = 2 THEN 'altered content' ELSE 'broken link' END AS reason FROM b"""


def l3_tail(spark: SparkSession, d: str) -> DataFrame:
    return caselog.latest(chain(spark, d), 3).select("case_id", "seq", "ts")


L3_SQL = """SELECT case_id, seq, ts FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq DESC) AS k FROM (SELECT 'c' || o_custkey AS case_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate >= '1998-01-01', o_orderkey) AS seq, strftime(o_orderdate, '%Y-%m-%d') AS ts FROM orders)) WHERE k <= 3"""


def memory(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    notes = e.select(F.concat(F.lit("case_"), F.col("user_id") % 4).alias("case_id"), F.when(F.col("event_type") == "error", "question").otherwise("conclusion").alias("kind"), F.concat(F.when(F.col("event_id") % 2 == 0, " User ").otherwise("user "), F.col("user_id")).alias("text"), F.when(F.col("event_id") % 3 == 0, "closed").otherwise("open").alias("status"), F.col("value").alias("confidence"), F.col("event_id").alias("at"))
    return caselog.remember(notes)


MEMORY_SQL = r"""
m AS (SELECT 'case_' || (user_id % 4) AS case_id, sha256(CASE WHEN event_type = 'error' THEN 'question' ELSE 'conclusion' END || 'user ' || user_id) AS id, CASE WHEN event_type = 'error' THEN 'question' ELSE 'conclusion' END AS kind,
  arg_max(CASE WHEN event_id % 2 = 0 THEN ' User ' ELSE 'user ' END || user_id, event_id) AS text, arg_max(CASE WHEN event_id % 3 = 0 THEN 'closed' ELSE 'open' END, event_id) AS status, arg_max(value, event_id) AS confidence, min(event_id) AS created, max(event_id) AS updated FROM events GROUP BY user_id, 2, 3)"""


def l5_l6_recall(spark: SparkSession, d: str) -> DataFrame:
    m = kept(memory(spark, d), "memory")
    left = caselog.close(m, m.filter("text like '%7'"))
    return caselog.recall(left, status="open", text="USER 1", limit=20).select("id", "text", "status", "updated")


L5_SQL = f"WITH {MEMORY_SQL} SELECT id, text, status, updated FROM m WHERE status = 'open' AND text NOT LIKE '%7' AND lower(text) LIKE '%user 1%' ORDER BY updated DESC, id LIMIT 20"


def l7_last(spark: SparkSession, d: str) -> DataFrame:
    return caselog.latest(table(spark, d, "conversations"), 2, key="conv_id", order="turn").select("conv_id", "turn", "role")


L7_SQL = "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 2"


def l8_merged(spark: SparkSession, d: str) -> DataFrame:
    """All turns, every third as the user's, so that roles repeat."""
    out = caselog.merged_turns(table(spark, d, "conversations").withColumn("role", F.when(F.col("turn") % 3 == 2, "user").otherwise(F.col("role"))))
    return out.select("conv_id", "run", "role", F.md5("text").alias("digest"), "turns")


L8_SQL = r"""WITH t AS (SELECT * REPLACE (CASE WHEN turn % 3 = 2 THEN 'user' ELSE role END AS role) FROM conversations WHERE trim(coalesce(text, '')) <> ''),
o AS (SELECT *, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS opened FROM t),
c AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS change FROM o WHERE opened = 1),
r AS (SELECT *, sum(change) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c)
SELECT conv_id, CAST(run AS BIGINT) AS run, role, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest, count(*) AS turns FROM r GROUP BY 1, 2, 3"""


def l9_referents(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("seq"), "role", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.concat(F.lit("part:"), (F.col("conv_id") * 7 + F.col("turn") * 3 + i) % 1000 + 1)).alias("node_ids"))
    parts = table(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_name").alias("label"))
    convs = t.select("case_id").distinct()
    return caselog.referents(t, convs.join(t.select("case_id", F.explode("node_ids").alias("id")).distinct(), "case_id").join(parts, "id"))


L9_SQL = """WITH l AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT conv_id AS case_id, CAST(i AS INT) AS place, 'part:' || ((conv_id * 7 + turn * 3 + i) % 1000 + 1) AS id, p_name AS label FROM (SELECT *, unnest(range(8)) AS i FROM l) LEFT JOIN part ON p_partkey = (conv_id * 7 + turn * 3 + i) % 1000 + 1"""


def l10_fresh(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    found = o.select(F.concat(F.lit("c"), F.col("o_custkey") % 100).alias("case_id"), F.concat(F.lit("order "), "o_orderkey").alias("headline"), F.col("o_orderkey").alias("rank"))
    told = o.filter("o_orderstatus = 'F'").select(F.concat(F.lit("c"), F.col("o_custkey") % 100).alias("case_id"), F.concat(F.lit("order "), "o_orderkey").alias("headline"))
    return caselog.fresh_findings(found, told).select("case_id", "headline", "k")


L10_SQL = "SELECT case_id, headline, CAST(k AS INT) AS k FROM (SELECT 'c' || (o_custkey % 100) AS case_id, 'order ' || o_orderkey AS headline, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'F') WHERE k <= 8"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers about a nation's customers: some cite nations, some edges (regions) only, some ids that don't exist or are of the other kind, some nothing; of all kinds of claims."""
    c, k, n = table(spark, d, "customer"), F.col("c_custkey"), F.col("c_nationkey")
    node = lambda x: F.concat(F.lit("nation:"), x)
    none = F.array().cast("array<string>")
    return c.select(
        F.lit("c").alias("case_id"), k.alias("answer_id"), F.when(k % 7 == 0, "guidance").when(k % 7 != 1, "evidence").alias("claim_type"), F.lit("high").alias("confidence"),
        F.when(k % 3 == 0, none).when(k % 5 == 0, F.array(node(n + 50), node(n))).when(k % 11 == 0, F.array(F.lit("e:1"), node(n))).otherwise(F.array(node(n), node((n + 3) % 25))).alias("cited_nodes"),
        F.when(k % 2 == 0, F.array(F.concat(F.lit("e:"), k % 8))).otherwise(none).alias("cited_edges"),
        F.when(k % 4 > 0, F.array(node(n), node(n + 25), node((n + 1) % 25))).alias("highlight_path"), F.when(k % 13 == 0, F.array(F.lit("from a draft"))).alias("caveats"),
    )


def l11_citations(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nation").select(F.lit("c").alias("case_id"), F.concat(F.lit("nation:"), "n_nationkey").alias("id"))
    edges = table(spark, d, "region").select(F.lit("c").alias("case_id"), F.concat(F.lit("e:"), "r_regionkey").alias("id"))
    out = caselog.caveats(caselog.verify_citations(_answers(spark, d), nodes, edges))
    text = lambda c, sep=",": F.array_join(c, sep).alias(c)
    return out.select("answer_id", "claim_type", "ok", "confidence", text("cited_nodes"), text("cited_edges"), text("highlight_path"), text("dropped_nodes"), text("dropped_edges"), text("caveats", "; "))


#: From the rule: cited ids are looked up, those not found are taken out and listed; ok needs a node (for evidence) and nothing taken out.
L11_SQL = """WITH a AS (SELECT c_custkey AS answer_id, CASE WHEN k7 = 0 THEN 'guidance' ELSE 'evidence' END AS claim_type,
  CASE WHEN c_custkey % 3 = 0 THEN [] WHEN c_custkey % 5 = 0 THEN ['nation:' || (n + 50), 'nation:' || n] WHEN c_custkey % 11 = 0 THEN ['e:1', 'nation:' || n] ELSE ['nation:' || n, 'nation:' || ((n + 3) % 25)] END AS cn,
  CASE WHEN c_custkey % 2 = 0 THEN ['e:' || (c_custkey % 8)] ELSE [] END AS ce, CASE WHEN c_custkey % 4 > 0 THEN ['nation:' || n, 'nation:' || (n + 25), 'nation:' || ((n + 1) % 25)] ELSE [] END AS hp,
  CASE WHEN c_custkey % 13 = 0 THEN ['from a draft'] ELSE [] END AS own FROM (SELECT *, c_nationkey AS n, c_custkey % 7 AS k7 FROM customer)),
known AS (SELECT list('nation:' || n_nationkey) AS ns, (SELECT list('e:' || r_regionkey) FROM region) AS es FROM nation),
v AS (SELECT answer_id, claim_type, own, list_filter(cn, lambda x: list_contains(ns, x)) AS kn, list_filter(cn, lambda x: NOT list_contains(ns, x)) AS dn, list_filter(ce, lambda x: list_contains(es, x)) AS ke, list_filter(ce, lambda x: NOT list_contains(es, x)) AS de,
  list_filter(hp, lambda x: list_contains(ns, x)) AS path FROM a, known),
w AS (SELECT *, len(dn) + len(de) > 0 AS dropped, len(kn) = 0 AND claim_type = 'evidence' AS bare FROM v)
SELECT answer_id, claim_type, NOT dropped AND NOT bare AS ok, CASE WHEN dropped OR bare THEN 'low' ELSE 'high' END AS confidence, coalesce(array_to_string(kn, ','), '') AS cited_nodes, coalesce(array_to_string(ke, ','), '') AS cited_edges,
  coalesce(array_to_string(path, ','), '') AS highlight_path, coalesce(array_to_string(dn, ','), '') AS dropped_nodes, coalesce(array_to_string(de, ','), '') AS dropped_edges,
  coalesce(array_to_string(own || CASE WHEN dropped THEN ['dropped unknown ids: ' || array_to_string(dn || de, ', ')] ELSE [] END || CASE WHEN bare THEN ['cites nothing known'] ELSE [] END, '; '), '') AS caveats FROM w"""


def l7_uncleared(spark: SparkSession, d: str) -> DataFrame:
    """The turns after the last clearing of each conversation, one at every fifth turn of every second conversation."""
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("seq"), "role")
    return caselog.uncleared(t, t.filter("case_id % 2 = 0 and seq % 5 = 1").select("case_id", "seq"))


L7_UNCLEARED_SQL = """SELECT conv_id AS case_id, turn AS seq, role FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.conv_id % 2 = 0 AND x.turn % 5 = 1 AND x.turn >= c.turn)"""


def l13_conclusions(spark: SparkSession, d: str) -> DataFrame:
    """What orders conclude, as memories and as entries of each customer's audit chain: every entry names its memory and the hash of what was said."""
    o = table(spark, d, "orders")
    said = o.select(
        F.concat(F.lit("c"), "o_custkey").alias("case_id"), F.col("o_orderkey").alias("position"), F.lit("conclusion").alias("kind"), F.concat(F.lit("Priority "), "o_orderpriority").alias("text"), F.lit("open").alias("status"),
        F.lit("medium").alias("confidence"), F.col("o_orderkey").alias("at"), F.lit("agent").alias("actor"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ts"),
    )
    memories, audit = caselog.conclusions(said)
    chained = caselog.append(audit, spark.createDataFrame([], "case_id string, seq long, hash string"))
    known = memories.select("case_id", F.col("id").alias("ref"), F.col("text").alias("memory"), "updated")
    return chained.join(known, ["case_id", "ref"], "left").select("case_id", "seq", "action", "actor", "ref", "payload_sha256", "memory", "updated", F.length("hash").alias("hash_length"))


L13_SQL = """WITH s AS (SELECT 'c' || o_custkey AS case_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, 'Priority ' || o_orderpriority AS text, o_orderkey AS at, max(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS updated FROM orders)
SELECT case_id, seq, 'infer' AS action, 'agent' AS actor, sha256('conclusion' || lower(text)) AS ref, sha256('{"confidence":"medium","kind":"conclusion","status":"open","text":"' || text || '"}') AS payload_sha256, text AS memory, updated, 64::INT AS hash_length FROM s"""


def l12_bounded(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.slice(F.array_sort(F.collect_set(F.col("o_custkey") % 500)), 1, 500).alias("items"))
    return caselog.bounded(lists, "items").select("o_orderpriority", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), F.col("total").cast("long").alias("total"))


L12_SQL = "SELECT o_orderpriority, array_to_string(list_sort(list_distinct(list(o_custkey % 500)))[1:40], ',') AS items, CAST(count(DISTINCT o_custkey % 500) AS BIGINT) AS total FROM orders GROUP BY 1"


def q14_overview(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("case_id", F.concat(F.lit("case_"), F.col("user_id") % 4))
    heads = e.groupBy("case_id", F.concat(F.lit("user "), "user_id").alias("headline")).agg(F.sum("value").alias("v"))
    from pyspark.sql import Window

    ranked = heads.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("v"), "headline")))
    return query.overview(query.case_counts(events=e), ranked, memory(spark, d), top=5)


Q14_SQL = f"""WITH {MEMORY_SQL}, h AS (SELECT 'case_' || (user_id % 4) AS case_id, 'user ' || user_id AS headline, row_number() OVER (PARTITION BY user_id % 4 ORDER BY sum(value) DESC, 'user ' || user_id) AS rank, count(*) AS n FROM events GROUP BY user_id),
t AS (SELECT case_id, count(*) AS open_threads FROM m WHERE status = 'open' GROUP BY 1)
SELECT h.case_id, CAST(sum(n) AS BIGINT) AS events, string_agg(headline, '; ' ORDER BY rank) FILTER (rank <= 5) AS headlines, any_value(open_threads) AS open_threads FROM h JOIN t ON h.case_id = t.case_id GROUP BY 1"""



def q14_report(spark: SparkSession, d: str) -> DataFrame:
    """The whole overview of each case: counts, documents (one for each user and type of event), the first findings, threads."""
    e = table(spark, d, "events").withColumn("case_id", F.concat(F.lit("case_"), F.col("user_id") % 4))
    heads = e.groupBy("case_id", F.concat(F.lit("user "), "user_id").alias("headline")).agg(F.sum("value").alias("v"))
    found = numbered(heads, ["case_id"], [F.desc("v"), F.asc("headline")]).withColumn("severity", F.lit("high"))
    papers = e.select("case_id", F.concat_ws("-", F.lit("doc:u"), "user_id", "event_type").alias("doc_id"), F.col("event_type").alias("kind"), F.concat("event_type", F.lit(".csv")).alias("filename")).distinct()
    return query.report(query.case_counts(events=e, documents=papers), papers, found, memory(spark, d), limit=3)


Q14_REPORT_SQL = f"""WITH {MEMORY_SQL}, h AS (SELECT 'case_' || (user_id % 4) AS case_id, 'user ' || user_id AS headline, row_number() OVER (PARTITION BY user_id % 4 ORDER BY sum(value) DESC, 'user ' || user_id) AS rank, count(*) AS n FROM events GROUP BY user_id),
p AS (SELECT DISTINCT 'case_' || (user_id % 4) AS case_id, 'doc:u-' || user_id || '-' || event_type AS doc_id, event_type AS kind FROM events),
t AS (SELECT *, row_number() OVER (PARTITION BY case_id, kind ORDER BY updated DESC, id) AS k FROM m WHERE kind = 'conclusion' OR status = 'open')
SELECT case_id, 'counts' AS section, 1::INT AS place, 'events' AS item, sum(n)::VARCHAR AS note FROM h GROUP BY 1 UNION ALL SELECT case_id, 'counts', 2, 'documents', count(*)::VARCHAR FROM p GROUP BY 1
UNION ALL SELECT case_id, 'documents', CAST(row_number() OVER (PARTITION BY case_id ORDER BY doc_id) AS INT), doc_id || ' ' || kind || '.csv', kind FROM p
UNION ALL SELECT case_id, 'findings', CAST(rank AS INT), headline, 'high' FROM h WHERE rank <= 10 UNION ALL SELECT case_id, kind, CAST(k AS INT), text, status FROM t WHERE k <= 3"""

QUERIES = {
    "l7_uncleared": (l7_uncleared, L7_UNCLEARED_SQL),
    "l13_conclusions": (l13_conclusions, L13_SQL),
    "q14_report": (q14_report, Q14_REPORT_SQL),
    "l1_append": (l1_append, L1_SQL),
    "l2_verify": (l2_verify, L2_SQL),
    "l3_tail": (l3_tail, L3_SQL),
    "l4_l13_memory": (memory, f"WITH {MEMORY_SQL} SELECT * FROM m"),
    "l5_l6_recall": (l5_l6_recall, L5_SQL),
    "l7_last_turns": (l7_last, L7_SQL),
    "l8_merged_turns": (l8_merged, L8_SQL),
    "l9_referents": (l9_referents, L9_SQL),
    "l10_fresh_findings": (l10_fresh, L10_SQL),
    "l11_citations": (l11_citations, L11_SQL),
    "l12_bounded": (l12_bounded, L12_SQL),
    "q14_overview": (q14_overview, Q14_SQL),
}
