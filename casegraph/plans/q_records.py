"""Queries over records: normalisation, sources, edges, merging, anomalies. Each entry is (query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.functions import normalize as N
from casegraph.operators import anomalies, edges, merge
from casegraph.plans.standin import CALLS_SQL, EDGES_SQL, TRANSFERS_SQL, calls_raw, table, transfers_raw
from casegraph.sources import classify, shared, spans, tables

NTZ = "timestamp_ntz"


def call_facts(spark, d):
    return edges.calls(calls_raw(spark, d))


def transfer_facts(spark, d):
    return edges.transfers(transfers_raw(spark, d))


def call_edges(spark, d):
    return merge.merge_edges(call_facts(spark, d))


def transfer_edges(spark, d):
    return merge.merge_edges(transfer_facts(spark, d))


def x_names(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    raw = F.concat(F.lit(" Shri. Dr "), F.col("c_name"), F.lit(" ("), F.col("c_mktsegment"), F.lit(")"))
    return c.select(
        "c_custkey", N.slug(raw).alias("slug"), N.person(raw).alias("person"), N.plate(raw).alias("plate"), N.node_id("person", raw).alias("id"), N.type_of(N.node_id("document", raw)).alias("type"),
        N.node_id(F.lit("ship"), raw).alias("no_id"), N.valid_case_id(N.slug("c_name")).alias("case_ok"), N.valid_case_id(F.col("c_name")).alias("name_ok"),
    )


X_NAMES_SQL = r"""
SELECT c_custkey, 'shri_dr_' || s AS slug, s AS person, regexp_replace('shridr' || s, '_', '', 'g') AS plate, 'person:' || s AS id, 'document' AS type, CAST(NULL AS VARCHAR) AS no_id, true AS case_ok, false AS name_ok
FROM (SELECT c_custkey, trim(regexp_replace(lower(c_name || ' ' || c_mktsegment), '[^a-z0-9]+', '_', 'g'), '_') AS s FROM customer)"""


def x_phones(spark: SparkSession, d: str) -> DataFrame:
    calls = calls_raw(spark, d)
    return calls.groupBy(N.phone("A Party").alias("phone")).agg(F.countDistinct("A Party").alias("spellings"), F.count(F.lit(1)).alias("records"))


X_PHONES_SQL = "SELECT '9198' || lpad(user_id::VARCHAR, 8, '0') AS phone, count(DISTINCT event_id % 4) AS spellings, count(*) AS records FROM events GROUP BY 1"


def x_dates_amounts(spark: SparkSession, d: str) -> DataFrame:
    t = edges.canonical(transfers_raw(spark, d), edges.TRANSFER_COLUMNS)
    return t.select("seq", F.col("ts").cast(NTZ).alias("ts"), "amount", N.disposition(F.concat(F.col("mode"), F.lit(" trial"))).alias("disposition"))


X_DATES_SQL = f"WITH {TRANSFERS_SQL} SELECT seq, ts, amount, 'pending' AS disposition FROM tr"


def x_lists(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    raw = F.concat_ws(";", F.regexp_replace("p_type", " ", " and "), F.col("p_brand"), F.lit(" "))
    told = p.select("p_partkey", N.split_list(raw).alias("l"), N.interaction(F.element_at(F.array(*map(F.lit, ("dm sent", "Replied", "re-follow", "tagged", "poke"))), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("x"))
    return told.select("p_partkey", F.size("l").cast("long").alias("n"), F.array_join("l", "~").alias("parts"), F.col("x.type").alias("type"), F.col("x.weight").alias("weight"), F.col("x.confidence").alias("confidence"), F.col("x.basis").alias("basis"))


X_LISTS_SQL = r"""
SELECT p_partkey, CAST(len(string_split(p_type, ' ')) + 1 AS BIGINT) AS n, replace(p_type, ' ', '~') || '~' || p_brand AS parts,
  CASE p_partkey % 5 WHEN 0 THEN 'MESSAGED' WHEN 1 THEN 'CO_OCCURS' WHEN 2 THEN 'CO_OCCURS' WHEN 3 THEN 'CO_OCCURS' ELSE 'CO_OCCURS' END AS type,
  CASE p_partkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.2 WHEN 2 THEN 0.2 WHEN 3 THEN 0.3 ELSE 0.2 END::DOUBLE AS weight,
  CASE p_partkey % 5 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 WHEN 2 THEN 0.85 WHEN 3 THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence,
  CASE p_partkey % 5 WHEN 0 THEN 'social_dm' WHEN 1 THEN 'social_unspecified' WHEN 2 THEN 'social_follow' WHEN 3 THEN 'social_mention' ELSE 'social_unspecified' END AS basis
FROM part"""


def x_json(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "supplier")
    packed = tables.encode_attrs(F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit("name"), F.col("s_name")))
    return n.select("s_suppkey", packed.alias("attrs"), tables.decode_attrs(packed)["name"].alias("name"), N.canonical_json(seq=F.col("s_suppkey"), actor=F.col("s_name"), ref=F.lit(None).cast("string")).alias("entry"))


X_JSON_SQL = r"""SELECT s_suppkey, '{"name":"' || s_name || '","nation":"' || s_nationkey || '"}' AS attrs, s_name AS name, '{"actor":"' || s_name || '","ref":null,"seq":' || s_suppkey || '}' AS entry FROM supplier"""


def s_csv(spark: SparkSession, d: str) -> DataFrame:
    path = shared.fresh(spark, "csv")
    o = table(spark, d, "orders")
    o.select("o_orderkey", F.concat(F.lit('  say "'), F.col("o_orderpriority"), F.lit('", '), F.lit("ü ")).alias(" note "), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")).alias("status")).write.option("header", True).option("escape", '"').csv(path)
    return tables.read_records(spark, path).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "note", "status")


S_CSV_SQL = """SELECT o_orderkey, 'say "' || o_orderpriority || '", ü' AS note, CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus ELSE '' END AS status FROM orders"""


def s_texts(spark: SparkSession, d: str) -> DataFrame:
    """One file for each supplier, read whole and by its bytes."""
    path = shared.fresh(spark, "texts")
    s = table(spark, d, "supplier").select("s_suppkey", F.concat("s_name", F.lit("\nnation "), "s_nationkey").alias("value"))
    # Tasks put their files in place themselves: the driver would move one after another.
    tables.spread(s).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("s_suppkey").text(path)
    return tables.read_whole(spark, path).select(F.regexp_extract("path", r"s_suppkey=(\d+)", 1).cast("long").alias("s_suppkey"), "text", "sha256", "length")


S_TEXTS_SQL = "SELECT s_suppkey, t AS text, sha256(t) AS sha256, CAST(length(t) AS BIGINT) AS length FROM (SELECT s_suppkey, s_name || chr(10) || 'nation ' || s_nationkey || chr(10) AS t FROM supplier)"


def s_cases(spark: SparkSession, d: str) -> DataFrame:
    path = shared.fresh(spark, "cases")
    tables.write_cases(transfer_edges(spark, d).select("case_id", "nat_key", "type"), path)
    return tables.read_case(spark, path, "case_1").groupBy("case_id", "type").agg(F.count(F.lit(1)).alias("n"))


S_CASES_SQL = f"WITH {TRANSFERS_SQL}, {EDGES_SQL.format(facts='transfer_facts')} SELECT case_id, type, count(*) AS n FROM edges WHERE case_id = 'case_1' GROUP BY 1, 2"


def s_log(spark: SparkSession, d: str) -> DataFrame:
    path = shared.fresh(spark, "log")
    for status in ("F", "O", "P"):
        tables.append_log(table(spark, d, "orders").filter(F.col("o_orderstatus") == status).select("o_orderkey", "o_orderpriority"), path)
    return tables.read_log(spark, path, "o_orderkey long, o_orderpriority string")


S_LOG_SQL = "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')"


def _arrivals(spark, d):
    t = table(spark, d, "documents")
    return t.select(F.col("lang").alias("case_id"), F.concat(F.col("source"), F.lit(" Report"), F.lit(".txt")).alias("filename"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.col("doc_id").alias("seq"))


def s_doc_ids(spark: SparkSession, d: str) -> DataFrame:
    return tables.document_ids(_arrivals(spark, d))


S_DOC_IDS_SQL = """
WITH a AS (SELECT lang AS case_id, source || ' Report.txt' AS filename, sha256(coalesce(text, '')) AS sha256, doc_id AS seq FROM documents),
f AS (SELECT case_id, sha256, arg_min(filename, seq) AS filename, min(seq) AS seq, count(*) AS arrivals FROM a GROUP BY 1, 2),
n AS (SELECT *, lower(replace(filename, ' Report.txt', '')) || '_report' AS stem, row_number() OVER (PARTITION BY case_id, lower(replace(filename, ' Report.txt', '')) ORDER BY seq) AS k FROM f)
SELECT case_id, sha256, 'doc:' || stem || CASE WHEN k > 1 THEN '_' || lpad(k::VARCHAR, 3, '0') ELSE '' END AS doc_id, filename, arrivals, seq FROM n"""


def s_registry(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    rows = e.select(F.lit("case_1").alias("case_id"), F.concat(F.lit("doc:"), "user_id").alias("doc_id"), "event_type", F.col("ts").alias("ingested_at"), F.col("event_id").alias("seq"))
    rows = rows.select("case_id", "doc_id", F.concat("event_type", F.lit(".txt")).alias("filename"), F.col("event_type").alias("kind"), F.md5(F.col("seq").cast("string")).alias("sha256"), F.col("seq").alias("char_len"), "ingested_at", "seq")
    return tables.register_documents(rows).withColumn("ingested_at", F.col("ingested_at").cast(NTZ))


S_REGISTRY_SQL = """
SELECT 'case_1' AS case_id, 'doc:' || user_id AS doc_id, CAST(min(ts) AS TIMESTAMP) AS ingested_at, arg_max(event_type || '.txt', event_id) AS filename, arg_max(event_type, event_id) AS kind,
  arg_max(md5(event_id::VARCHAR), event_id) AS sha256, arg_max(event_id, event_id) AS char_len FROM events GROUP BY user_id"""


def s_ranges(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    cites = docs.select("doc_id", (F.col("doc_id") % 900).cast("int").alias("start"), (F.col("doc_id") % 900 + 20).cast("int").alias("end"))
    return tables.source_ranges(cites, docs)


S_RANGES_SQL = """SELECT doc_id, CAST(doc_id % 900 AS INT) AS start, CAST(doc_id % 900 + 20 AS INT) AS "end",
  substr(text, CAST(greatest(doc_id % 900 - 160, 0) + 1 AS BIGINT), CAST(doc_id % 900 + 180 - greatest(doc_id % 900 - 160, 0) AS BIGINT)) AS excerpt FROM documents WHERE text IS NOT NULL"""


def s_catalogue(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    cases = n.select(F.col("n_nationkey").alias("case_id"), F.col("n_name").alias("title"), F.concat(F.lit("officer"), F.col("n_regionkey")).alias("officer"), F.col("n_nationkey").alias("updated"))
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    asked = s.select(F.col("s_nationkey").alias("case_id"), F.lit("question").alias("kind"), F.when(F.col("s_acctbal") > 5000, "open").otherwise("closed").alias("status"))
    return tables.case_catalogue(cases, {"customers": c.select(F.col("c_nationkey").alias("case_id")), "suppliers": s.select(F.col("s_nationkey").alias("case_id"))}, asked)


S_CATALOGUE_SQL = """SELECT n_nationkey AS case_id, n_name AS title, 'officer' || n_regionkey AS officer, n_nationkey AS updated, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers,
  (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) AS open_questions FROM nation"""


def c_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds and gradings of reports made from orders."""
    o = table(spark, d, "orders")
    grade = F.concat(F.lit("Source report, grading: "), F.element_at(F.split(F.lit("A,B,C,D,E,F"), ","), (F.col("o_orderkey") % 6 + 1).cast("int")), F.col("o_custkey") % 6 + 1)
    text = F.when(F.col("o_orderstatus") == "F", grade).when(F.col("o_orderstatus") == "O", F.concat(F.lit("Observation report on "), "o_orderpriority")).otherwise("Intelligence input, ungraded")
    hint = F.when(F.col("o_custkey") % 3 == 0, "IMEI").when(F.col("o_custkey") % 3 == 1, "Police Station").otherwise("Platform")
    told = o.select("o_orderkey", text.alias("text"), F.array(F.lit("Date"), hint).alias("cols")).withColumn("kind", classify.text_kind(F.col("text"))).withColumn("g", classify.grading(F.col("text")))
    return told.select("o_orderkey", "kind", classify.table_kind(F.col("cols")).alias("table_kind"), F.col("g.reliability").alias("reliability"), F.col("g.credibility").alias("credibility"), classify.confidence_factor(F.col("kind"), F.col("text")).alias("factor"))


C_KINDS_SQL = """
WITH v AS (SELECT *, [1.0, 0.85, 0.7, 0.45, 0.25, 0.5] AS scale FROM orders)
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'surveillance' ELSE 'intelligence' END AS kind, CASE o_custkey % 3 WHEN 0 THEN 'cdr' WHEN 1 THEN 'history' ELSE 'social' END AS table_kind,
  CASE WHEN o_orderstatus = 'F' THEN ['A', 'B', 'C', 'D', 'E', 'F'][o_orderkey % 6 + 1] END AS reliability, CASE WHEN o_orderstatus = 'F' THEN (o_custkey % 6 + 1)::VARCHAR END AS credibility,
  CAST(CASE o_orderstatus WHEN 'F' THEN least(scale[o_orderkey % 6 + 1], scale[o_custkey % 6 + 1]) WHEN 'O' THEN 1.0 ELSE 0.7 END AS DOUBLE) AS factor FROM v"""


def c_warnings(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    docs = s.select(F.col("s_suppkey").alias("doc_id"), F.when(F.col("s_suppkey") % 2 == 0, "cdr").otherwise("intelligence").alias("kind"), F.lit("grade B2").alias("text"), F.when(F.col("s_suppkey") % 4 == 0, F.array(F.lit("caller"), F.lit("callee"))).otherwise(F.array(F.lit("caller"))).alias("columns"))
    linked = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 600")
    return classify.warnings(docs, linked)


C_WARNINGS_SQL = """
SELECT s_suppkey AS doc_id, 'missing columns: callee' AS warning FROM supplier WHERE s_suppkey % 4 = 2
UNION ALL SELECT s_suppkey, 'no row could be linked' FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(*) > 600)
UNION ALL SELECT s_suppkey, 'graded B2' FROM supplier WHERE s_suppkey % 2 = 1"""


def e_facts(facts):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return facts(spark, d).select("case_id", "src", "dst", "type", F.col("ts").cast(NTZ).alias("ts"), "confidence", "amount", "seq")

    return run


def e_social(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as posts: who speaks mentions the two next roles."""
    c = table(spark, d, "conversations")
    raw = c.select(F.concat(F.lit("case_"), F.col("conv_id") % 4).alias("case_id"), F.lit("doc:posts").alias("doc_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.lit("Chat App").alias("network"), F.concat(F.lit("@"), F.col("role"), F.lit("."), F.col("conv_id") % 50).alias("user"), F.concat(F.lit("@peer-"), F.col("turn"), F.lit(" and peer "), F.col("conv_id") % 7).alias("mentions"), F.when(F.col("turn") % 2 == 0, "DM").otherwise("mention").alias("action"), F.concat(F.lit("Ms "), F.col("role"), F.lit(" "), F.col("conv_id") % 50).alias("display_name"), F.concat(F.lit("City "), F.col("conv_id") % 3).alias("checkin"))
    return edges.social(raw).select("case_id", "src", "dst", "type", "weight", "confidence", "basis", "seq")


E_SOCIAL_SQL = """
WITH c AS (SELECT 'case_' || (conv_id % 4) AS case_id, conv_id * 1000 + turn AS seq, 'account:chat_app_' || role || '_' || (conv_id % 50) AS me, role || '_' || (conv_id % 50) AS who, turn, unnest(['account:chat_app_peer_' || turn, 'account:chat_app_peer_' || (conv_id % 7)]) AS peer FROM conversations)
SELECT case_id, CASE WHEN turn % 2 = 0 THEN me ELSE least(me, peer) END AS src, CASE WHEN turn % 2 = 0 THEN peer ELSE greatest(me, peer) END AS dst, CASE WHEN turn % 2 = 0 THEN 'MESSAGED' ELSE 'CO_OCCURS' END AS type,
  CAST(CASE WHEN turn % 2 = 0 THEN 1.0 ELSE 0.3 END AS DOUBLE) AS weight, CAST(CASE WHEN turn % 2 = 0 THEN 0.9 ELSE 0.8 END AS DOUBLE) AS confidence, CASE WHEN turn % 2 = 0 THEN 'social_dm' ELSE 'social_mention' END AS basis, seq FROM c
UNION ALL SELECT DISTINCT case_id, 'person:' || who, me, 'OWNS', 1.0, 0.45, 'social_profile', seq FROM c
UNION ALL SELECT DISTINCT case_id, me, 'location:city_' || (seq // 1000 % 3), 'LOCATED_AT', 1.0, 0.7, 'social_geotag', seq FROM c"""


def history_raw(spark: SparkSession, d: str) -> DataFrame:
    o = tables.spread(table(spark, d, "orders"))
    return o.select(
        F.concat(F.lit("case_"), F.col("o_custkey") % 4).alias("case_id"), F.lit("doc:register").alias("doc_id"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("Late Shri Person "), F.col("o_custkey")).alias("Accused Name"), F.concat(F.lit("C/"), F.col("o_orderkey") % 5000).alias("fir-no"),
        F.col("o_orderpriority").alias("under_section"), F.date_format("o_orderdate", "dd-MM-yyyy").alias("fir_date"), F.concat(F.lit("PS "), F.col("o_orderkey") % 20).alias("police_station"),
        F.when(F.col("o_orderstatus") == "F", "Convicted").when(F.col("o_orderstatus") == "O", "Under trial").otherwise("Cancelled").alias("disposal"), F.concat(F.lit("Person "), (F.col("o_custkey") * 7) % 1000, F.lit(" / Person "), (F.col("o_custkey") * 3) % 1000).alias("co_accused"),
    )


HISTORY_SQL = r"""
h AS (SELECT 'case_' || (o_custkey % 4) AS case_id, 'person:person_' || o_custkey AS who, 'event:c_' || (o_orderkey % 5000) AS prior, o_orderpriority AS offence, date_trunc('day', CAST(o_orderdate AS TIMESTAMP)) AS ts, 'location:ps_' || (o_orderkey % 20) AS station,
  CASE o_orderstatus WHEN 'F' THEN 'convicted' WHEN 'O' THEN 'pending' ELSE 'acquitted' END AS disposition, o_custkey, o_orderkey AS seq FROM orders),
o AS (SELECT *, unnest(['person:person_' || ((o_custkey * 7) % 1000), 'person:person_' || ((o_custkey * 3) % 1000)]) AS other FROM h),
history_facts AS (
  SELECT case_id, who AS src, prior AS dst, 'MENTIONED_IN' AS type, ts, 0.95 AS confidence, 'criminal_history' AS basis, disposition, seq FROM h
  UNION ALL SELECT case_id, prior, station, 'LOCATED_AT', ts, 0.95, 'case_jurisdiction', NULL, seq FROM h
  UNION ALL SELECT case_id, other, prior, 'MENTIONED_IN', ts, 0.95, 'criminal_history', disposition, seq FROM o WHERE who <> other
  UNION ALL SELECT case_id, least(who, other), greatest(who, other), 'CO_OCCURS', ts, 0.85, 'co_accused', NULL, seq FROM o WHERE who <> other)"""


def e_history(spark: SparkSession, d: str) -> DataFrame:
    return edges.history(history_raw(spark, d)).select("case_id", "src", "dst", "type", F.col("ts").cast(NTZ).alias("ts"), "confidence", "basis", "disposition", "seq")


def r2_quality(spark: SparkSession, d: str) -> DataFrame:
    raw = transfers_raw(spark, d).withColumn("value_date", F.when(F.col("seq") % 10 == 1, "2024").otherwise(F.col("value_date"))).withColumn("credit_account", F.when(F.col("seq") % 10 == 2, " ").otherwise(F.col("credit_account")))
    return edges.quality(edges.canonical(raw, edges.TRANSFER_COLUMNS), ("src", "dst")).select("case_id", "rows_read", "rows_dropped", "bad_dates", "bad_amounts")


R2_SQL = f"WITH {TRANSFERS_SQL} SELECT case_id, count(*) AS rows_read, count(*) FILTER (seq % 10 = 2) AS rows_dropped, count(*) FILTER (seq % 10 = 1) AS bad_dates, 0::BIGINT AS bad_amounts FROM tr GROUP BY 1"


def u_edges(facts):
    def run(spark: SparkSession, d: str) -> DataFrame:
        # Merging the same facts twice changes nothing but the count of facts.
        return merge.merge_edges(facts(spark, d)).select("case_id", "nat_key", "src", "dst", "type", F.col("ts").cast(NTZ).alias("ts"), "confidence", "amount", "facts")

    return run


def u_edges_sql(facts_sql: str, facts: str) -> str:
    return f"WITH {facts_sql}, {EDGES_SQL.format(facts=facts)} SELECT case_id, nat_key, src, dst, type, ts, CAST(confidence AS DOUBLE) AS confidence, amount, facts FROM edges"


def u_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Customers and their accounts as sightings with labels of several shapes."""
    o = table(spark, d, "orders")
    label = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("C "), F.col("o_custkey"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("C-"), F.col("o_custkey"), F.lit("."))).otherwise(F.concat(F.lit("C0"), F.col("o_custkey")))
    seen = o.select(F.lit("case_1").alias("case_id"), F.explode(F.array(F.lit("person"), F.lit("account"))).alias("type"), "o_custkey", label.alias("label"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"))
    seen = seen.withColumn("id", F.concat("type", F.lit(":"), "o_custkey"))
    return merge.merge_nodes(seen).select("id", "type", "label", F.array_join("aliases", "~").alias("aliases"), F.col("first_seen").cast(NTZ).alias("first_seen"), F.col("last_seen").cast(NTZ).alias("last_seen"), "sightings")


U_NODES_SQL = """
WITH s AS (SELECT o_custkey, unnest(['person', 'account']) AS type, CASE o_orderkey % 3 WHEN 0 THEN 'C ' || o_custkey WHEN 1 THEN 'C-' || o_custkey || '.' ELSE 'C0' || o_custkey END AS label, CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderkey AS seq FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY type, o_custkey ORDER BY CASE WHEN type = 'account' THEN length(regexp_replace(label, '[A-Za-z0-9]', '', 'g')) ELSE 0 END, -length(label), seq) AS k FROM s),
b AS (SELECT type, o_custkey, label AS best FROM r WHERE k = 1)
SELECT r.type || ':' || r.o_custkey AS id, r.type, best AS label, coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (label <> best))), '~'), '') AS aliases, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS sightings
FROM r JOIN b ON r.type = b.type AND r.o_custkey = b.o_custkey GROUP BY r.type, r.o_custkey, best"""


def u_sources(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    refs = li.select(F.col("l_suppkey").alias("key"), F.concat(F.lit("doc:"), F.col("l_partkey") % 40).alias("doc_id"), (F.col("l_orderkey") % 50).cast("int").alias("start"), (F.col("l_orderkey") % 50 + 5).cast("int").alias("end"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    out = merge.bounded_sources(refs, ["key"])
    return out.select("key", F.size("sources").cast("long").alias("kept"), "source_count", F.md5(F.array_join(F.transform("sources", lambda s: F.concat_ws("/", s["doc_id"], s["start"].cast("string"))), ",")).alias("digest"))


U_SOURCES_SQL = """
WITH r AS (SELECT l_suppkey AS key, 'doc:' || (l_partkey % 40) AS doc_id, l_orderkey % 50 AS start, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY 1, 2, 3),
a AS (SELECT *, row_number() OVER (PARTITION BY key, doc_id ORDER BY seq, start) AS k FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq, doc_id, start) AS j FROM a WHERE k <= 3),
c AS (SELECT key, count(*) AS source_count FROM r GROUP BY key)
SELECT b.key, count(*) AS kept, any_value(source_count) AS source_count, md5(string_agg(doc_id || '/' || start, ',' ORDER BY j)) AS digest FROM b JOIN c USING (key) WHERE j <= 60 GROUP BY b.key"""


def u_rejects(spark: SparkSession, d: str) -> DataFrame:
    # Merged once, for all that is asked of them.
    e = shared.kept(transfer_edges(spark, d).select("case_id", "id", "src", "dst", "type"), "edges")
    ends = e.select("case_id", F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("type", F.when(F.col("id").endswith("7"), "ship").otherwise(N.type_of("id"))).withColumn("source_count", F.lit(1))
    nodes = ends.filter(~F.col("id").like("account:s%3"))
    return merge.rejects(nodes, e.withColumn("source_count", F.lit(1))).groupBy("case_id", "reason").agg(F.count(F.lit(1)).alias("n"))


U_REJECTS_SQL = f"""
WITH {TRANSFERS_SQL}, {EDGES_SQL.format(facts='transfer_facts')},
n AS (SELECT DISTINCT case_id, unnest([src, dst]) AS id FROM edges)
SELECT case_id, 'unknown type' AS reason, count(*) AS n FROM n WHERE id LIKE '%7' GROUP BY 1
UNION ALL SELECT case_id, 'dangling end', count(*) FROM edges WHERE dst LIKE 'account:s%3' OR src LIKE 'account:s%3' GROUP BY 1"""


def u_summary(spark: SparkSession, d: str) -> DataFrame:
    """What the later half of the transfers adds to the earlier."""
    # Facts of one edge have one time, so the halves can be cut after the merge, which then is made once.
    edges = shared.kept(transfer_edges(spark, d).select("case_id", "nat_key", "src", "dst", "ts"), "edges")
    old, new = edges.filter("ts < '1998-01-01' or ts is null"), edges.filter("ts >= '1998-01-01'")
    ids = lambda f: f.select("case_id", F.explode(F.array("src", "dst")).alias("id")).distinct()
    return merge.ingest_summary(ids(new), ids(old), new, old)


U_SUMMARY_SQL = f"""
WITH {TRANSFERS_SQL}, o AS (SELECT * FROM transfer_facts WHERE ts < '1998-01-01' OR ts IS NULL), w AS (SELECT * FROM transfer_facts WHERE ts >= '1998-01-01'),
oi AS (SELECT DISTINCT case_id, unnest([src, dst]) AS id FROM o), wi AS (SELECT DISTINCT case_id, unnest([src, dst]) AS id FROM w),
n AS (SELECT case_id, count(*) AS c FROM (SELECT * FROM wi EXCEPT SELECT * FROM oi) GROUP BY 1),
e AS (SELECT case_id, count(*) AS c FROM (SELECT DISTINCT case_id, src, dst, type, ts FROM w) GROUP BY 1)
SELECT coalesce(n.case_id, e.case_id) AS case_id, coalesce(n.c, 0) AS nodes_new, coalesce(e.c, 0) AS edges_new FROM n FULL JOIN e ON n.case_id = e.case_id"""


def u_stale(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return merge.stale(c.select(F.col("c_nationkey").alias("case_id"), (F.col("c_custkey") % 3).alias("graph_rev"), "c_custkey"), table(spark, d, "nation").select(F.col("n_nationkey").alias("case_id"), (F.col("n_nationkey") % 3).cast("long").alias("graph_rev")))


U_STALE_SQL = "SELECT c_nationkey AS case_id, c_custkey % 3 AS graph_rev, c_custkey, CAST(c_nationkey % 3 AS BIGINT) AS current_rev, c_custkey % 3 <> c_nationkey % 3 AS stale FROM customer"


def told(df: DataFrame) -> DataFrame:
    return df.select("case_id", "kind", F.array_join("node_ids", ",").alias("nodes"), F.col("ts").cast(NTZ).alias("ts"), "score", "n")


def a1(spark, d):
    return told(anomalies.volume_spikes(call_edges(spark, d)))


SPIKES_SQL = r"""
ends AS (SELECT case_id, unnest([src, dst]) AS node, ts FROM edges WHERE type IN ('CALLED', 'MESSAGED', 'TRANSFERRED_TO', 'LOCATED_AT') AND ts IS NOT NULL),
hours AS (SELECT case_id, node, date_trunc('hour', ts) AS hour, count(*) AS n FROM ends GROUP BY 1, 2, 3),
own AS (SELECT *, avg(n) OVER w AS mean, coalesce(nullif(stddev_pop(n) OVER w, 0), 1) AS sd, sum(n) OVER w AS total, count(*) OVER w AS hs FROM hours WINDOW w AS (PARTITION BY case_id, node)),
spikes AS (SELECT case_id, 'volume_spike' AS kind, node AS nodes, hour AS ts, round((n - mean) / sd, 2) AS score, n FROM own WHERE total >= 6 AND hs >= 3 AND (n - mean) / sd >= 2.5 AND n >= greatest(3, 2 * mean))"""
SWAPS_SQL = r"""
swaps AS (SELECT case_id, 'handset_swap' AS kind, src || ',' || string_agg(dst, ',' ORDER BY dst) AS nodes, CAST(NULL AS TIMESTAMP) AS ts, CAST(count(*) AS DOUBLE) AS score, count(*) AS n
  FROM (SELECT DISTINCT case_id, src, dst FROM edges WHERE type = 'REGISTERED_TO') GROUP BY case_id, src HAVING count(*) >= 2)"""
ONE_WAY_SQL = r"""
one_way AS (SELECT case_id, 'one_way_account' AS kind, node AS nodes, min(ts) AS ts, CAST(count(*) AS DOUBLE) AS score, count(*) AS n
  FROM (SELECT case_id, src AS node, 1 AS o, ts FROM edges WHERE type = 'TRANSFERRED_TO' UNION ALL SELECT case_id, dst, 0, ts FROM edges WHERE type = 'TRANSFERRED_TO') GROUP BY case_id, node HAVING count(*) >= 3 AND sum(o) IN (0, count(*)))"""
LARGE_SQL = r"""
stats AS (SELECT case_id, quantile_cont(amount, 0.5) AS median, stddev_pop(amount) AS sd, count(*) AS n FROM edges WHERE type = 'TRANSFERRED_TO' AND amount IS NOT NULL GROUP BY 1 HAVING count(*) >= 5),
large AS (SELECT e.case_id, 'large_transfer' AS kind, src || ',' || dst AS nodes, ts, round(amount / greatest(median, 1), 2) AS score, n FROM edges e JOIN stats s ON e.case_id = s.case_id
  WHERE type = 'TRANSFERRED_TO' AND amount >= greatest(5 * median, median + 2 * coalesce(nullif(sd, 0), 1)))"""
SILENT_SQL = r"""
seen AS (SELECT case_id, node, count(*) AS n, min(ts) AS a, max(ts) AS b FROM (SELECT case_id, unnest([src, dst]) AS node, ts FROM edges WHERE type IN ('CALLED', 'MESSAGED') AND ts IS NOT NULL) GROUP BY 1, 2),
quiet AS (SELECT *, (epoch_us(b) - epoch_us(a)) / 86400000000 AS span, (epoch_us(max(b) OVER (PARTITION BY case_id)) - epoch_us(b)) / 86400000000 AS quiet FROM seen),
silent AS (SELECT case_id, 'went_silent' AS kind, node AS nodes, b AS ts, round(quiet, 1) AS score, n FROM quiet WHERE n >= 8 AND span >= 3 AND quiet >= greatest(3, span * 0.4))"""
CALL_EDGES_SQL = f"WITH {CALLS_SQL}, {EDGES_SQL.format(facts='call_facts')}"
TRANSFER_EDGES_SQL = f"WITH {TRANSFERS_SQL}, {EDGES_SQL.format(facts='transfer_facts')}"


def event_payments(spark: SparkSession, d: str) -> DataFrame:
    """events as payments, whose values have outliers; and as contacts by user and kind, some of which stop."""
    e = table(spark, d, "events")
    ts = F.date_trunc("second", "ts")
    return e.select(F.lit("case_1").alias("case_id"), F.concat(F.lit("account:u"), "user_id").alias("src"), F.concat(F.lit("account:"), "event_type", F.col("user_id") % 7).alias("dst"), F.explode(F.array(F.lit("TRANSFERRED_TO"), F.lit("CALLED"))).alias("type"), ts.cast("timestamp").alias("ts"), F.col("value").alias("amount"))


PAYMENTS_SQL = "WITH edges AS (SELECT 'case_1' AS case_id, 'account:u' || user_id AS src, 'account:' || event_type || (user_id % 7) AS dst, unnest(['TRANSFERRED_TO', 'CALLED']) AS type, date_trunc('second', CAST(ts AS TIMESTAMP)) AS ts, value AS amount FROM events)"
TOLD = "SELECT case_id, kind, nodes, ts, CAST(score AS DOUBLE) AS score, CAST(n AS BIGINT) AS n FROM"


def order_contacts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.lit("case_1").alias("case_id"), F.concat(F.lit("phone:"), "o_custkey").alias("src"), F.lit("phone:desk").alias("dst"), F.lit("CALLED").alias("type"), F.col("o_orderdate").cast("timestamp").alias("ts"))


CONTACTS_SQL = "WITH edges AS (SELECT 'case_1' AS case_id, 'phone:' || o_custkey AS src, 'phone:desk' AS dst, 'CALLED' AS type, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders)"


def ranked_anomalies(spark: SparkSession, d: str) -> DataFrame:
    both = shared.kept(call_edges(spark, d).unionByName(transfer_edges(spark, d)), "edges")
    found = anomalies.ranked(anomalies.anomalies(both))
    return found.select("case_id", "rank", "kind", F.array_join("node_ids", ",").alias("nodes"), F.col("ts").cast(NTZ).alias("ts"), "score")


RANKED_SQL = f"""
WITH {CALLS_SQL}, {TRANSFERS_SQL}, all_facts AS (SELECT * FROM call_facts UNION ALL SELECT * FROM transfer_facts), {EDGES_SQL.format(facts='all_facts')}, {SPIKES_SQL}, {SWAPS_SQL}, {ONE_WAY_SQL}, {LARGE_SQL}, {SILENT_SQL},
found AS (SELECT * FROM spikes UNION ALL SELECT * FROM swaps UNION ALL SELECT * FROM one_way UNION ALL SELECT * FROM large UNION ALL SELECT * FROM silent)
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, kind, nodes, ts) AS rank, kind, nodes, ts, CAST(score AS DOUBLE) AS score FROM found"""

def order_lines(spark: SparkSession, d: str) -> DataFrame:
    """orders as one CSV export for each customer, with a blank line after the header, read with places."""
    o = table(spark, d, "orders")
    line = F.format_string("C-%d,\"desk, \"\"%s\"\"\",%s,%s", F.col("o_custkey"), F.col("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey").cast("string"))
    texts = o.groupBy(F.concat(F.lit("case_"), F.col("o_custkey") % 4).alias("case_id"), F.concat(F.lit("doc:o"), F.col("o_custkey")).alias("doc_id")).agg(
        F.concat(F.lit("from_account,to_account,date,reference\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"]), "\n")).alias("text")
    )
    return tables.record_lines(texts, ["from_account", "to_account", "date", "reference"])


LINES_SQL = r'''
ol AS (SELECT 'case_' || (o_custkey % 4) AS case_id, 'doc:o' || o_custkey AS doc_id, o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS st,
  length('C-' || o_custkey || ',"desk, ""' || o_orderstatus || '""",' || CAST(o_orderdate AS DATE) || ',' || o_orderkey) + 1 AS n, row_number() OVER w AS k, count(*) OVER (PARTITION BY o_custkey) AS c,
  coalesce(sum(length('C-' || o_custkey || ',"desk, ""' || o_orderstatus || '""",' || CAST(o_orderdate AS DATE) || ',' || o_orderkey) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 40 AS start
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
spans AS (SELECT *, CAST(k + 1 AS BIGINT) AS seq, CAST(start + n - (k = c)::INT AS INT) AS stop FROM ol)'''


def x14_lines(spark: SparkSession, d: str) -> DataFrame:
    return order_lines(spark, d).select("case_id", "doc_id", "seq", "start", "end", "to_account", F.col("reference").cast("long").alias("reference"))


X14_SQL = f"""WITH {LINES_SQL} SELECT case_id, doc_id, seq, CAST(start AS INT) AS start, stop AS "end", 'desk, "' || st || '"' AS to_account, o_orderkey AS reference FROM spans"""


def x14_file(spark: SparkSession, d: str) -> DataFrame:
    """All orders as one CSV file, every third with a quoted line break, read in splits of 64 KB: each row and its place."""
    o = table(spark, d, "orders")
    note = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('"two\n'), "o_orderpriority", F.lit('"'))).otherwise(F.col("o_orderpriority"))
    line = F.concat_ws(",", F.concat(F.lit("C-"), "o_custkey"), note, "o_orderstatus", F.col("o_orderkey").cast("string"))
    path = shared.fresh(spark, "export")
    rows = o.select(F.col("o_orderkey").alias("k"), line.alias("value")).union(spark.createDataFrame([(-1, "account,priority,status,key")], "k long, value string"))
    rows.coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        return spans.record_spans(spark, path).select("seq", "start", "end", "account", F.replace("priority", F.lit("\n"), F.lit("/")).alias("priority"), "status", F.col("key").cast("long").alias("key"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


X14_FILE_SQL = r"""WITH l AS (SELECT *, o_orderkey % 3 = 0 AS two, length('C-' || o_custkey || ',' || o_orderpriority || ',' || o_orderstatus || ',' || o_orderkey) + 1 + CASE WHEN o_orderkey % 3 = 0 THEN 6 ELSE 0 END AS n FROM orders),
p AS (SELECT *, 28 + coalesce(sum(n) OVER w, 0) AS start, 1 + coalesce(sum(1 + two::INT) OVER w, 0) AS seq FROM l WINDOW w AS (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT CAST(seq AS BIGINT) AS seq, CAST(start AS BIGINT) AS start, CAST(start + n AS BIGINT) AS "end", 'C-' || o_custkey AS account, CASE WHEN two THEN 'two/' || o_orderpriority ELSE o_orderpriority END AS priority, o_orderstatus AS status, o_orderkey AS key FROM p"""


def u3_cited(spark: SparkSession, d: str) -> DataFrame:
    """Which lines each edge and each account rests on."""
    facts = kept_facts(edges.transfers(order_lines(spark, d)))
    first = lambda df, key: df.select("case_id", F.col(key).alias("key"), "source_count", F.size("sources").cast("long").alias("kept"), F.col("sources")[0]["doc_id"].alias("doc_id"), F.col("sources")[0]["start"].alias("start"), F.col("sources")[0]["end"].alias("end"))
    return first(merge.edge_sources(facts), "nat_key").union(first(merge.node_sources(facts), "id"))


def kept_facts(df: DataFrame) -> DataFrame:
    return shared.kept(df, "facts")


U3_CITED_SQL = f"""WITH {LINES_SQL}, f AS (SELECT case_id, 'account:c_' || o_custkey AS a, 'account:desk_' || lower(st) AS b, day, doc_id, CAST(start AS INT) AS start, stop, seq FROM spans),
r AS (SELECT case_id, a || '|TRANSFERRED_TO|' || b || '|' || day || 'T00:00:00' AS key, doc_id, start, stop, seq FROM f UNION ALL SELECT case_id, unnest([a, b]), doc_id, start, stop, seq FROM f),
g AS (SELECT *, row_number() OVER (PARTITION BY case_id, key, doc_id ORDER BY seq, start) AS j, row_number() OVER (PARTITION BY case_id, key ORDER BY seq, doc_id, start) AS k FROM r)
SELECT case_id, key, count(*) AS source_count, least(60, count(*) FILTER (j <= 3)) AS kept, any_value(doc_id) FILTER (k = 1) AS doc_id, any_value(start) FILTER (k = 1) AS start, any_value(stop) FILTER (k = 1) AS "end" FROM g GROUP BY 1, 2"""


def u2_attrs(spark: SparkSession, d: str) -> DataFrame:
    out = merge.edge_attrs(transfer_facts(spark, d))
    return out.select("case_id", "nat_key", F.size("attrs").cast("long").alias("n"), F.col("attrs")["mode"].alias("mode"), F.col("attrs")["txn_id"].alias("txn_id"))


U2_ATTRS_SQL = f"WITH {TRANSFERS_SQL} SELECT case_id, src || '|TRANSFERRED_TO|' || dst || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%S') AS nat_key, 2::BIGINT AS n, arg_max(mode, seq) AS mode, arg_max(l_orderkey, seq)::VARCHAR AS txn_id FROM tr GROUP BY 1, 2"


def u4_sources(spark: SparkSession, d: str) -> DataFrame:
    """The lines of an order as its sources, some twice, and some orders with one that lacks a document."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.when((F.col("l_orderkey") % 5 > 0) | (F.col("l_linenumber") > 1), F.concat(F.lit("doc:"), F.col("l_linenumber") % 3)))).alias("docs"), F.bool_or((F.col("l_orderkey") % 5 == 0) & (F.col("l_linenumber") == 1)).alias("lacks"))
    docs = F.when(F.col("lacks"), F.concat("docs", F.array(F.lit(None).cast("string")))).otherwise(F.col("docs"))
    clean = merge.clean_sources(F.transform(docs, lambda x: F.struct(x.alias("doc_id"), F.lit(0).alias("start"), F.lit(5).alias("end"))))
    return li.select("l_orderkey", F.array_join(F.transform(clean, lambda s: s["doc_id"]), ",").alias("sources"))


U4_SQL = "SELECT l_orderkey, CASE WHEN NOT bool_or(l_orderkey % 5 = 0 AND l_linenumber = 1) THEN string_agg(DISTINCT 'doc:' || (l_linenumber % 3), ',' ORDER BY 'doc:' || (l_linenumber % 3)) END AS sources FROM lineitem GROUP BY 1"


def u1_accounts(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_attrs(edges.account_attrs(transfers_raw(spark, d))).select("case_id", "id", F.col("attrs")["ifsc"].alias("ifsc"))


U1_ACCOUNTS_SQL = f"WITH {TRANSFERS_SQL} SELECT case_id, dst AS id, 'BANK0' || lpad((arg_max(l_orderkey, seq) % 1000)::VARCHAR, 6, '0') AS ifsc FROM tr GROUP BY 1, 2"


QUERIES = {
    "x14_record_lines": (x14_lines, X14_SQL),
    "x14_file_spans": (x14_file, X14_FILE_SQL),
    "u3_cited_lines": (u3_cited, U3_CITED_SQL),
    "u2_edge_attrs": (u2_attrs, U2_ATTRS_SQL),
    "u4_clean_sources": (u4_sources, U4_SQL),
    "u1_account_attrs": (u1_accounts, U1_ACCOUNTS_SQL),
    "x1_x6_names": (x_names, X_NAMES_SQL),
    "x3_r1_phones": (x_phones, X_PHONES_SQL),
    "x7_x10_dates_amounts": (x_dates_amounts, X_DATES_SQL),
    "x11_x12_lists_interactions": (x_lists, X_LISTS_SQL),
    "x16_s7_json": (x_json, X_JSON_SQL),
    "s1_csv_scan": (s_csv, S_CSV_SQL),
    "s2_s3_text_files": (s_texts, S_TEXTS_SQL),
    "s5_log": (s_log, S_LOG_SQL),
    "s6_case_tables": (s_cases, S_CASES_SQL),
    "s8_registry": (s_registry, S_REGISTRY_SQL),
    "s9_s10_document_ids": (s_doc_ids, S_DOC_IDS_SQL),
    "s11_source_ranges": (s_ranges, S_RANGES_SQL),
    "s12_catalogue": (s_catalogue, S_CATALOGUE_SQL),
    "c1_c4_kinds_grading": (c_kinds, C_KINDS_SQL),
    "c5_warnings": (c_warnings, C_WARNINGS_SQL),
    "r2_quality": (r2_quality, R2_SQL),
    "e1_e4_calls": (e_facts(call_facts), f"WITH {CALLS_SQL} SELECT case_id, src, dst, type, ts, CAST(confidence AS DOUBLE) AS confidence, amount, seq FROM call_facts"),
    "e5_e6_transfers": (e_facts(transfer_facts), f"WITH {TRANSFERS_SQL} SELECT case_id, src, dst, type, ts, CAST(confidence AS DOUBLE) AS confidence, amount, seq FROM transfer_facts"),
    "e7_e10_social": (e_social, E_SOCIAL_SQL),
    "e11_e13_history": (e_history, f"WITH {HISTORY_SQL} SELECT case_id, src, dst, type, ts, CAST(confidence AS DOUBLE) AS confidence, basis, disposition, seq FROM history_facts"),
    "u1_merge_nodes": (u_nodes, U_NODES_SQL),
    "u2_merge_call_edges": (u_edges(call_facts), u_edges_sql(CALLS_SQL, "call_facts")),
    "u2_merge_transfer_edges": (u_edges(transfer_facts), u_edges_sql(TRANSFERS_SQL, "transfer_facts")),
    "u3_bounded_sources": (u_sources, U_SOURCES_SQL),
    "u5_rejects": (u_rejects, U_REJECTS_SQL),
    "u7_stale": (u_stale, U_STALE_SQL),
    "u8_ingest_summary": (u_summary, U_SUMMARY_SQL),
    "a1_volume_spikes": (a1, f"{CALL_EDGES_SQL}, {SPIKES_SQL} {TOLD} spikes"),
    "a2_handset_swaps": (lambda s, d: told(anomalies.handset_swaps(call_edges(s, d))), f"{CALL_EDGES_SQL}, {SWAPS_SQL} {TOLD} swaps"),
    "a3_one_way_accounts": (lambda s, d: told(anomalies.one_way_accounts(transfer_edges(s, d))), f"{TRANSFER_EDGES_SQL}, {ONE_WAY_SQL} {TOLD} one_way"),
    "a4_large_transfers": (lambda s, d: told(anomalies.large_transfers(event_payments(s, d))), f"{PAYMENTS_SQL}, {LARGE_SQL} {TOLD} large"),
    "a5_went_silent": (lambda s, d: told(anomalies.went_silent(order_contacts(s, d))), f"{CONTACTS_SQL}, {SILENT_SQL} {TOLD} silent"),
    "anomalies_ranked": (ranked_anomalies, RANKED_SQL),
}
