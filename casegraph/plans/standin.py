"""The given tables as case records: who calls whom, who pays whom, what was written. Values are spelled in several ways for the operators to undo."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.sources.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as call records: the user calls number k on handset k / 2 over tower k % 10."""
    e = spread(table(spark, sf_dir, "events")).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    number = F.concat(F.lit("98"), F.lpad(F.col("user_id").cast("string"), 8, "0"))
    spelled = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("+91 "), F.substring(number, 1, 5), F.lit(" "), F.substring(number, 6, 5)))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("0"), number))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit("091"), number))
        .otherwise(F.concat(F.substring(number, 1, 5), F.lit("-"), F.substring(number, 6, 5)))
    )
    return e.select(
        F.concat(F.lit("case_"), F.col("user_id") % 4).alias("case_id"), F.lit("doc:events").alias("doc_id"), F.col("event_id").alias("seq"),
        spelled.alias("A Party"), F.concat(F.lit("97"), F.lpad(F.col("k").cast("string"), 8, "0")).alias("b-party"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Call Time"), F.when(F.col("event_type") == "click", "SMS-MO").otherwise("VOICE").alias("call_type"),
        F.concat(F.lit("35000000000"), F.lpad(F.floor(F.col("k") / 2).cast("string"), 4, "0")).alias("imei"),
        F.concat(F.lit("Tower-"), F.col("k") % 10).alias("cell_id"), F.concat(F.lit("Mr. User "), F.col("user_id")).alias("subscriber"), F.col("value").cast("string").alias("duration"),
    )


def transfers_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders and lineitem as transfers from the customer to the supplier."""
    j = spread(table(spark, sf_dir, "lineitem")).join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    shape = lambda fmt: F.date_format("l_shipdate", fmt)
    date = F.when(F.col("l_linenumber") % 4 == 0, shape("yyyy-MM-dd")).when(F.col("l_linenumber") % 4 == 1, shape("dd/MM/yyyy")).when(F.col("l_linenumber") % 4 == 2, shape("d-MMM-yyyy")).otherwise(shape("dd-MM-yyyy HH:mm"))
    return j.select(
        F.concat(F.lit("case_"), F.col("o_custkey") % 4).alias("case_id"), F.lit("doc:lineitem").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.concat(F.lit(" C-"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")).alias("Debit Account"), F.concat(F.lit("S "), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("credit_account"),
        date.alias("value_date"), F.concat(F.lit("Rs. "), F.col("l_extendedprice").cast("string")).alias("amt"), F.concat(F.lit("Shri Customer "), F.col("o_custkey")).alias("remitter_name"), F.col("o_orderpriority").alias("channel"),
        F.concat(F.lit("Supplier "), F.col("l_suppkey")).alias("beneficiary"), F.concat(F.lit("BANK0"), F.lpad((F.col("l_orderkey") % 1000).cast("string"), 6, "0")).alias("ifsc-code"), F.col("l_orderkey").cast("string").alias("utr"),
    )


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as reports: (case_id, doc_id, kind, text). Keys are spelled in letters, so that names look like names."""
    name = lambda key: F.initcap(F.translate(F.lpad(key.cast("string"), 6, "0"), "0123456789", "abcdefghij"))
    k = F.col("c_custkey")
    text = F.concat(
        F.lit("FIR No: "), k, F.lit("/2024. Accused "), name(k), F.lit(" (mob. 98"), F.lpad(k.cast("string"), 8, "0"), F.lit(") was seen on "), F.lit("2024-03-05 at 10:30 with Shri "), name(k + 1),
        F.lit(", vehicle PB 10 AB "), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit(". A/C No. 1"), F.lpad(k.cast("string"), 11, "0"), F.lit(" at Punjab Trading Bank, 7/3/24; write to u"), k, F.lit("@example.com."),
    )
    return spread(table(spark, sf_dir, "customer")).select(F.concat(F.lit("case_"), k % 4).alias("case_id"), F.concat(F.lit("doc:r"), k).alias("doc_id"), F.lit("fir").alias("kind"), text.alias("text"))


#: The same records as canonical facts, for the SQL side.
CALLS_SQL = r"""
ev AS (SELECT 'case_' || (user_id % 4) AS case_id, event_id AS seq, date_trunc('second', CAST(ts AS TIMESTAMP)) AS ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
call_ends AS (SELECT *, 'phone:9198' || lpad(user_id::VARCHAR, 8, '0') AS caller, 'phone:9197' || lpad(k::VARCHAR, 8, '0') AS callee FROM ev),
call_facts AS (
  SELECT case_id, caller AS src, callee AS dst, CASE WHEN event_type = 'click' THEN 'MESSAGED' ELSE 'CALLED' END AS type, ts, 0.95 AS confidence, CAST(NULL AS DOUBLE) AS amount, seq FROM call_ends
  UNION ALL SELECT case_id, 'device:35000000000' || lpad((k // 2)::VARCHAR, 4, '0'), caller, 'REGISTERED_TO', NULL, 0.95, NULL, seq FROM call_ends
  UNION ALL SELECT case_id, caller, 'location:tower_' || (k % 10), 'LOCATED_AT', ts, 0.9, NULL, seq FROM call_ends
  UNION ALL SELECT case_id, 'person:user_' || user_id, caller, 'OWNS', NULL, 0.95, NULL, seq FROM call_ends)"""
TRANSFERS_SQL = r"""
tr AS (SELECT 'case_' || (o_custkey % 4) AS case_id, l_orderkey * 10 + l_linenumber AS seq, 'account:c_' || lpad(o_custkey::VARCHAR, 6, '0') AS src, 'account:s_' || lpad(l_suppkey::VARCHAR, 6, '0') AS dst,
  CASE WHEN l_linenumber % 4 = 3 THEN date_trunc('minute', CAST(l_shipdate AS TIMESTAMP)) ELSE date_trunc('day', CAST(l_shipdate AS TIMESTAMP)) END AS ts, l_extendedprice AS amount, o_custkey, l_suppkey, l_orderkey, o_orderpriority AS mode
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
transfer_facts AS (
  SELECT case_id, src, dst, 'TRANSFERRED_TO' AS type, ts, 0.95 AS confidence, amount, seq FROM tr
  UNION ALL SELECT case_id, 'person:customer_' || o_custkey, src, 'OWNS', NULL, 0.95, NULL, seq FROM tr
  UNION ALL SELECT case_id, 'person:supplier_' || l_suppkey, dst, 'OWNS', NULL, 0.95, NULL, seq FROM tr)"""
#: Merged edges of a table of facts.
EDGES_SQL = r"""
edges AS (SELECT case_id, src || '|' || type || '|' || dst || '|' || coalesce(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '') AS nat_key, any_value(src) AS src, any_value(dst) AS dst, any_value(type) AS type,
  any_value(ts) AS ts, max(confidence) AS confidence, arg_max(amount, seq) FILTER (amount IS NOT NULL) AS amount, count(*) AS facts FROM {facts} GROUP BY 1, 2)"""
PAIRS_SQL = r"""
pairs AS (SELECT case_id, least(src, dst) AS a, greatest(src, dst) AS b, CAST(count(*) AS DOUBLE) AS weight, count(*) AS n FROM edges GROUP BY 1, 2, 3),
both_ways AS (SELECT case_id, a AS u, b AS v, weight FROM pairs UNION ALL SELECT case_id, b, a, weight FROM pairs)"""
