import hashlib

import pytest
from pyspark.sql import functions as F

from casegraph import plans
from casegraph.functions import normalize as N
from casegraph.operators import edges, merge
from casegraph.sources import classify, tables


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_four_spellings_of_a_phone_are_one_id(spark):
    rows = spark.createDataFrame([("9876543210",), ("98765-43210",), ("+91 98765 43210",), ("09876543210",), ("091-9876543210",)], "p string")
    assert {r[0] for r in rows.select(N.node_id("phone", "p")).collect()} == {"phone:919876543210"}
    odd = spark.createDataFrame([("0161-2401234", "phone:1612401234"), ("12345", "phone:12345"), ("--", None), (None, None)], "p string, want string")
    for r in odd.select(N.node_id("phone", "p").alias("got"), "want").collect():
        assert r.got == r.want


@pytest.mark.parametrize(
    ("type_", "value", "want"),
    [
        ("person", "Late Shri. Ram  Kumar", "person:ram_kumar"),
        ("person", "Smt", None),
        ("vehicle", "PB 10-ab 1234", "vehicle:pb10ab1234"),
        ("document", "FIR 114/001", "doc:fir_114_001"),
        ("ship", "Titanic", None),
        ("organization", "Öl & Gas", "organization:l_gas"),
    ],
)
def test_node_ids(spark, type_, value, want):
    assert one(spark, a=N.node_id(type_, F.lit(value)), b=N.node_id(F.lit(type_), F.lit(value))) == (want, want)


@pytest.mark.parametrize(
    ("raw", "want"),
    [("2024-03-05T10:30:00", "2024-03-05 10:30:00"), ("5/3/2024 7:05", "2024-03-05 07:05:00"), ("05-03-2024", "2024-03-05 00:00:00"), ("5-Mar-2024", "2024-03-05 00:00:00"), ("2024-03-05T10:30:00+05:30", "2024-03-05 05:00:00"), ("2024-03-05 10:30:00.25", "2024-03-05 10:30:00"), ("2024", None), ("31/02/2024", None), ("", None), (None, None)],
)
def test_timestamps_never_become_now(spark, raw, want):
    assert one(spark, t=F.date_format(N.timestamp(F.lit(raw).cast("string")), "yyyy-MM-dd HH:mm:ss"))[0] == want


def test_amounts_dispositions_lists(spark):
    r = one(spark, a=N.amount(F.lit("Rs.5,000")), b=N.amount(F.lit("n/a")), c=N.disposition(F.lit("Chargesheeted")), d=N.disposition(F.lit("unclear")), e=N.split_list(F.lit("A B; C/D and E, ")))
    assert (r.a, r.b, r.c, r.d, r.e) == (5000.0, None, "pending", None, ["A B", "C", "D", "E"])


def test_labels(spark):
    rows = spark.createDataFrame([("phone", "98765-43210", 1), ("phone", "9876543210", 2), ("person", "Ram", 1), ("person", "Ram Kumar", 2), ("person", "Ram Kumor", 3)], "type string, label string, seq long")
    assert dict(rows.groupBy("type").agg(N.best_label("type", "label", "seq")).collect()) == {"phone": "9876543210", "person": "Ram Kumar"}


def test_gradings(spark):
    texts = [("Source report, grade B2", 0.85), ("reliability: F, credibility: 3. Intelligence report", 0.5), ("Intelligence input", 0.7), ("Observation report", 1.0)]
    rows = spark.createDataFrame(texts, "t string, want double").withColumn("k", classify.text_kind(F.col("t")))
    assert all(r.got == r.want for r in rows.select(classify.confidence_factor(F.col("k"), F.col("t")).alias("got"), "want").collect())


def raw_calls(spark, rows):
    return spark.createDataFrame([("c", "doc:x", i, *r) for i, r in enumerate(rows)], "case_id string, doc_id string, seq long, `A Party` string, `called-number` string, Date string, IMEI string")


def test_calls_and_idempotent_merge(spark):
    raw = raw_calls(spark, [("9876543210", "9876500000", "2024-01-01 10:00", "350000000000001"), ("+919876543210", "9876543210", "bad", ""), ("9876543210", "9876500000", "2024-01-01 10:00", None), ("", "9876500000", None, None)])
    facts = edges.calls(raw)
    assert {(r.type, r["count"]) for r in facts.groupBy("type").count().collect()} == {("CALLED", 2), ("REGISTERED_TO", 1)}
    merged = lambda f: sorted(map(tuple, merge.merge_edges(f).drop("facts", "bases").collect()), key=str)
    assert merged(facts) == merged(facts.union(facts).repartition(7))
    told = edges.quality(edges.canonical(raw, edges.CALL_COLUMNS), ("caller", "callee")).first()
    assert (told.rows_read, told.rows_dropped, told.bad_dates) == (4, 1, 1)


def test_sources_are_bounded_but_counted(spark):
    refs = spark.createDataFrame([("k", f"d{i % 30}", i, i + 1, i) for i in range(3000)], "key string, doc_id string, start int, end int, seq long")
    r = merge.bounded_sources(refs, ["key"]).first()
    assert len(r.sources) == 60 and r.source_count == 3000
    assert max(sum(s.doc_id == d for s in r.sources) for d in {s.doc_id for s in r.sources}) <= 3


def test_document_ids(spark):
    rows = [("c", "FIR 1.txt", "a", 1), ("c", "other.txt", "a", 2), ("c", "fir-1.pdf", "b", 3), ("c", "fir 1", "d", 4)]
    out = tables.document_ids(spark.createDataFrame(rows, "case_id string, filename string, sha256 string, seq long"))
    assert {r.sha256: r.doc_id for r in out.collect()} == {"a": "doc:fir_1", "b": "doc:fir_1_002", "d": "doc:fir_1_003"}


@pytest.mark.parametrize("name", ["u5_rejects", "u8_ingest_summary"])
def test_what_is_asked_of_merged_edges_merges_them_once(spark, sf_dir, name):
    assert not [f for f in plans.queries()[name](spark, sf_dir).inputFiles() if "lineitem" in f]


def test_edges_are_told_apart_by_the_second(spark):
    rows = [("c", "phone:1", "CALLED", "phone:2", f"2024-01-01 10:00:0{s}", s) for s in ("0", "0.5", "1")]
    facts = spark.createDataFrame(rows, "case_id string, src string, type string, dst string, at string, seq string").selectExpr(
        "case_id", "src", "type", "dst", "cast(at as timestamp) ts", "1D weight", "1D confidence", "cast(seq as double) amount", "1D duration_sec", "'b' basis", "'' offence", "'' disposition", "'d' doc_id", "1 seq"
    )
    assert sorted((r.nat_key[-8:], r.facts, r.amount) for r in merge.merge_edges(facts).collect()) == [("10:00:00", 2, 0.5), ("10:00:01", 1, 1.0)]


def test_many_small_files_are_read_whole_by_few_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"k={i}").mkdir()
        (tmp_path / f"k={i}" / "a.txt").write_bytes(f"é{i}\n".encode())
    found = tables.read_whole(spark, str(tmp_path), tasks_a_core=2)
    assert found.rdd.getNumPartitions() <= 8
    assert sorted(map(tuple, found.select("text", "sha256", "length").collect())) == sorted((t, hashlib.sha256(t.encode()).hexdigest(), len(t.encode())) for t in (f"é{i}\n" for i in range(300)))
