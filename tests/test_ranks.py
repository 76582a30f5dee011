import random

import pytest
from pyspark.sql import functions as F

from casegraph.operators import anomalies, caselog, ranks


@pytest.mark.parametrize("partitions", [1, 7])
def test_places_within_groups(spark, partitions):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([1.5, 2.0, None, -3.0]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "case_id string, score double, id long").repartition(partitions)
    got = {(r.case_id, r.id): r["rank"] for r in ranks.numbered(df, ["case_id"], [F.col("score").desc(), F.col("id").asc()]).collect()}
    want = {}
    for case in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == case), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        want |= {(case, r[2]): k + 1 for k, r in enumerate(mine)}
    assert got == want


def test_places_of_an_empty_table(spark):
    assert ranks.numbered(spark.createDataFrame([], "case_id string, id long"), ["case_id"], [F.col("id").asc()]).count() == 0


def test_order_statistics(spark):
    rng = random.Random(2)
    groups = {"few": [3.0], "ties": [1.0] * 50 + [2.0] * 50, "wide": [10.0 ** rng.randint(-12, 12) * rng.choice([1, -1]) for _ in range(300)], "near": [1 + i * 2**-50 for i in range(200)], "some": [round(rng.gauss(0, 1000), 2) for _ in range(999)]}
    df = spark.createDataFrame([(g, x) for g, values in groups.items() for x in values] + [("few", None)], "g string, x double").repartition(5)
    asked = [(g, k) for g, values in groups.items() for k in {0, len(values) // 3, len(values) // 2, len(values) - 1}]
    got = {(r.g, r.k): r.x for r in ranks.kth_smallest(df, spark.createDataFrame(asked, "g string, k long"), ["g"], "x").collect()}
    assert got == {(g, k): sorted(groups[g])[k] for g, k in asked}


def test_large_transfers_use_the_exact_median(spark):
    rows = [("c", "a", "b", "TRANSFERRED_TO", None, float(x)) for x in (10, 20, 30, 40, 1000, 2000)] + [("d", "a", "b", "TRANSFERRED_TO", None, 5.0)] * 4
    got = anomalies.large_transfers(spark.createDataFrame(rows, "case_id string, src string, dst string, type string, ts timestamp, amount double")).collect()
    assert [(r.case_id, r.score, r.n) for r in got] == [("c", 57.14, 6)]


def chain(spark, n=6, cases="xy"):
    rows = [(c, i, "2024", "me", "ingest", None if i % 2 else f"doc:{i}", "ab") for c in cases for i in range(n)]
    return caselog.append(spark.createDataFrame(rows, "case_id string, position long, ts string, actor string, action string, ref string, payload_sha256 string"), spark.createDataFrame([], "case_id string, seq long, hash string"))


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ("seq > 1", (False, 1, "sequence gap")),
        ("seq not in (3, 5)", (False, 3, "sequence gap")),
        ("seq < 6", (True, None, None)),
        ("twice", (False, 4, "sequence gap")),
        ("relinked", (False, 4, "broken link")),
        ("altered first", (False, 1, "altered content")),
        ("two faults", (False, 2, "altered content")),
    ],
)
def test_the_first_break_of_a_chain(spark, change, want):
    whole = chain(spark)
    mine = F.col("case_id") == "y"
    at = lambda n: mine & (F.col("seq") == n)
    if change == "twice":
        bad = whole.union(whole.filter(at(3)))
    elif change == "relinked":
        fresh = whole.withColumn("prev_hash", F.when(at(4), F.lit("f" * 64)).otherwise(F.col("prev_hash")))
        bad = fresh.withColumn("hash", F.when(at(4), caselog.entry_hash(F.col("prev_hash"))).otherwise(F.col("hash")))
    elif change == "altered first":
        bad = whole.withColumn("actor", F.when(at(1), "other").otherwise(F.col("actor")))
    elif change == "two faults":
        bad = whole.withColumn("actor", F.when(at(2), "other").otherwise(F.col("actor"))).filter(~at(5))
    else:
        bad = whole.filter(~mine | F.expr(change))
    got = {r.case_id: (r.ok, r.broken_at, r.reason) for r in caselog.verify(bad.repartition(3)).collect()}
    assert got == {"x": (True, None, None), "y": want}
