from pyspark.sql import functions as F

from casegraph.plans.standin import calls_raw
from casegraph.streaming import ingest


def test_hourly_contacts_equal_the_batch(spark, sf_dir, tmp_path):
    raw = calls_raw(spark, sf_dir)
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in raw.schema)
    stream = ingest.hourly_contacts(ingest.call_facts(ingest.read_records(spark, str(tmp_path / "in"), schema)), late="60 days")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    want = ingest.hourly_contacts(ingest.call_facts(raw))
    key = lambda df: sorted(map(tuple, df.select("case_id", "node", F.col("hour").cast("string"), "n").collect()))
    assert key(spark.table("hours")) == key(want)
