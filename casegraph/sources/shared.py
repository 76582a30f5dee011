"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own where that is unset, as in tests. On a cluster executors would not see it, so there it must be set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    return f"{folder(spark)}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written and read again: cuts the lineage, and survives the loss of executors."""
    path = fresh(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a kept table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.kept_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` written in as many sorted buckets of ``keys`` as a shuffle has partitions: joins on them shuffle the other side only. Its files lie in the shared folder."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", fresh(spark, name)).format("parquet")
    writer.saveAsTable(name)
    out = spark.table(name)
    out.bucketed_name = name
    return out


def unbucketed(df: DataFrame) -> None:
    """Forget such a table and delete its files."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent() if df.inputFiles() else None
    spark.sql(f"DROP TABLE IF EXISTS {df.bucketed_name}")
    if where is not None:
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
