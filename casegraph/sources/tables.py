"""Scans, sinks and the document registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegraph.functions.normalize import slug


def read_records(spark: SparkSession, path: str, *, sep: str = ",") -> DataFrame:
    """A CSV or TSV export, every column a trimmed string, missing values empty."""
    raw = spark.read.csv(
        path, header=True, sep=sep, encoding="UTF-8", multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True
    )
    # A byte order mark sticks to the first header.
    return raw.select(*(F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.lstrip("﻿").strip()) for c in raw.columns))


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer partitions than the cluster has cores (a file or two), dealt out over them before costly work on each row; a larger one as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), one row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """S3: (path, sha256 of the bytes, length)."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


def read_whole(spark: SparkSession, path: str, *, tasks_a_core: int = 8) -> DataFrame:
    """(path, text, sha256 of the bytes, length), one row for each file of all folders below, from one listing and one scan.

    A scan weighs each file like some megabytes and so makes a task of a few; very many small files are read by so many tasks a core instead.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    tasks = tasks_a_core * spark.sparkContext.defaultParallelism
    return files.coalesce(tasks).select("path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"), "length")


def text_documents(rows: DataFrame, kind: str = "note") -> DataFrame:
    """(case_id, filename, text) -> document rows; no file is touched."""
    return rows.select("case_id", "filename", F.lit(kind).alias("kind"), F.sha2("text", 256).alias("sha256"), F.length("text").alias("char_len"), "text")


def append_log(entries: DataFrame, path: str) -> None:
    """One JSON object a line."""
    entries.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_cases(table: DataFrame, path: str) -> None:
    """One folder for each case, so reading a case reads nothing of the others."""
    table.write.mode("overwrite").partitionBy("case_id").parquet(path)


def read_case(spark: SparkSession, path: str, case_id: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("case_id") == case_id)


def encode_attrs(attrs: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(attrs))))


def decode_attrs(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def register_documents(arrivals: DataFrame) -> DataFrame:
    """Arrivals (case_id, doc_id, filename, kind, sha256, char_len, ingested_at, seq) -> one row a document: first arrival time, other fields of the last."""
    last = [F.max_by(c, "seq").alias(c) for c in ("filename", "kind", "sha256", "char_len")]
    return arrivals.groupBy("case_id", "doc_id").agg(F.min("ingested_at").alias("ingested_at"), *last)


def document_ids(arrivals: DataFrame) -> DataFrame:
    """Arrivals (case_id, filename, sha256, seq) -> one row for each content, with its doc_id.

    The same bytes under any name are one document, named after the first arrival; contents whose names make the same slug are numbered.
    """
    first = arrivals.groupBy("case_id", "sha256").agg(F.min_by("filename", "seq").alias("filename"), F.min("seq").alias("seq"), F.count(F.lit(1)).alias("arrivals"))
    stem = slug(F.regexp_replace("filename", r"\.[^.]*$", ""))
    first = first.withColumn("stem", F.coalesce(F.nullif(stem, F.lit("")), F.lit("document")))
    k = F.row_number().over(Window.partitionBy("case_id", "stem").orderBy("seq"))
    number = F.when(F.col("k") > 1, F.concat(F.lit("_"), F.lpad(F.col("k").cast("string"), 3, "0"))).otherwise(F.lit(""))
    return first.withColumn("k", k).select("case_id", "sha256", F.concat(F.lit("doc:"), "stem", number).alias("doc_id"), "filename", "arrivals", "seq")


def source_ranges(citations: DataFrame, documents: DataFrame, *, padding: int = 160, cap: int = 4000) -> DataFrame:
    """Citations (doc_id, start, end) with the text around them; a missing range means the text's beginning."""
    start = F.greatest(F.coalesce(F.col("start"), F.lit(0)) - padding, F.lit(0))
    stop = F.coalesce(F.col("end") + padding, start + cap)
    excerpt = F.substring(F.col("text"), start + 1, F.least(stop - start, F.lit(cap)))
    return citations.join(documents.select("doc_id", "text"), "doc_id").withColumn("excerpt", excerpt).drop("text")


def case_catalogue(cases: DataFrame, counts: dict[str, DataFrame], questions: DataFrame, officer: str | None = None) -> DataFrame:
    """Cases with a row count for each table given, open questions, newest first."""
    out = cases if officer is None else cases.filter(F.col("officer") == officer)
    for name, df in counts.items():
        out = out.join(df.groupBy("case_id").agg(F.count(F.lit(1)).alias(name)), "case_id", "left")
    asked = questions.filter("kind = 'question' and status = 'open'").groupBy("case_id").agg(F.count(F.lit(1)).alias("open_questions"))
    return out.join(asked, "case_id", "left").na.fill(0, [*counts, "open_questions"]).orderBy(F.col("updated").desc(), "case_id")


def record_lines(texts: DataFrame, columns: list[str]) -> DataFrame:
    """CSV texts (case_id, doc_id, text) with these columns -> (case_id, doc_id, seq, start, end, the columns): each row with the place of its line in the text.

    ``read.csv`` keeps no place, so lines are cut here and parsed one by one; a quoted value can't run over a line. The first line is the header; blank lines are no rows but count for places.
    """
    at = Window.partitionBy("case_id", "doc_id").orderBy("line")
    lines = texts.select("case_id", "doc_id", F.posexplode(F.split("text", "(?<=\n)", -1)).alias("line", "raw")).filter("raw <> ''")
    lines = lines.withColumn("end", F.sum(F.length("raw")).over(at).cast("int")).withColumn("start", (F.col("end") - F.length("raw")).cast("int"))
    lines = lines.filter((F.col("line") > 0) & F.col("raw").rlike(r"\S")).withColumn("seq", F.col("line").cast("long"))
    schema = ", ".join(f"`c{i}` string" for i in range(len(columns)))
    row = F.from_csv(F.regexp_replace("raw", "[\r\n]+$", ""), schema, {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    return lines.withColumn("r", row).select("case_id", "doc_id", "seq", "start", "end", *(F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)))
