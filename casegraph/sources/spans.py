"""Rows of delimited files with the place of each in its file (X14, S1), read by as many tasks as the file has splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegraph.sources.shared import kept


def record_spans(spark: SparkSession, path: str, *, sep: str = ",") -> DataFrame:
    """CSV or TSV files -> (file, seq, start, end, one column for each of the header's): each row with its place in characters, its line break included, and the number of its first line, the header's being 0.

    A split knows where it starts, and the lines in it are counted there: characters, lines and quotes. Sums of these over the splits before (one row a split) say where each split's lines stand in the file, and
    whether its first line continues a quoted value. So no task reads a file whole, quoted values may run over lines and splits, and a row's lines are put together by its number. Blank lines are no rows but count for places.
    All files have the first one's header.
    """
    header = spark.read.csv(path, header=True, sep=sep, encoding="UTF-8", quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)
    # A byte order mark sticks to the first header.
    columns = [c.lstrip("﻿").strip() for c in header.columns]
    text = spark.read.option("lineSep", "\n").text(path)
    raw = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    told = raw.withColumns({"chars": F.length("line") + 1, "bytes": F.octet_length("line") + 1, "quotes": F.length("line") - F.length(F.translate("line", '"', ""))})
    inside = Window.partitionBy("file", "split").orderBy("at")
    so_far = lambda c: F.sum(c).over(inside) - F.col(c)
    lines = kept(told.withColumns({"before": so_far("chars"), "odd": so_far("quotes") % 2, "nth": F.row_number().over(inside) - 1}), "lines")

    # What each split adds, if it starts outside of quotes or within: rows begin at lines that stand outside.
    sums = lines.groupBy("file", "split").agg(
        F.sum("chars").alias("chars"), F.sum("bytes").alias("bytes"), F.max("size").alias("size"), F.sum("quotes").alias("quotes"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("odd") == 0).alias("outside"), F.count_if(F.col("odd") == 1).alias("within"),
    )
    along = Window.partitionBy("file").orderBy("split")
    earlier = lambda c: F.coalesce(F.sum(c).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sums.withColumn("carry", earlier("quotes") % 2)
    placed = placed.withColumn("starts", F.when(F.col("carry") == 0, F.col("outside")).otherwise(F.col("within")))
    everything = Window.partitionBy("file")
    placed = placed.select(
        "file", "split", "carry", earlier("chars").alias("chars_before"), earlier("n").alias("lines_before"), earlier("starts").alias("rows_before"),
        # The last line of a file may lack its break.
        (F.sum("bytes").over(everything) - F.col("size")).alias("lacks"), (F.sum("n").over(everything) - 1).alias("last"),
    )
    met = lines.drop("size").join(placed, ["file", "split"])
    outside = ((F.col("odd") + F.col("carry")) % 2 == 0).cast("long")
    met = met.withColumns({"line_no": F.col("lines_before") + F.col("nth"), "start": F.col("chars_before") + F.col("before"), "outside": outside})
    # A line that stands within quotes belongs to the row that began last.
    met = met.withColumn("row", F.col("rows_before") + F.sum("outside").over(inside))
    end = F.col("start") + F.col("chars") - F.when(F.col("line_no") == F.col("last"), F.col("lacks")).otherwise(0)
    rows = met.groupBy("file", "row").agg(
        F.min("line_no").alias("seq"), F.min("start").alias("start"), F.max(end).alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("raw")
    ).filter((F.col("row") > 1) & F.col("raw").rlike(r"\S"))
    schema = ", ".join(f"`c{i}` string" for i in range(len(columns)))
    options = {"sep": sep, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    parsed = rows.withColumn("r", F.from_csv(F.regexp_replace("raw", "\r$", ""), schema, options))
    return parsed.select("file", F.col("seq").cast("long").alias("seq"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), *(F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)))
