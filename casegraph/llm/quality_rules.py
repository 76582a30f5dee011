"""Quality rules with cross-document line frequency (DataFrame operations only).

Per document: counts of word characters, symbols, repeated lines and repeated 3-word windows. Per host:
every line is normalised and hashed, the distinct documents that hold it are counted, and a line in more than
``max(min_docs, max_share * documents of the host)`` documents is removed. A document of which less than
``min_left`` of the words remain is depleted and rejected, as is one that fails the base rules
(under 50 words, or over half of its words in repeated 3-word windows).

Documents are reduced to one narrow row (counts and line hashes) before anything is shuffled, line counts
are pre-aggregated on the map side, and only frequent lines are joined back.

Defined results: null text has no words and fails the base rules; lines without a word are ignored; a null host is a
host of its own; a repeated row counts as a document of its own; an empty table gives an empty result. Columns other
than doc_id, text and the host column are ignored by ``line_rules`` and kept by ``remove_frequent_lines``, which returns the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm.common import WORD, stash, table, words_of

SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line is frequent in over this many documents of its host ...
MIN_DOCS = 20
#: ... and in over this share of them.
MAX_SHARE = 0.01
#: The least share of a document's words that must remain.
MIN_LEFT = 0.2


def normal_line(line: Column) -> Column:
    """ASCII lower case, digit runs as 0, white space runs as one space, trimmed."""
    line = F.translate(line, UPPER, LOWER)
    line = F.regexp_replace(line, "[0-9]+", "0")
    return F.trim(F.regexp_replace(line, f"{SPACE}+", " "))


def describe(docs: DataFrame, host: str, *, hashed: bool = False) -> DataFrame:
    """A narrow row per document: the base counts, and its normalised lines as (hash, words); with ``hashed`` a hash of its text."""
    text = F.coalesce("text", F.lit(""))
    key = ["__hash"] if hashed else []
    docs = docs.withColumn("__hash", F.xxhash64(text)) if hashed else docs
    base = docs.select(
        "doc_id", *key,
        F.col(host).alias("__host"),
        words_of(text).alias("__words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias("__lines"),
        F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
    )
    windows = F.transform(
        F.col("__words"),
        lambda w, i: F.xxhash64(w, F.get(F.col("__words"), i + 1), F.get(F.col("__words"), i + 2)),
    )
    base = base.select(
        "doc_id", *key, "__host", "word_chars", "n_symbols",
        F.size("__words").cast("long").alias("n_words"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("__words") >= 3, F.slice(windows, F.lit(1), F.size("__words") - 2)).otherwise(F.array().cast("array<bigint>")).alias("__windows"),
        F.transform("__lines", lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("w"))).alias("__lines"),
    )
    # Only a text that repeats a window at all pays for the sort that finds where.
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    base = base.withColumn("__sorted", F.when(repeats, F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    found = F.filter(
        F.col("__sorted"),
        lambda x, j: same(x, F.get(F.col("__sorted"), j + 1)) | ((j > 0) & same(x, F.get(F.col("__sorted"), j - 1))),
    )
    covered = F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return base.select(
        "doc_id", *key, "__host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(F.when(F.col("__sorted").isNotNull(), F.size(covered)), F.lit(0)).cast("long").alias("n_repeat_words"),
        "__lines",
    )


def frequent_lines(told: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """(fh, fl): host and hash of the lines above the limits, of documents as :func:`describe` tells them."""
    once = told.select("__host", F.explode(F.array_distinct(F.transform("__lines", lambda x: x["h"]))).alias("h"))
    hosts = told.groupBy("__host").agg(F.greatest(F.lit(float(min_docs)), F.count(F.lit(1)) * F.lit(max_share)).alias("limit"))
    counts = once.groupBy("__host", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_docs)
    return (
        counts.alias("c").join(hosts.alias("g"), F.col("c.__host").eqNullSafe(F.col("g.__host")))
        .filter(F.col("n") > F.col("limit")).select(F.col("c.__host").alias("fh"), F.col("h").alias("fl"))
    )


def line_rules(
    docs: DataFrame, *, host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT
) -> DataFrame:
    """One row per document: the counts, base_failed, n_removed_words (words in frequent lines) and kept."""
    told = stash(describe(docs, host).withColumn("__row", F.monotonically_increasing_id()), "line-rules")
    lines = told.select("__row", "__host", F.explode("__lines").alias("x")).select("__row", "__host", F.col("x.h").alias("h"), F.col("x.w").alias("w"))
    frequent = frequent_lines(told, min_docs, max_share)
    removed = (
        lines.join(frequent, F.col("__host").eqNullSafe(F.col("fh")) & (F.col("h") == F.col("fl")))
        .groupBy("__row").agg(F.sum("w").alias("n_removed_words"))
    )
    base_failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return (
        told.drop("__lines").join(removed, "__row", "left")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= F.col("n_words") * F.lit(min_left)))
        .drop("__row", "__host")
    )


def remove_frequent_lines(
    docs: DataFrame, *, host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT
) -> DataFrame:
    """``docs`` without the frequent lines of their texts, and without the documents that ``line_rules`` rejects; all columns kept.

    A row is told by (doc_id, host, text). Lines without a word stay where they are.
    """
    told = stash(describe(docs.select("doc_id", host, "text"), host, hashed=True), "line-rules-texts")
    rejected = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    frequent = frequent_lines(told, min_docs, max_share)
    lines = told.select("doc_id", "__host", "__hash", F.explode("__lines").alias("x")).join(frequent, F.col("__host").eqNullSafe(F.col("fh")) & (F.col("x.h") == F.col("fl")))
    # Rows that repeat each other's key hold the same lines: the lengths of one of them are told by the distinct places.
    gone = lines.groupBy("doc_id", "__host", "__hash").agg(F.collect_set("x.h").alias("__gone"))
    base = told.select("doc_id", "__host", "__hash", "n_words", rejected.alias("__rejected"), "__lines").dropDuplicates(["doc_id", "__host", "__hash"])
    k = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & F.col(f"{a}.__host").eqNullSafe(F.col(f"{b}.__host")) & (F.col(f"{a}.__hash") == F.col(f"{b}.__hash"))
    cut = base.alias("b").join(gone.alias("g"), k("b", "g"), "left").select("b.doc_id", "b.__host", "b.__hash", "n_words", "__rejected", "__lines", F.coalesce("__gone", F.array().cast("array<bigint>")).alias("__gone"))
    lost = F.aggregate("__lines", F.lit(0).cast("long"), lambda n, x: n + F.when(F.array_contains("__gone", x["h"]), x["w"]).otherwise(F.lit(0)))
    kept = cut.filter(~F.col("__rejected") & (F.col("n_words") - lost >= F.col("n_words") * F.lit(min_left))).select("doc_id", "__host", "__hash", "__gone")
    keyed = docs.withColumns({"__hash": F.xxhash64(F.coalesce("text", F.lit(""))), "__host": F.col(host)})
    out = keyed.alias("d").join(kept.alias("t"), k("d", "t"))
    text = F.array_join(F.filter(F.split(F.col("d.text"), "\n", -1), lambda x: ~(x.rlike(WORD) & F.array_contains(F.col("t.__gone"), F.xxhash64(normal_line(x))))), "\n")
    return out.select(*(text.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in docs.columns))


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words"
    )


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
             coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
w AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
      FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
g AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM w) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM g, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
l AS (SELECT rid, source, line FROM (SELECT rid, source, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
u AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY rid),
m AS (SELECT rid, source, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w,
        trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM l),
h AS (SELECT source, greatest(20.0, count(*) * 0.01) AS lim FROM d GROUP BY source),
f AS (SELECT c.source, c.line FROM (SELECT source, line, count(DISTINCT rid) AS n FROM m GROUP BY source, line) c
      JOIN h ON c.source IS NOT DISTINCT FROM h.source WHERE n > lim),
x AS (SELECT m.rid, sum(w) AS gone FROM m JOIN f ON m.source IS NOT DISTINCT FROM f.source AND m.line = f.line GROUP BY m.rid),
t AS (SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(gone, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN r USING (rid) LEFT JOIN u USING (rid) LEFT JOIN x USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM t)
SELECT *, NOT base_failed AND n_words - n_removed_words >= n_words * 0.2 AS kept FROM b
"""
