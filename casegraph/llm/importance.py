"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Tokens are lower-cased runs of word characters or of other visible characters. Unigrams and bigrams are hashed into ``buckets``; the raw model counts
all documents, the target model a bounded sample of rows labelled as good (the ``sample`` with the least hash of their doc_id). A
document's log importance weight is the sum over its n-grams of log target - log raw probability. Adding standard Gumbel noise (from a
hash of seed and doc_id) and taking the k largest draws k documents without replacement in proportion to their weights.

k is ``keep_share`` of the documents, by default the share of good rows among the labels. The k-th largest key is found exactly by counting
16 bits of it at a time, so no document list reaches the driver; rows tied with the k-th are all kept.

Defined results: null and empty texts have weight 0 and take part; without labels everything is kept; rows equal in id and text share
their key, hence their fate, and rows of one id (or none) with different texts are drawn each by its own key; an empty table gives an empty result; other columns are carried by ``keep_good``, ignored by ``weigh``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm.common import stash, table

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 1 << 14
SAMPLE = 20_000
SEED = 42


class _Known(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[token] = h = xxhash.xxh32_intdigest(token.encode("utf-8", "surrogatepass"))
        return h


def ngram_buckets(text: str | None, known: dict) -> np.ndarray:
    """Buckets of the text's unigrams and bigrams."""
    tokens = TOKEN.findall((text or "").lower())
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)
    return (np.concatenate([h, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def model(texts: DataFrame) -> np.ndarray:
    """Counts by bucket over all rows; each partition sends one row for each bucket it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, known = np.zeros(BUCKETS, np.int64), _Known()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen += np.bincount(ngram_buckets(text, known), minlength=BUCKETS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["b", "n"])

    counted = texts.select("text").mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS)
    out[counted["b"].to_numpy(np.int64)] = counted["n"].to_numpy()
    return out


def weigh(docs: DataFrame, good: DataFrame, *, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, log_weight, key): key is log_weight with Gumbel noise as a long in the same order."""
    target, raw = model(good) + 1.0, model(docs) + 1.0
    shared = docs.sparkSession.sparkContext.broadcast(np.log(target / target.sum()) - np.log(raw / raw.sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, known = shared.value, _Known()
        for batch in batches:
            weight = np.array([gain[ngram_buckets(t, known)].sum() for t in batch.column("text").to_pylist()], np.float64)
            ids = batch.column("doc_id").to_pylist()
            u = np.array([xxhash.xxh64_intdigest(f"{seed}/{i}".encode()) >> 11 for i in ids], np.float64)
            noisy = weight - np.log(-np.log((u + 0.5) / 2**53))
            bits = noisy.view(np.int64)
            key = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(weight), pa.array(key)], ["doc_id", "text_hash", "log_weight", "key"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, log_weight double, key long")


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest long of a column, exactly; null if there are fewer. Four counts of at most 2**16 groups each."""
    left, prefix = k, None
    for shift in (48, 32, 16, 0):
        part = df if prefix is None else df.filter(F.shiftright(column, shift + 16) == prefix)
        counts = part.groupBy(F.shiftright(column, shift).alias("b")).count().collect()
        for b, n in sorted(((r.b, r["count"]) for r in counts), reverse=True):
            if left <= n:
                prefix = b
                break
            left -= n
        else:
            return None
    return prefix


def good_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    ids = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id"), "left_semi")


def resampled(docs: DataFrame, labels: DataFrame, *, keep_share: float | None = None, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, log_weight, kept) per row."""
    weighed = stash(weigh(docs, good_sample(docs, labels, sample), seed=seed), "importance")
    if keep_share is None:
        keep_share = labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    k = weighed.count() if keep_share is None else round(keep_share * weighed.count())
    cut = kth_largest(weighed, "key", k) if k else None
    kept = F.lit(k > 0) if cut is None else F.col("key") >= cut
    return weighed.select("doc_id", "text_hash", "log_weight", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the resampling draws. A row is told by (doc_id, text), as ids may repeat or be null."""
    kept = resampled(docs, labels, **options).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["__id"]) & (F.xxhash64(docs["text"]) == kept["__hash"]), "left_semi")


def op1_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")
