"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased, runs of ASCII white space become one space, and every character n-gram of 3 to 5 is hashed into 2**20 features; a feature is
present in a text or not. On the labelled sample each feature's log-count ratio is r = log((p + 1) / |p|) - log((q + 1) / |q|),
with p and q its counts in toxic and other texts. Features scaled by r enter a logistic regression with an L2 penalty. Features with
|r| under ``min_ratio`` or in under ``min_docs`` texts are left out: scaled, they would hardly count.

Labels are learned from a bounded sample: the ``sample`` labelled rows of the training folds with the least hash of their doc_id. Of their features those with the largest |r|
are fitted, as many as have ``entries`` entries together, which bounds what reaches the driver however long the texts are. Scores cover every character of every document.

Defined results: null and empty texts get the score of a text without features; without labels of both kinds every score is the smoothed share of
toxic labels (0.5 for none); labels that are null are ignored and a doc_id labelled twice counts twice; a null doc_id is not held out; repeated rows each get their row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm.common import stash, table

ORDERS = (3, 4, 5)
BITS = 20
SAMPLE = 20_000
MIN_RATIO, MIN_DOCS = 1.0, 3
#: Entries (features of texts) of the sample that are fitted at most: four bytes each on the driver.
ENTRIES = 1 << 24
THRESHOLD = 0.7


def grams(text: str | None) -> np.ndarray:
    """The features of every n-gram of the text, in places; repeats included."""
    x = np.frombuffer((" " + " ".join((text or "").lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    out, h, n = [], x, 1
    for order in range(2, max(ORDERS) + 1):
        if len(x) < order:
            break
        h = h[:-1] * np.uint32(0x01000193) + x[order - 1 :]
        if order in ORDERS:
            m = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)
            m = (m ^ (m >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            out.append(m >> np.uint32(32 - BITS))
        n = order
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def held_out(doc_id: Column | str) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """(text, y) of the bounded labelled sample. The sample's ids are at most ``sample``, so they may be broadcast."""
    ids = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("__id"), "__id", "y").limit(sample)
    )
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).select("text", "y")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            seen[int(y > 0), np.unique(grams(text))] += 1
    at = np.flatnonzero(seen.any(axis=0))
    for i in range(0, len(at), 1 << 16):
        part = at[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(seen[1, part]), pa.array(seen[0, part])], ["f", "p", "q"])


def fit(x_rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, penalty: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on features scaled by ``ratio``: weights of the unscaled features, and the intercept. Full-batch Adam, then done."""
    sizes = np.array([len(r) for r in x_rows])
    feature = np.concatenate(x_rows) if len(x_rows) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(x_rows)), sizes)
    value = ratio[feature]
    w, b = np.zeros(len(ratio)), 0.0
    m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, value * w[feature], len(y)) + b
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.r_[np.bincount(feature, value * error[row], len(ratio)) + penalty * w, error.sum()] / len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w * ratio, float(b)


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample: int = SAMPLE, entries: int = ENTRIES) -> tuple[np.ndarray, float]:
    """(weights of all features, intercept)."""
    rows = stash(training_rows(docs, labels, label, sample), "toxicity-sample")
    total, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("y")), F.lit(0))).first()
    weights = np.zeros(1 << BITS)
    if not 0 < toxic < total:
        return weights, float(np.log((toxic + 1) / (total - toxic + 1)))
    counted = rows.mapInArrow(_counts, "f int, p long, q long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    counted = stash(counted, "toxicity-counts")
    all_p, all_q = counted.agg(F.sum("p"), F.sum("q")).first()
    ratio = F.log((F.col("p") + 1) / F.lit(float(all_p))) - F.log((F.col("q") + 1) / F.lit(float(all_q)))
    chosen = counted.filter(F.col("p") + F.col("q") >= MIN_DOCS).withColumn("r", ratio).filter(F.abs("r") >= MIN_RATIO).toPandas()
    first = chosen.assign(size=chosen["r"].abs(), n=chosen["p"] + chosen["q"]).sort_values(["size", "f"], ascending=[False, True])
    chosen = first[first["n"].cumsum() <= entries].sort_values("f")
    place = np.full(1 << BITS, -1, np.int64)
    place[chosen["f"].to_numpy()] = np.arange(len(chosen))
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(x[x >= 0]) for x in (shared.value[grams(t)] for t in batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())), batch.column("y")], ["x", "y"])

    got = rows.mapInArrow(features, "x array<int>, y int").toPandas()
    w, b = fit([np.asarray(x, np.int32) for x in got["x"]], (got["y"].to_numpy() > 0).astype(float), chosen["r"].to_numpy())
    weights[chosen["f"].to_numpy()] = w
    return weights, b


def score(docs: DataFrame, weights: np.ndarray, intercept: float) -> DataFrame:
    """(doc_id, score) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            z = np.full(batch.num_rows, intercept)
            for i, text in enumerate(batch.column("text").to_pylist()):
                x = grams(text)
                z[i] += w[np.unique(x[w[x] != 0])].sum()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    weights, intercept = train(docs, labels, sample=sample)
    return score(docs, weights, intercept).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
