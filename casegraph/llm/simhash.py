"""SimHash near-duplicate groups by multi-index hashing.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its 3-word shingles. Distinct fingerprints are the nodes, so
exact copies cost one node however many they are. Each 64-bit fingerprint is cut in two 32-bit segments: of two fingerprints at
most 3 bits apart, one segment differs in at most one bit. Every fingerprint is filed in a table under each of its segments,
and probes the table with the Hamming ball of radius 1 around each segment; what meets in a bucket is verified on all 64 bits.

A bucket over ``bucket_limit`` members is filed again by the quarters of the other segment (again with a ball of
radius 1), so that a bucket's table side never exceeds 2**16 distinct fingerprints; the probe side is streamed past it. A bucket returns a spanning
forest of its links, never its pairs. The links become groups in :mod:`components`.

Defined results: null or blank text has fingerprint zero, which links like any other; repeated rows share a fingerprint and
so a group; an empty table gives an empty result. A group's id is its smallest doc_id, nulls apart; a group with null ids only has a null
component_id. Columns other than doc_id and text are ignored. :mod:`near_copies` finds pairs further apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm.common import stash, table
from casegraph.llm.components import components

SHINGLE, RADIUS, SEED = 3, 3, 42
BUCKET_LIMIT = 4096
LOW32 = 0xFFFFFFFF


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text's bytes."""
    words = text.lower().split()
    if not words:
        return 0
    seqs = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in seqs), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 18):
        part = hashes[at : at + (1 << 18)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            prints = np.array([fingerprint(t or b"") for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(prints)], ["doc_id", "text_hash", "fp"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary"))
    return narrow.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, sub, role, fp) sorted so; role 0 is the table side. Emits edges that join what each bucket links."""
    bucket, table_side, parent = None, [], []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def meet(held: np.ndarray, probes: np.ndarray, out: list) -> None:
        for at in range(0, len(probes), step := max(1, (1 << 20) // len(held))):
            part = probes[at : at + step]
            near = np.bitwise_count(part[:, None] ^ held[None, :]) <= RADIUS
            near &= part[:, None] != held[None, :]
            rows, cols = np.nonzero(near)
            first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
            heads = cols[np.maximum.accumulate(np.where(first, np.arange(len(cols)), 0))] if len(rows) else cols
            out += zip(part[rows[first]].tolist(), held[cols[first]].tolist(), strict=True)
            if (~first).any():
                for a, b in set(zip(heads[~first].tolist(), cols[~first].tolist(), strict=True)):
                    ra, rb = find(a), find(b)
                    if ra != rb:
                        parent[max(ra, rb)] = min(ra, rb)
                        out.append((int(held[a]), int(held[b])))

    for batch in batches:
        if not batch.num_rows:
            continue
        key, sub, role, fp = (batch.column(i).to_numpy() for i in range(4))
        fp = fp.view(np.uint64)
        cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])])
        out: list = []
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=True):
            if (now := (key[lo], sub[lo])) != bucket:
                bucket, table_side, parent = now, np.zeros(0, np.uint64), []
            n = int(np.searchsorted(role[lo:hi], 1))
            if n:
                table_side = np.concatenate([table_side, fp[lo : lo + n]])
                parent = list(range(len(table_side)))
            if n < hi - lo and len(table_side):
                meet(table_side, fp[lo + n : hi], out)
        if out:
            ends = np.array(out, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def links(nodes: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Distinct (fp) -> (a, b): a spanning forest of the pairs at most 3 bits apart."""
    segment = [F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(LOW32)) + F.lit(1 << 32)]
    filed = nodes.select("fp", F.explode(F.array(*segment)).alias("key"))
    ball = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.col("key").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    probes = filed.select("fp", F.explode(ball).alias("key"))
    hits = probes.join(filed.select("key").distinct(), "key", "left_semi")
    # In its own bucket a fingerprint is both table and probe.
    met = stash(
        filed.select("key", F.lit(0).cast("byte").alias("role"), "fp")
        .union(filed.select("key", F.lit(1).cast("byte").alias("role"), "fp"))
        .union(hits.select("key", F.lit(1).cast("byte").alias("role"), "fp")),
        "simhash-buckets",
    )
    sizes = met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    met = met.join(sizes, "key")
    other = F.when(F.col("key") < F.lit(1 << 32), F.col("fp").bitwiseAND(F.lit(LOW32))).otherwise(F.shiftrightunsigned("fp", 32))
    quarter = [F.shiftrightunsigned(other, 16), other.bitwiseAND(F.lit(0xFFFF)) + F.lit(1 << 16)]
    hot = met.filter(F.col("n") > bucket_limit).withColumn("q", F.explode(F.array(*quarter)))
    flips = F.when(
        F.col("role") == 1,
        F.concat(F.array("q"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: F.col("q").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))),
    ).otherwise(F.array("q"))
    filed_twice = hot.select("key", F.explode(flips).alias("sub"), "role", "fp")
    plain = met.filter(F.col("n") <= bucket_limit).select("key", F.lit(-1).cast("long").alias("sub"), "role", "fp")
    return (
        plain.union(filed_twice)
        .repartition("key", "sub").sortWithinPartitions("key", "sub", "role")
        .mapInArrow(_forest, "a long, b long")
    )


def _rooted(prints: DataFrame, first: Column, bucket_limit: int) -> DataFrame:
    """(fp, first_id, root): ``first`` of the rows of each fingerprint, and its group."""
    nodes = prints.groupBy("fp").agg(first.alias("first_id"))
    linked = components(links(nodes.select("fp"), bucket_limit))
    return nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def groups(docs: DataFrame, *, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(doc_id, fp long, component_id) per row of ``docs``."""
    prints = stash(fingerprints(docs), "simhash-prints")
    rooted = _rooted(prints, F.min("doc_id"), bucket_limit)
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
