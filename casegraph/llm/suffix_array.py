"""Suffix-array deduplication with longest-previous-factor arrays.

:mod:`repeats` brings every place where a string of ``window`` bytes can repeat to the shard of its anchor. A shard concatenates its different
segments in document order, sorts their suffixes by prefix doubling, takes the common prefixes of neighbours, and finds for each suffix
the nearest ones before and after it in suffix order that start earlier in the text (previous and next smaller
positions). The longer of the two common prefixes is the suffix's longest previous factor; one of ``window`` bytes or more is a later copy.

Removal takes each byte that a repeated window covers: of later copies (``keep_first``), or of all of them. Windows are judged on the
input, never on what is left, and never cross documents.

``op4_suffix_array`` judges strings of 400 bytes, as its contract asks. A passage of over 50 words can be shorter than that (a word of the given tables and its
space take 6.4 bytes), so the query also says how many bytes strings of 200 bytes that occur elsewhere cover. The longer strings are looked for only where
those cover 400 bytes in a row: every 400-byte string that starts elsewhere too lies in such a run.

Defined results: null text counts as empty; texts shorter than the window are returned unchanged; repeated rows (same id and text) are one
document and get the same result; an empty table gives an empty result; other columns are carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegraph.llm.common import stash, table
from casegraph.llm.repeats import Bytes, keyed, repeated_spans, with_spans

WINDOW, PASSAGE = 400, 200
SHARD_BYTES = 1 << 20


def _ranks(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values)
    ranked = values[order]
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(np.r_[0, ranked[1:] != ranked[:-1]])
    return out


def suffix_order(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``starts`` in order of their first ``depth`` bytes at least, and each one's common prefix with the one before (exact below ``depth``)."""
    n = len(text)
    padded = np.r_[text, np.zeros(8, np.uint8)].astype(np.uint64)
    eight = np.zeros(n, np.uint64)
    for j in range(8):
        eight = (eight << np.uint64(8)) | padded[j : j + n]
    levels, h = [(8, _ranks(eight))], 8
    at = lambda r, shift: np.r_[r[shift:], np.full(min(shift, n), -1, np.int64)][:n]
    while h * 2 <= depth:
        r = levels[-1][1]
        levels.append((h * 2, _ranks((r + 1) * (n + 1) + at(r, h) + 1)))
        h *= 2
    r = levels[-1][1]
    last = (r * (n + 2) + at(r, h) + 1)[starts]
    order = starts[np.argsort(last, kind="stable")]  # starts ascend
    i, j = order[1:], order[:-1]
    common = np.zeros(len(i), np.int64)
    for size, r in [levels[-1], *levels[::-1]]:
        a, b = i + common, j + common
        inside = (a < n) & (b < n)
        same = inside & (r[np.minimum(a, n - 1)] == r[np.minimum(b, n - 1)])
        common += np.where(same, size, 0)
    for size in (4, 2, 1):
        a, b = np.minimum(i + common, n - 1), np.minimum(j + common, n - 1)
        common += np.where(eight[a] >> np.uint64(64 - 8 * size) == eight[b] >> np.uint64(64 - 8 * size), size, 0)
    return order, np.r_[0, common]


def previous_factors(order: np.ndarray, common: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, longest previous factor, its earlier place) where that is ``threshold`` or more.

    Only runs of neighbours that share ``threshold`` can hold such a factor. In a run, one pass with a stack gives each
    suffix's previous smaller position, and gives itself as next smaller position to those it removes.
    """
    where, length, source = [], [], []
    linked = common >= threshold
    ends = np.flatnonzero(np.diff(np.r_[False, linked, False].astype(np.int8)))
    for lo, hi in zip((ends[::2] - 1).tolist(), ends[1::2].tolist(), strict=True):
        stack: list[tuple[int, int]] = []  # (position, common prefix with what follows so far)
        best: dict[int, tuple[int, int]] = {}
        for position, shared in zip(order[lo:hi].tolist(), common[lo:hi].tolist(), strict=True):
            if stack:
                top, least = stack[-1]
                stack[-1] = (top, min(least, shared))
            while stack and stack[-1][0] > position:
                gone, least = stack.pop()
                best[gone] = max(best.get(gone, (0, 0)), (least, position))
                if stack:
                    stack[-1] = (stack[-1][0], min(stack[-1][1], least))
            if stack:
                best[position] = max(best.get(position, (0, 0)), (stack[-1][1], stack[-1][0]))
            stack.append((position, 1 << 60))
        for position, (shared, earlier) in best.items():
            if shared >= threshold:
                where.append(position)
                length.append(shared)
                source.append(earlier)
    return tuple(np.array(x, np.int64) for x in (where, length, source))


def shard_flags(pieces: list[bytes], window: int, keep_first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Window starts to remove, in the concatenation of ``pieces``, and the places where the pieces begin."""
    text = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    begin = np.r_[0, np.cumsum(sizes)[:-1]]
    counts = sizes - window + 1
    starts = np.repeat(begin - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
    order, common = suffix_order(text, starts, window)
    where, _, source = previous_factors(order, common, window)
    flags = np.zeros(len(text), bool)
    flags[where] = True
    if not keep_first:
        # Every repeated string's first place is the source of its second.
        flags[source] = True
    return flags, begin


def matcher(window: int, keep_first: bool, shard_bytes: int = SHARD_BYTES):
    """Rows (key, __doc, at, lo, n, piece) sorted by key -> (__doc, start, end)."""

    def flush(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        flags, begin = shard_flags([r[3] for r in rows], window, keep_first)
        docs, starts, ends = [], [], []
        for (doc, lo, n, _), b in zip(rows, begin.tolist(), strict=True):
            edge = np.flatnonzero(np.diff(np.r_[False, flags[b : b + n], False].astype(np.int8)))
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                docs.append(doc)
                starts.append(lo + s)
                ends.append(lo + e + window - 1)
        return pa.RecordBatch.from_arrays([pa.array(docs, kind), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["__doc", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last, kind = [], 0, None, None
        for batch in batches:
            kind = batch.schema.field("__doc").type
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "__doc", "lo", "n", "piece")), strict=True):
                if key != last and size >= shard_bytes:
                    yield flush(held, kind)
                    held, size = [], 0
                last = key
                held.append(tuple(row))
                size += len(row[3])
        if held:
            yield flush(held, kind)

    return run


def byte_spans(docs: DataFrame, *, window: int = WINDOW, keep_first: bool = True, **limits) -> DataFrame:
    """keyed() docs -> (__doc, start, end) in bytes."""
    return repeated_spans(docs, Bytes, window, window // 2, matcher(window, keep_first), keep_first=keep_first, **limits)


def _on_characters(text: bytes, start: int, end: int) -> tuple[int, int]:
    """The largest part of the span that holds whole characters."""
    inside = lambda i: i < len(text) and text[i] & 0xC0 == 0x80
    while start < end and inside(start):
        start += 1
    while end > start and inside(end):
        end -= 1
    return start, end


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, keep_first: bool = True, **limits) -> DataFrame:
    """``docs`` with the repeated bytes cut from ``text`` (whole characters only), all columns kept."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in others), F.col("text").isNull().alias("__null")).alias("__carry"))
    key = keyed(packed, ("__carry",))

    def finish(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[str]:
        kept, at = [], 0
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            s, e = _on_characters(text, s, e)
            kept.append(text[at:s])
            at = e
        return ((b"".join(kept) + text[at:]).decode("utf-8", "replace"),)

    out = with_spans(key, byte_spans(key, window=window, keep_first=keep_first, **limits), finish, "text string", ("doc_id", "__carry"))
    text = F.when(~F.col("__carry")["__null"], F.col("text")).alias("text")
    return out.select(*(text if c == "text" else F.col("doc_id") if c == "doc_id" else F.col("__carry")[c].alias(c) for c in docs.columns))


def byte_digest(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, str]:
    left, at = hashlib.sha256(), 0
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        left.update(text[at:s])
        at = e
    left.update(text[at:])
    return len(text), int((ends - starts).sum()), len(starts), left.hexdigest()


def long_runs(spans: DataFrame, least: int) -> DataFrame:
    """(__doc, start, end): the maximal runs that the spans cover, of ``least`` or more."""
    by_start = Window.partitionBy("__doc").orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.distinct().withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(by_start))
    return runs.groupBy("__doc", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).filter(F.col("end") - F.col("start") >= least).select("__doc", "start", "end")


def digest(docs: DataFrame, *, window: int = WINDOW, passage: int = PASSAGE, **limits) -> DataFrame:
    """keyed() docs -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes."""
    passages = stash(byte_spans(docs, window=passage, keep_first=False, **limits), "passages")
    spans = byte_spans(docs, window=window, keep_first=False, regions=long_runs(passages, window), **limits)

    def finish(text: bytes, starts: np.ndarray, ends: np.ndarray, passage_starts: np.ndarray, passage_ends: np.ndarray) -> tuple:
        return *byte_digest(text, starts, ends), int((passage_ends - passage_starts).sum())

    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long"
    return with_spans(docs, spans, finish, schema, ("doc_id",), passages)


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(keyed(table(spark, sf_dir, "documents")))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 800)) AS g FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 399)) AS s FROM d)),
f AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY g) AS k FROM g) WHERE k > 1),
r AS (SELECT doc_id, s, coalesce(s - lag(s) OVER w > 400, true) AS new FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
n AS (SELECT doc_id, s, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM r),
p AS (SELECT doc_id, run, min(s) AS a, max(s) + 400 AS b, lag(max(s) + 400) OVER (PARTITION BY doc_id ORDER BY run) AS before,
        lead(min(s)) OVER (PARTITION BY doc_id ORDER BY run) AS after FROM n GROUP BY doc_id, run),
k AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
        string_agg(CASE WHEN before IS NULL THEN substr(h, 1, 2 * a) ELSE '' END || substr(h, 2 * b + 1, 2 * (coalesce(after, length(h) // 2) - b)), '' ORDER BY run) AS kept
      FROM p JOIN d USING (doc_id) GROUP BY doc_id),
pg AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 400)) AS g FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 199)) AS s FROM d)),
pf AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY g) AS k FROM pg) WHERE k > 1),
pp AS (SELECT doc_id, sum(least(200, coalesce(s - before, 200))) AS n_passage_bytes FROM (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM pf) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256, CAST(coalesce(n_passage_bytes, 0) AS BIGINT) AS n_passage_bytes
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN pp USING (doc_id)
"""
