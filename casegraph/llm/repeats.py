"""Routing of repeated text: which windows of the corpus can be equal, found without comparing documents.

A text is a run of units (bytes, or words). Each window of ``window`` units picks the ``anchor``-gram inside it with the least hash
(leftmost on ties). The pick depends on the window's content alone, so equal windows pick equal anchors at
equal offsets, and two windows can be equal only where their anchors meet. Neighbouring windows that pick the same
anchor form a segment; every window lies in exactly one. So the corpus shrinks to one narrow row for each segment (about
2 / (window - anchor + 2) of the units), and only those rows are shuffled:

1. anchors that occur once are dropped (a pre-aggregated count, then a join AQE may split);
2. segments equal in all their units are copies: the first stands for them, the others are done without reading text;
3. anchors with several different segments need a comparison: the segments' units are cut from the texts, once per
   different segment, and go to the shard of their anchor, where a matcher (suffix array or suffix automaton) compares them;
4. anchors with more than ``shard_limit`` different segments, which would make one task too large, are compared window by
   window through a hash of each window: exact as well, and spread over all tasks however hot the anchor is.

Rows of a group are met with what is known of the group in :func:`joined`: groups that hold over 1 / ``HOT_GROUPS`` of all rows, hence fewer than
``HOT_GROUPS`` of them, are broadcast, so the rows of a hot anchor or passage stay where they are.

Hashes of segments and windows combine one modulo 2**64 and one modulo 2**31 - 1, so that texts made to collide in the first (as
Thue-Morse words do under every base) differ in the second.

Spans of repeated windows come back as (__doc, start, end) in units. With ``regions`` only windows inside those parts of the texts count.

Documents are told apart by doc_id. Where ids repeat or are null, by (doc_id, text), null first: rows equal in both are one
document, and each gets its result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm.common import drop_stash, stash

BLOCK = 1 << 17  # units hashed at once
SHARD_LIMIT = 2000
HOT_GROUPS, HOT_ROWS = 256, 1000
_B = 0x9E3779B97F4A7C15 | 1
_IB = pow(_B, -1, 1 << 64)
#: Random but fixed values for the 256 bytes.
BYTE_VALUES = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)
_POSITION = np.uint64((1 << 31) - 1)
_P31 = (1 << 31) - 1
_B31 = 0x3C6EF372
_IB31 = pow(_B31, -1, _P31)


def fold31(x: np.ndarray) -> np.ndarray:
    """Congruent to x modulo 2**31 - 1, and under 2**34."""
    return (x & np.uint64(_P31)) + (x >> np.uint64(31))


def _powers31(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, _P31)) % np.uint64(_P31)
        have += more
    return out


class Powers:
    """Powers of the bases and of their inverses, modulo 2**64 and modulo 2**31 - 1, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)
    up31 = np.ones(1, np.uint64)
    down31 = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, BLOCK * 2)
            cls.up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, _B, np.uint64)])
            cls.down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, _IB, np.uint64)])
        return cls.up[:n], cls.down[:n]

    @classmethod
    def get31(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up31) < n:
            size = max(n, BLOCK * 2)
            cls.up31, cls.down31 = _powers31(_B31, size), _powers31(_IB31, size)
        return cls.up31[:n], cls.down31[:n]


def sums31(x: np.ndarray) -> np.ndarray:
    """Running sums of x[i] * base**i modulo 2**31 - 1, from 0; not reduced."""
    return np.r_[np.uint64(0), np.cumsum(fold31(fold31(fold31(x)) * Powers.get31(len(x))[0]))]


def pieces31(total: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The hash modulo 2**31 - 1 of each x[lo:hi]."""
    down = Powers.get31(len(total))[1]
    return (total[hi] - total[lo]) % np.uint64(_P31) * down[lo] % np.uint64(_P31)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class WordHashes(dict):
    """word -> XXH64, kept while it is small."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


class Bytes:
    """Texts as bytes."""

    kind = "bytes"

    def units(self, text: bytes) -> np.ndarray:
        return np.frombuffer(text, np.uint8)

    def values(self, units: np.ndarray) -> np.ndarray:
        return BYTE_VALUES[units]

    def cut(self, text: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
        return [text[a:b] for a, b in spans]


class Words:
    """Texts as words; a piece of text is its words joined by one space."""

    kind = "words"

    def __init__(self) -> None:
        self.known = WordHashes()

    def units(self, text: bytes) -> np.ndarray:
        words = text.split()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def values(self, units: np.ndarray) -> np.ndarray:
        return units

    def cut(self, text: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
        words = text.split()
        return [b" ".join(words[a:b]) for a, b in spans]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w``."""
    n = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def segments(x: np.ndarray, cuts: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of the pieces x[cuts[i]:cuts[i+1]]: first window, last window, anchor place (all in x), anchor hash, segment hash."""
    n = len(x)
    lengths = np.diff(cuts)
    if n < window or lengths.max() < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    up, down = Powers.get(n + 1)
    total = np.r_[np.uint64(0), np.cumsum(x * up[:n])]
    grams = mixed((total[anchor:] - total[:-anchor]) * down[: n - anchor + 1])
    least = sliding_min((grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64), window - anchor + 1)
    edge = np.zeros(n + 1, np.int32)
    long = lengths >= window
    np.add.at(edge, cuts[:-1][long], 1)
    np.add.at(edge, cuts[1:][long] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge[: len(least)]))
    picks = (least[starts] & _POSITION).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (picks[1:] != picks[:-1]) | (starts[1:] != starts[:-1] + 1)])
    lo, hi, at = starts[new], starts[np.r_[new[1:], len(starts)] - 1], picks[new]
    whole = (total[hi + window] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64) * np.uint64(_B)
    whole = mixed(whole ^ mixed(pieces31(sums31(x), lo, hi + window)))
    return lo, hi, at, grams[at], whole


def keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text as binary, __doc, an order-keeping key of the document, and ``carry``."""
    odd = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if odd.isEmpty():
        key = F.col("doc_id").cast("long")
    else:
        rank = F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63))))
        key = F.concat(F.coalesce(F.lpad(rank, 16, "0"), F.lit("")), F.lit("/"), F.hex(F.xxhash64("text")))
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), key.alias("__doc"), *carry)


def _texts(docs: DataFrame) -> DataFrame:
    """Each document once; only keys made for repeated ids can repeat."""
    texts = docs.select("__doc", "text")
    return texts if docs.schema["__doc"].dataType.simpleString() == "bigint" else texts.dropDuplicates(["__doc"])


def _blocks(units: Iterator[tuple[int, int, np.ndarray]], window: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int]], list[int]]]:
    """Packs texts, and tiles of long ones that overlap by a window less one, into blocks: units, [(row, first unit)], cuts."""
    held, rows, cuts = [], [], [0]
    for row, base, u in units:
        if len(u) < window:
            continue
        for at in range(0, len(u) - window + 1, BLOCK):
            tile = u[at : at + BLOCK + window - 1]
            if cuts[-1] and cuts[-1] + len(tile) > BLOCK + window:
                yield np.concatenate(held), rows, cuts
                held, rows, cuts = [], [], [0]
            held.append(tile)
            rows.append((row, base + at))
            cuts.append(cuts[-1] + len(tile))
    if held:
        yield np.concatenate(held), rows, cuts


def find_segments(docs: DataFrame, kind: type, window: int, anchor: int, regions: DataFrame | None = None) -> DataFrame:
    """(key, seg, __doc, at, lo, n): anchor hash, segment hash, and in units the anchor's place, the first window and the number of windows.

    ``regions`` (__doc, start, end) may overlap; documents without one are passed over.
    """

    some = regions is not None

    def parts(batch: pa.RecordBatch, reader) -> Iterator[tuple[int, int, np.ndarray]]:
        spans = batch.column("regions") if some else None
        for row, t in enumerate(batch.column("text")):
            units = reader.units(t.as_buffer() if reader.kind == "bytes" else t.as_py())
            if spans is None:
                yield row, 0, units
            else:
                start, stop = (x.to_numpy() for x in spans[row].values.flatten())
                for a, b in zip(*(x.tolist() for x in merged(start, stop)), strict=True):
                    yield row, a, units[a:b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = kind()
        for batch in batches:
            ids = batch.column("__doc")
            for units, rows, cuts in _blocks(parts(batch, reader), window):
                cuts = np.array(cuts)
                lo, hi, at, key, seg = segments(reader.values(units), cuts, window, anchor)
                if not len(lo):
                    continue
                piece = np.searchsorted(cuts, lo, "right") - 1
                row, first = np.array(rows).T[:, piece]
                shift = first - cuts[piece]
                cols = [pa.array(key.view(np.int64)), pa.array(seg.view(np.int64)), ids.take(pa.array(row))]
                cols += [pa.array((x).astype(np.int32)) for x in (at + shift, lo + shift, hi - lo + 1)]
                yield pa.RecordBatch.from_arrays(cols, ["key", "seg", "__doc", "at", "lo", "n"])

    kind_of_doc = docs.schema["__doc"].dataType.simpleString()
    texts = _texts(docs)
    if some:
        texts = texts.join(regions.groupBy("__doc").agg(F.collect_set(F.struct("start", "end")).alias("regions")), "__doc")
    return texts.mapInArrow(run, f"key long, seg long, __doc {kind_of_doc}, at int, lo int, n int")


def joined(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined to ``groups``, one row for each of ``keys`` with its number of rows in ``count``. ``total``: number of all rows.

    Groups above ``total / HOT_GROUPS`` rows are broadcast: there are fewer than ``HOT_GROUPS`` of them. Both sides are written tables, so AQE can split what is left.
    """
    limit = max(HOT_ROWS, total // HOT_GROUPS)
    hot = F.broadcast(groups.filter(F.col(count) > limit))
    if groups.filter(F.col(count) > limit).isEmpty():
        return rows.join(groups, keys)
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(groups.filter(F.col(count) <= limit), keys)
    return cold.unionByName(rows.join(hot, keys))


def _cut(docs: DataFrame, wanted: DataFrame, kind: type, window: int) -> DataFrame:
    """Adds ``piece``, a segment's units, to wanted (key, __doc, at, lo, n, n_segs)."""
    asked = wanted.groupBy("__doc").agg(F.collect_list(F.struct("key", "at", "lo", "n", "n_segs")).alias("asked"))
    doc_type = docs.schema["__doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = kind()
        for batch in batches:
            for text, doc, asks in zip(batch.column("text"), batch.column("__doc"), batch.column("asked"), strict=True):
                key, at, lo, n, n_segs = asks.values.flatten()
                spans = [(a, a + m + window - 1) for a, m in zip(lo.to_pylist(), n.to_pylist(), strict=True)]
                pieces = reader.cut(text.as_py(), spans)
                yield pa.RecordBatch.from_arrays(
                    [key, pa.array([doc.as_py()] * len(pieces), doc.type), at, lo, n, n_segs, pa.array(pieces, pa.binary())],
                    ["key", "__doc", "at", "lo", "n", "n_segs", "piece"],
                )

    return _texts(docs).join(asked, "__doc").mapInArrow(run, f"key long, __doc {doc_type}, at int, lo int, n int, n_segs long, piece binary")


def _window_hashes(pieces: DataFrame, kind: type, window: int) -> DataFrame:
    """(key, off, h, __doc, at, start) for every window of the pieces."""
    doc_type = pieces.schema["__doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = kind()
        for batch in batches:
            for i in range(batch.num_rows):
                key, doc, at, lo, n, piece = (batch.column(c)[i].as_py() for c in ("key", "__doc", "at", "lo", "n", "piece"))
                x = reader.values(reader.units(piece))
                up, down = Powers.get(len(x) + 1)
                total = np.r_[np.uint64(0), np.cumsum(x * up[: len(x)])]
                lows = np.arange(len(x) - window + 1)
                h = (total[window:] - total[:-window]) * down[: len(lows)]
                h = mixed(h ^ mixed(pieces31(sums31(x), lows, lows + window))).view(np.int64)[:n]
                start = np.arange(lo, lo + n, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, key, np.int64)), pa.array(at - start), pa.array(h), pa.array([doc] * n, batch.schema.field("__doc").type), pa.array(np.full(n, at, np.int32)), pa.array(start)],
                    ["key", "off", "h", "__doc", "at", "start"],
                )

    return pieces.mapInArrow(run, f"key long, off int, h long, __doc {doc_type}, at int, start int")


def repeated_spans(
    docs: DataFrame,
    kind: type,
    window: int,
    anchor: int,
    match: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    *,
    keep_first: bool,
    shard_limit: int = SHARD_LIMIT,
    regions: DataFrame | None = None,
    report: dict | None = None,
) -> DataFrame:
    """keyed() docs -> (__doc, start, end) of the windows to remove.

    With ``keep_first`` those that start earlier too, else those that start anywhere else too. ``match`` gets rows
    (key, __doc, at, lo, n, piece) sorted by key, __doc, at, and yields (__doc, start, end). ``report`` gets how many segments each path decides.
    """
    found = stash(find_segments(docs, kind, window, anchor, regions), "segments")
    twice = stash(found.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "anchors-repeated")
    total = twice.agg(F.sum("c")).first()[0] or 0
    again = stash(joined(found, twice, ["key"], "c", total).drop("c"), "segments-repeated")
    drop_stash(found)
    drop_stash(twice)
    place = F.struct("__doc", "at", "lo", "n")
    distinct = stash(again.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first")), "segments-distinct")
    copies = joined(again, distinct.filter("copies > 1"), ["key", "seg"], "copies", total)
    if keep_first:
        copies = copies.filter((F.col("__doc") != F.col("first.__doc")) | (F.col("at") != F.col("first.at")))
    end = lambda start, n: start + n + F.lit(window - 1)
    copy_spans = copies.select("__doc", F.col("lo").alias("start"), end(F.col("lo"), F.col("n")).alias("end"))

    several = stash(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n_segs")).filter("n_segs > 1"), "anchors-several")
    n_several = several.agg(F.sum("n_segs")).first()[0] or 0
    if report is not None:
        hot = several.filter(F.col("n_segs") > shard_limit).agg(F.sum("n_segs")).first()[0] or 0
        report |= {"segments of repeated anchors": total, "different": distinct.count(), "compared in shards": n_several - hot, "compared by window hashes": hot}
    wanted = joined(distinct, several, ["key"], "n_segs", n_several).select("key", "first.*", "n_segs")
    pieces = stash(_cut(docs, wanted, kind, window), "pieces")
    doc_type = docs.schema["__doc"].dataType.simpleString()
    matched = (
        pieces.filter(F.col("n_segs") <= shard_limit).select("key", "__doc", "at", "lo", "n", "piece")
        .repartition("key").sortWithinPartitions("key", "__doc", "at")
        .mapInArrow(match, f"__doc {doc_type}, start int, end int")
    )
    windows = _window_hashes(pieces.filter(F.col("n_segs") > shard_limit), kind, window)
    if pieces.filter(F.col("n_segs") > shard_limit).isEmpty():
        return copy_spans.union(matched)
    windows = stash(windows, "windows")
    same = stash(windows.groupBy("key", "off", "h").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("__doc", "at")).alias("first")).filter("c > 1"), "windows-repeated")
    hot = joined(windows, same, ["key", "off", "h"], "c", windows.count())
    if keep_first:
        hot = hot.filter((F.col("__doc") != F.col("first.__doc")) | (F.col("at") != F.col("first.at")))
    return copy_spans.union(matched).union(hot.select("__doc", "start", end(F.col("start"), F.lit(1)).alias("end")))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that the spans cover."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    return starts[new], ends[np.r_[np.flatnonzero(new)[1:] - 1, len(ends) - 1]]


def with_spans(docs: DataFrame, spans: DataFrame, finish: Callable, schema: str, carry: tuple[str, ...] = (), more: DataFrame | None = None) -> DataFrame:
    """Joins each document to its spans and yields finish(text, starts, ends) -> tuple of the ``schema`` columns, after the carried ones.

    With ``more``, spans of a second kind, finish gets their starts and ends too.
    """
    told, two = spans.withColumn("more", F.lit(False)), more is not None
    if two:
        told = told.union(more.withColumn("more", F.lit(True)))
    per_doc = told.groupBy("__doc").agg(F.collect_set(F.struct("start", "end", "more")).alias("spans"))
    joined = docs.join(per_doc, "__doc", "left").select(*carry, "text", "spans")
    names = [x.split()[0] for x in schema.split(", ")]
    empty = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                start, stop, second = (x.to_numpy(zero_copy_only=False) for x in spans.values.flatten()) if spans.is_valid else (empty, empty, empty > 0)
                ends = merged(start[~second], stop[~second])
                rows.append(finish(text.as_py() or b"", *ends, *(merged(start[second], stop[second]) if two else ())))
            cols = [pa.array(c) for c in zip(*rows, strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *cols], [*carry, *names])

    carried = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return joined.mapInArrow(run, ", ".join(x for x in (carried, schema) if x))
