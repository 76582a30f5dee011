"""Alignment of two tokenizers' ids over a corpus.

Both tokenizers encode each text; byte offsets where a token of A and one of B both end cut the tokens into groups, and the two tokens that end there are a
link. How often two ids are linked is counted over the whole corpus, and each document is told how good its own links are.

The fast path: an array gives for each id of A the id of B with the same bytes. A group of one token each whose ids the array pairs is only counted,
in a vector as long as A's vocabulary, one for each task. Only the pairs of other groups enter a shuffle, summed within each document first.

Texts are encoded once: each document's counts by id and by pair are written with what is known of it already, in the shared folder, and read
again when the corpus counts are known. Then the identity pairs' counts, and those of the ``top`` most frequent other pairs, are sent to every task, both of a fixed size; the remaining
pairs, which are all rarer than those, are looked up by a join. So no hot pair is ever a join key.

Defined results: null and empty texts, and texts that either tokenizer doesn't give back byte by byte, have no tokens (zeros, and '' for the groups); repeated rows
each count and give equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm.common import dealt, stash, table

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: How the byte-level vocabulary cuts a text before merging: a fixed value of that tokenizer.
CUTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pairs beside the identity pairs whose counts are sent to every task; characters of text encoded at a time.
TOP, BLOCK_CHARS = 1 << 16, 1 << 22
DOCUMENT = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "same array<int>, same_n array<int>, odd array<long>, odd_n array<int>"
)


def _byte_of_symbol() -> dict[str, int]:
    """The printable symbols that a byte-level vocabulary writes for bytes: bytes that print stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


@dataclass
class Vocabularies:
    """Both encoders, the bytes of each id, B's id for A's id (-1: none), and decimal ids with what follows them in the digest."""

    encode_a: object
    encode_b: object
    bytes_a: list[bytes]
    bytes_b: list[bytes]
    same: np.ndarray

    def __post_init__(self) -> None:
        self.len_a = np.array([len(x) for x in self.bytes_a])
        self.len_b = np.array([len(x) for x in self.bytes_b])
        texts = [f"{i}{after}" for n, pair in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for after in pair for i in range(n)]
        self.told = np.array(texts, object)


@lru_cache(maxsize=2)
def load(folder: str) -> Vocabularies:
    import sentencepiece
    import tiktoken

    symbol = _byte_of_symbol()
    with open(f"{folder}/{BYTE_BPE}", encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    ranks = {bytes(symbol[c] for c in text): i for text, i in vocabulary.items() if all(c in symbol for c in text)}
    # Ids are in the order of merging, so they serve as ranks.
    a = tiktoken.Encoding("a", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})
    bytes_a = [b""] * (max(ranks.values()) + 1)
    for text, i in ranks.items():
        bytes_a[i] = text
    b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECE_BPE}")
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    first = {}
    for i, text in enumerate(bytes_b):
        first.setdefault(text, i)
    same = np.array([first.get(text, -1) for text in bytes_a])
    return Vocabularies(lambda texts: [a.encode_ordinary(" " + t) for t in texts], lambda texts: b.encode(texts, num_threads=1), bytes_a, bytes_b, same)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.unique(keys, return_counts=True)
    return key, n.astype(np.int32)


NONE = (0, 0, 0, 0, "", np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32))


def align(v: Vocabularies, text: str, a: np.ndarray, b: np.ndarray) -> tuple:
    """What DOCUMENT lists from n_a on, for a text and its ids."""
    whole = b" " + text.encode()
    end_a, end_b = np.cumsum(v.len_a[a]), np.cumsum(v.len_b[b])
    if end_a[-1] != len(whole) or end_b[-1] != len(whole) or b"".join(map(v.bytes_a.__getitem__, a.tolist())) != whole or b"".join(map(v.bytes_b.__getitem__, b.tolist())) != whole:
        return NONE
    at = np.searchsorted(end_b, end_a)
    last_a = np.flatnonzero(end_b[at] == end_a)
    last_b = at[last_a]
    # A token's place in the digest: after all tokens of earlier groups, A's before B's.
    in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    place_a = np.arange(len(a)) + np.repeat(np.r_[0, last_b[:-1] + 1], in_a)
    place_b = np.arange(len(b)) + np.repeat(last_a + 1, in_b)
    told = np.empty(len(a) + len(b), np.int64)
    told[place_a], told[place_b] = a, b + 2 * len(v.len_a)
    told[place_a[last_a]] += len(v.len_a)
    told[place_b[last_b]] += len(v.len_b)
    digest = hashlib.sha256("".join(v.told[told].tolist())[:-1].encode()).hexdigest()
    link_a, link_b = a[last_a], b[last_b]
    same = (in_a == 1) & (in_b == 1) & (v.same[link_a] == link_b)
    odd = link_a[~same].astype(np.int64) << 32 | link_b[~same]
    return len(a), len(b), len(last_a), len(last_a), digest, *_counted(link_a[same].astype(np.int32)), *_counted(odd)


def aligned(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """DOCUMENT for each row; ``row`` tells rows apart once this is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(folder)
        types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = ["row", *(f.split()[0] for f in DOCUMENT.split(", ")[1:])]

        def told(at: int, stop: int, batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
            whole = [t for t in texts if t]
            ids = iter(zip(v.encode_a(whole), v.encode_b(whole), strict=True))
            rows = []
            for t in texts:
                if not t:
                    rows.append(NONE)
                    continue
                a, b = next(ids)
                rows.append(align(v, t, np.array(a, np.int64), np.array(b, np.int64)))
            columns = [pa.array(list(column), kind) for column, kind in zip(zip(*rows, strict=True), types, strict=True)]
            part = batch.slice(at, stop - at)
            return pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *columns], names)

        for batch in batches:
            at, size, texts = 0, 0, []
            for i, t in enumerate(batch.column("text")):
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if size >= BLOCK_CHARS:
                    yield told(at, i + 1, batch, texts)
                    at, size, texts = i + 1, 0, []
            if texts:
                yield told(at, batch.num_rows, batch, texts)

    narrow = dealt(docs).selectExpr("monotonically_increasing_id() row", "cast(doc_id as long) doc_id", "text")
    return narrow.mapInArrow(run, DOCUMENT)


def identity_counts(told: DataFrame, n_ids: int) -> DataFrame:
    """(a, n): how often each identity pair is linked, from a vector for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)
        for batch in batches:
            np.add.at(total, batch.column("same").flatten().to_numpy(), batch.column("same_n").flatten().to_numpy())
        a = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(total[a])], ["a", "n"])

    return told.select("same", "same_n").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))


def alignments(docs: DataFrame, *, folder: str = FOLDER, top: int = TOP) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per row of ``docs``."""
    spark = docs.sparkSession
    same = load(folder).same
    told = stash(aligned(docs, folder), "alignment-documents")
    one = stash(identity_counts(told, len(same)), "alignment-identity")
    exploded = told.select("row", F.explode(F.arrays_zip("odd", "odd_n")).alias("x")).select("row", F.col("x.odd").alias("pair"), F.col("x.odd_n").alias("n"))
    odd = stash(exploded.groupBy("pair").agg(F.sum("n").alias("n")), "alignment-pairs")
    # The most frequent count of each id of B, over both kinds of pairs: at most as many rows as B has ids.
    of_a = np.zeros(len(same), np.int64)
    for a, n in one.collect():  # at most as many rows as A has ids
        of_a[a] = n
    best = np.zeros(load(folder).len_b.size, np.int64)
    for b, n in odd.groupBy((F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))).alias("b")).agg(F.max("n")).collect():
        best[b] = n
    np.maximum.at(best, same[of_a > 0], of_a[of_a > 0])
    frequent = sorted((pair, n) for pair, n in odd.orderBy(F.desc("n"), "pair").limit(top).collect())
    sent = spark.sparkContext.broadcast(
        {"of_a": of_a, "best": best, "same": same, "pair": np.array([p for p, _ in frequent], np.int64), "n": np.array([n for _, n in frequent], np.int64)}
    )

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_a, best, same, pairs, counts = (sent.value[k] for k in ("of_a", "best", "same", "pair", "n"))
        is_best = of_a == best[same]  # where A has no such id, no link asks
        for batch in batches:
            n_docs = batch.num_rows

            def sums(name: str, values: np.ndarray, n_docs: int = n_docs, batch: pa.RecordBatch = batch) -> np.ndarray:
                cut = batch.column(name).offsets.to_numpy()
                total = np.r_[0, np.cumsum(values)]
                return total[cut[1:] - cut[0]] - total[cut[:-1] - cut[0]] if n_docs else np.zeros(0, np.int64)

            a, n = batch.column("same").flatten().to_numpy(), batch.column("same_n").flatten().to_numpy().astype(np.int64)
            n_best, count_sum = sums("same", n * is_best[a]), sums("same", n * of_a[a])
            pair, n = batch.column("odd").flatten().to_numpy(), batch.column("odd_n").flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            known = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            count = np.where(known, counts[at], 0) if len(pairs) else np.zeros(len(pair), np.int64)
            n_best += sums("odd", n * (known & (count == best[pair & 0xFFFFFFFF])))
            count_sum += sums("odd", n * count)
            rest = np.flatnonzero(~known)
            lost = sums("odd", (~known).astype(np.int64))
            cut = np.r_[0, np.cumsum(lost)].astype(np.int32)
            arrays = [
                batch.column("row"), pa.array(n_best), pa.array(count_sum),
                pa.ListArray.from_arrays(cut, pa.array(pair[rest])), pa.ListArray.from_arrays(cut, pa.array(n[rest])),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "n_best", "count_sum", "rare", "rare_n"])

    graded = told.select("row", "same", "same_n", "odd", "odd_n").mapInArrow(grade, "row long, n_best long, count_sum long, rare array<long>, rare_n array<long>")
    b_of = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    best_table = spark.createDataFrame(pa.table({"b": np.arange(len(best)), "best": best})) if len(best) else None
    rare = (
        graded.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.rare_n").alias("m"))
        .join(odd, "pair")
        .join(F.broadcast(best_table), b_of == F.col("b"))
        .groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("m")).otherwise(0)).alias("more_best"), F.sum(F.col("m") * F.col("n")).alias("more_sum"))
    )
    both = graded.select("row", "n_best", "count_sum").unionByName(rare.select("row", F.col("more_best").alias("n_best"), F.col("more_sum").alias("count_sum")))
    scores = both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return told.drop("same", "same_n", "odd", "odd_n").join(scores, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(table(spark, sf_dir, "documents"))
