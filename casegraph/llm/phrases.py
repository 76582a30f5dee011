"""Phrases of words that stand together more often than their parts, by vertical partitioning of a suffix tree of words.

1. Words are counted by language. Words found ``min_count`` times get numbers, the most frequent at most ``NUMBERED`` of them: hash and count of each go to every task.
2. The suffix tree is cut in groups of prefixes whose suffixes together fit a memory budget (``budget`` suffixes). A word within the budget is a prefix,
   and words are packed until the budget is full. A word beyond it is extended by its next words, dealt by hash into as many groups as its count asks for; a pair of words that is itself beyond the budget
   (both its words are, so these pairs are few and counted by a scan) is extended by the third word in the same way.
3. Every task cuts its suffixes at three words, at the end of a piece and at words below ``min_count`` (no phrase with such a word can reach it), adds up equal ones and sends each
   group its share as one packed block. A group sorts its suffixes, which puts the subtree in order, and reads the counts of pairs and triples from the totals of its leaves. No group needs another.
4. Windows with a frequent word beyond the numbered ones, told by a Bloom filter of fixed size, are counted by their hashes in a plain aggregate. Where all frequent words have numbers there are none.

What is left are candidates, a small table, joined with the counts of their parts. Words are told by 64-bit hashes of language and word. Where the word counts show two words that share one,
all is done again with another seed (two that share one and stand in the same order in every block of text would not show).

Defined results: null and empty texts have no words; a null lang is ``und``; repeated rows count each time; an empty table gives an empty result; other columns are ignored. Ties are settled by the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegraph.llm.common import dealt, stash, table

MIN_COUNT, CONTAINED_PERCENT, TOP = 10, 50, 2000
BUDGET = 1 << 21
#: Three numbers fit a long.
BITS = 21
NUMBERED = (1 << BITS) - 2
#: Bits of the filter of other frequent words; bytes of text cut at a time; suffixes held before they are added up.
FILTER_BITS, BLOCK, HELD = 1 << 27, 1 << 22, 1 << 22
LOW = np.uint64((1 << BITS) - 1)
LONG_WORD = 64
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some texts in order: hash of language and word, piece, and place in ``joined``."""

    def __init__(self, texts: list[bytes], langs: list[str], seed: int) -> None:
        joined = b"\n".join([*texts, b" " * 8]).lower()
        kind = _KIND[np.frombuffer(joined, np.uint8)]
        word = np.r_[False, kind == 0, False]
        edge = np.flatnonzero(word[1:] != word[:-1])
        start, size = edge[::2], edge[1::2] - edge[::2]
        self.joined, self.start, self.size = joined, start, size
        self.piece = np.cumsum(kind == 2)[start] if len(start) else start
        of = {x: np.uint64(xxhash.xxh64_intdigest(x, seed)) for x in set(langs)}
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
        self.text = text
        h = _mixed(np.array([of[x] for x in langs], np.uint64)[text] + size.astype(np.uint64))
        eights = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))
        going = np.flatnonzero(size <= LONG_WORD)
        for done in range(0, LONG_WORD, 8):
            going = going[size[going] > done] if done else going
            if not len(going):
                break
            h[going] = _mixed(h[going] ^ (eights[start[going] + done] & _FIRST[np.minimum(size[going] - done, 8)]))
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            h[i] ^= np.uint64(xxhash.xxh64_intdigest(self.bytes_of(i), seed))
        self.hash = h

    def bytes_of(self, i: int) -> bytes:
        return self.joined[self.start[i] : self.start[i] + self.size[i]]


def _words(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[Words, list[str]]]:
    for batch in batches:
        langs, texts, size, at = batch.column("lang").to_pylist(), [], 0, 0
        for i, t in enumerate(batch.column("text")):
            texts.append(t.as_buffer().to_pybytes() if t.is_valid else b"")
            size += len(texts[-1])
            if size >= BLOCK or i + 1 == batch.num_rows:
                yield Words(texts, langs[at : i + 1], seed), langs[at : i + 1]
                texts, size, at = [], 0, i + 1


def count_words(texts: DataFrame, seed: int) -> DataFrame:
    """(lang, word, h, f)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs in _words(batches, seed):
            h, first, n = np.unique(words.hash, return_index=True, return_counts=True)
            said = [words.bytes_of(i) for i in first.tolist()]
            mine = [langs[i] for i in words.text[first].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(mine, pa.string()), pa.array(said, pa.binary()), pa.array(h.view(np.int64)), pa.array(n)], ["lang", "word", "h", "f"])

    counted = texts.mapInArrow(run, "lang string, word binary, h long, f long")
    return counted.groupBy("h", "lang", "word").agg(F.sum("f").alias("f")).select("lang", F.col("word").cast("string").alias("word"), "h", "f")


class Numbers:
    """The numbered words: their hashes, sorted (a word's number is its place from 1 on), and counts; a filter of the other frequent words."""

    def __init__(self, h: np.ndarray, f: np.ndarray, others: np.ndarray | None) -> None:
        order = np.argsort(h)
        self.h, self.f, self.others = h[order], f[order], others

    def of(self, h: np.ndarray) -> np.ndarray:
        """0 for words without a number."""
        if not len(self.h):
            return np.zeros(len(h), np.uint64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at + 1, 0).astype(np.uint64)

    def maybe(self, h: np.ndarray) -> np.ndarray:
        """False for words that are neither numbered nor frequent."""
        if self.others is None:
            return np.zeros(len(h), bool)
        bits = 64 * len(self.others)
        yes = np.ones(len(h), bool)
        for shift in (0, 32):
            at = (h >> np.uint64(shift)) % np.uint64(bits)
            yes &= (self.others[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return yes


def _filter_of(others: DataFrame, bits: int) -> np.ndarray:
    """The filter's longs. What reaches the driver doesn't exceed the filter's size."""
    probes = F.array(*(F.pmod(F.shiftrightunsigned("h", shift).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)), F.lit(bits)) for shift in (0, 32)))
    at = others.select(F.explode(probes).alias("at"))
    told = at.groupBy((F.col("at") / 64).cast("long").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask"))
    out = np.zeros(bits // 64, np.uint64)
    rows = told.toArrow()
    out[rows["slot"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return out


def number(frequent: DataFrame, limit: int, filter_bits: int) -> tuple[Numbers, DataFrame]:
    """Numbers for at most ``limit`` of the frequent words, the most frequent ones, and the table of the others."""
    step = F.floor(F.log2("f") * 64).cast("int")
    steps = sorted(((r.step, r.n) for r in frequent.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total = np.cumsum([n for _, n in steps])
    fits = int((total <= limit).sum())
    least = steps[fits - 1][0] if fits else (steps[0][0] + 1 if steps else 0)
    known = frequent.filter(step >= least).select("h", "f").toArrow()
    others = frequent.filter(step < least)
    filled = _filter_of(others, filter_bits) if fits < len(steps) else None
    return Numbers(known["h"].to_numpy().view(np.uint64), known["f"].to_numpy(), filled), others


class Groups:
    """Which group a suffix belongs to. ``first[id]`` and ``wide[id]``: the word's first group and over how many its suffixes are dealt; pairs beyond the budget likewise."""

    def __init__(self, f: np.ndarray, pairs: np.ndarray, pair_f: np.ndarray, budget: int) -> None:
        heavy = f > budget
        light = np.where(heavy, 0, f)
        packed = np.cumsum(light) // budget
        at = int(packed[-1]) + 1 if len(packed) else 0
        wide = np.where(heavy, -(-f // budget), 1)
        start = at + np.cumsum(np.where(heavy, wide, 0)) - wide
        self.first, self.wide = np.r_[0, np.where(heavy, start, packed)], np.r_[1, wide]
        at += int(wide[heavy].sum())
        self.pairs, self.pair_wide = pairs, -(-pair_f // budget)
        self.pair_first = at + np.cumsum(self.pair_wide) - self.pair_wide
        self.count = at + int(self.pair_wide.sum())

    def of(self, suffix: np.ndarray) -> np.ndarray:
        one, two, three = suffix >> np.uint64(2 * BITS), suffix >> np.uint64(BITS) & LOW, suffix & LOW
        group = self.first[one] + (_mixed(two) % self.wide[one].astype(np.uint64)).astype(np.int64)
        if len(self.pairs):
            pair = suffix >> np.uint64(BITS)
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            hot = np.flatnonzero(self.pairs[at] == pair)
            at = at[hot]
            group[hot] = self.pair_first[at] + (_mixed(three[hot]) % self.pair_wide[at].astype(np.uint64)).astype(np.int64)
        return group


def _packed(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which the shuffle's compression likes."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unpacked(data: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def heavy_pairs(texts: DataFrame, seed: int, sent, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words that are found more than ``budget`` times, and how often: at most one for each ``budget`` words of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: Numbers = sent.value
        heavy = np.r_[False, numbers.f > budget]
        for words, _ in _words(batches, seed):
            ids = numbers.of(words.hash)
            both = np.flatnonzero((words.piece[1:] == words.piece[:-1]) & heavy[ids[1:]] & heavy[ids[:-1]])
            pair, n = np.unique(ids[both] << np.uint64(BITS) | ids[both + 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(n)], ["pair", "n"])

    found = texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") > budget).orderBy("pair").toArrow()
    return found["pair"].to_numpy().view(np.uint64), found["n"].to_numpy()


def numbered_phrases(texts: DataFrame, seed: int, numbers: Numbers, budget: int, min_count: int) -> DataFrame:
    """(h1, h2, h3, a): pairs (h3 null) and triples of numbered words found ``min_count`` times, from the groups' subtrees."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(numbers)
    pairs, pair_f = heavy_pairs(texts, seed, sent, budget) if (numbers.f > budget).any() else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    groups = spark.sparkContext.broadcast(Groups(numbers.f, pairs, pair_f, budget))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            suffix, n = np.unique(np.concatenate(held), return_counts=True)
            group = groups.value.of(suffix)
            order = np.argsort(group, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0]) if len(group) else np.zeros(0, np.int64)
            parts = [order[lo:hi] for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True)]
            keys = [_packed(np.diff(suffix[p], prepend=np.uint64(0))) for p in parts]
            return pa.RecordBatch.from_arrays(
                [pa.array(group[order][cuts]), pa.array(keys, pa.binary()), pa.array([_packed(n[p].astype(np.uint32)) for p in parts], pa.binary())], ["g", "suffixes", "counts"]
            )

        held, size = [], 0
        for words, _ in _words(batches, seed):
            ids = np.r_[sent.value.of(words.hash), np.zeros(2, np.uint64)]
            piece = np.r_[words.piece, [-1, -2]]
            two = ids[1:-1] * (piece[1:-1] == piece[:-2])
            three = ids[2:] * (piece[2:] == piece[:-2])
            keep = (ids[:-2] > 0) & (two > 0)
            held.append((ids[:-2] << np.uint64(2 * BITS) | two << np.uint64(BITS) | three)[keep])
            size += len(held[-1])
            if size >= HELD:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    def subtree(blocks: pa.Table) -> pa.Table:
        suffix = np.concatenate([np.cumsum(_unpacked(x.as_py(), "<u8"), dtype=np.uint64) for x in blocks["suffixes"]])
        n = np.concatenate([_unpacked(x.as_py(), "<u4") for x in blocks["counts"]]).astype(np.int64)
        order = np.argsort(suffix, kind="stable")
        suffix, n = suffix[order], n[order]
        leaf = np.flatnonzero(np.r_[True, suffix[1:] != suffix[:-1]])
        leaf_key, leaf_n = suffix[leaf], np.add.reduceat(n, leaf)
        above = leaf_key >> np.uint64(BITS)
        node = np.flatnonzero(np.r_[True, above[1:] != above[:-1]])
        pair, pair_n = above[node], np.add.reduceat(leaf_n, node)
        # A pair dealt over several groups has been counted before.
        good = (pair_n >= min_count) & ~np.isin(pair, groups.value.pairs)
        pair, pair_n = pair[good], pair_n[good]
        good = (leaf_n >= min_count) & ((leaf_key & LOW) > 0)
        leaf_key, leaf_n = leaf_key[good], leaf_n[good]
        name = lambda ids: sent.value.h[ids.astype(np.int64) - 1].view(np.int64)
        h1 = np.r_[name(pair >> np.uint64(BITS)), name(leaf_key >> np.uint64(2 * BITS))]
        h2 = np.r_[name(pair & LOW), name(leaf_key >> np.uint64(BITS) & LOW)]
        h3 = pa.array(np.r_[np.zeros(len(pair), np.int64), name(leaf_key & LOW)], mask=np.arange(len(h1)) < len(pair))
        return pa.table({"h1": h1, "h2": h2, "h3": h3, "a": np.r_[pair_n, leaf_n]})

    schema = "h1 long, h2 long, h3 long, a long"
    found = texts.mapInArrow(deal, "g long, suffixes binary, counts binary").groupBy("g").applyInArrow(subtree, schema)
    if not len(pairs):
        return found
    name = lambda ids: numbers.h[ids.astype(np.int64) - 1].view(np.int64)
    known = pa.table({"h1": name(pairs >> np.uint64(BITS)), "h2": name(pairs & LOW), "h3": pa.nulls(len(pairs), pa.int64()), "a": pair_f})
    return found.unionByName(spark.createDataFrame(known).filter(F.col("a") >= min_count))


def other_phrases(texts: DataFrame, seed: int, numbers: Numbers, min_count: int) -> DataFrame:
    """(h1, h2, h3, a): the same for phrases with a frequent word that has no number."""
    sent = texts.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _ in _words(batches, seed):
            h = words.hash
            known = sent.value.of(h) > 0
            other = ~known & sent.value.maybe(h)
            fine = known | other
            for length in (2, 3):
                at = np.arange(max(0, len(h) - length + 1))
                ok = words.piece[at] == words.piece[at + length - 1]
                asks = np.zeros(len(at), bool)
                for k in range(length):
                    ok &= fine[at + k]
                    asks |= other[at + k]
                at = at[ok & asks]
                columns = [pa.array(h[at + k].view(np.int64)) if k < length else pa.nulls(len(at), pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.ones(len(at), np.int64))], ["h1", "h2", "h3", "a"])

    counted = texts.mapInArrow(run, "h1 long, h2 long, h3 long, a long").groupBy("h1", "h2", "h3").agg(F.sum("a").alias("a"))
    return counted.filter(F.col("a") >= min_count)


def _score(a: str, left: str, right: str) -> Column:
    """floor(1,000,000 a a / (l r)), exact: products of 16-digit counts fit 38 digits."""
    return F.expr(f"(cast({a} as decimal(16,0)) * cast({a} as decimal(16,0)) * 1000000) div (cast({left} as decimal(16,0)) * cast({right} as decimal(16,0)))")


def collocations(
    docs: DataFrame, *, min_count: int = MIN_COUNT, contained_percent: int = CONTAINED_PERCENT, top: int = TOP, budget: int = BUDGET, numbered: int = NUMBERED, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two or three words."""
    texts = dealt(docs).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    for seed in range(8):
        words = stash(count_words(texts, seed), "phrase-words")
        if not words.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
            break
    else:
        raise ValueError("words share hashes under every seed")
    frequent = words.filter(F.col("f") >= min_count)
    numbers, others = number(frequent, min(numbered, NUMBERED), filter_bits)
    found = numbered_phrases(texts, seed, numbers, budget, min_count)
    if numbers.others is not None:
        found = found.unionByName(other_phrases(texts, seed, numbers, min_count))
    found = stash(found, "phrase-counts")
    two = found.filter("h3 is null").select("h1", "h2", "a")
    three = found.filter("h3 is not null")
    parts = three.select("a", F.explode(F.array(F.struct("h1", "h2"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2")))).alias("x"))
    inside = parts.groupBy("x.h1", "x.h2").agg(F.max("a").alias("longer"))
    standing = two.join(inside, ["h1", "h2"], "left").filter(F.expr(f"longer is null or 100 * longer < {contained_percent} * a"))
    # The counts of a triple's two pairs: both are found as often at least, so they are in the table.
    cut = three.join(two.select("h1", "h2", F.col("a").alias("ab")), ["h1", "h2"]).join(two.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("bc")), ["h2", "h3"])
    last = F.coalesce("h3", "h2")
    both = standing.select("h1", "h2", F.lit(None).cast("long").alias("h3"), "a", F.lit(None).cast("long").alias("ab"), F.lit(None).cast("long").alias("bc")).unionByName(
        cut.select("h1", "h2", "h3", "a", "ab", "bc")
    ).withColumn("last", last)
    told = (
        both.join(frequent.select(F.col("h").alias("h1"), "lang", F.col("word").alias("w1"), F.col("f").alias("f1")), "h1")
        .join(frequent.select(F.col("h").alias("last"), F.col("word").alias("w3"), F.col("f").alias("f3")), "last")
        .withColumn("score1", F.when(F.col("h3").isNull(), _score("a", "f1", "f3")).otherwise(_score("a", "f1", "bc")))
        .withColumn("score2", F.when(F.col("h3").isNotNull(), _score("a", "ab", "f3")))
        .withColumn("later", F.coalesce(F.col("score2") < F.col("score1"), F.lit(False)))
        .select(
            "lang", "h2", "h3", "w1", "w3", "a",
            F.when(F.col("later"), F.col("ab")).otherwise(F.col("f1")).alias("l"),
            F.when(F.col("later") | F.col("h3").isNull(), F.col("f3")).otherwise(F.col("bc")).alias("r"),
            F.when(F.col("later"), F.col("score2")).otherwise(F.col("score1")).alias("score"),
        )
    )
    # Middle words are looked up only for what can be among the best: ties in score and count all stay.
    near = told.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).filter(F.col("place") <= top)
    spelled = near.join(frequent.select(F.col("h").alias("h2"), F.col("word").alias("w2")), "h2").withColumn(
        "phrase", F.when(F.col("h3").isNull(), F.concat_ws(" ", "w1", "w3")).otherwise(F.concat_ws(" ", "w1", "w2", "w3"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = spelled.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM starts, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
inside AS (SELECT lang, part, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM cand WHERE k = 3) GROUP BY 1, 2),
standing AS (SELECT c.* FROM cand c LEFT JOIN inside i ON i.lang = c.lang AND i.part = c.phrase WHERE NOT coalesce(c.k = 2 AND 100 * i.longer >= 50 * c.a, false)),
cuts AS (SELECT lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') AS lp, array_to_string(w[cut + 1:k], ' ') AS rp FROM standing, (SELECT unnest([1, 2]) AS cut) WHERE cut < k),
scored AS (SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.lp AND l.k = c.cut JOIN f r ON r.lang = c.lang AND r.phrase = c.rp AND r.k = c.k - c.cut),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM least JOIN n USING (lang) QUALIFY rank <= 2000"""
