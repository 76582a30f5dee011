"""Benchmark decontamination by latent semantic retrieval.

Words (ASCII lower case, without punctuation) are hashed once and written as 32-bit ids; all later passes read those. Documents are cut into passages of
``PASSAGE`` words. A passage is a TF-IDF vector over hashed terms, with document frequencies counted over all passages and a weight above zero for every term.
A randomised SVD of all passages (with the benchmark items as further rows) is computed in one distributed pass: with A the matrix and G a fixed
Gaussian matrix, every task adds its share of A^T (A G), whose size does not depend on the corpus, and the driver turns the sum into right singular vectors V
(Nystrom form). The items' rows together weigh as much as all passages' rows, whatever the size of the corpus. Columns are the benchmark's terms: others can't add to a
product with an item, they count in the passages' lengths. The rank is below the number of items, so items and passages meet in directions that terms share, and not term by term.

Candidates are passages (now overlapping by half) whose cosine with an item, in the latent space and over the passage's whole length, reaches
``min_cosine``. A passage of which the benchmark's terms make up less than that share of the length can't reach it and is not projected.
The cosine finds most leaks (``guarantee=False`` shows what it finds alone), but not all: what is leaked often, or made of frequent words, weighs little. So each passage is also a candidate
for every item of which the words around it hold enough to pass the check: one that passes lacks at most ``n - need`` of the item's ``n`` words, so of any ``k`` of them
``k - (n - need)`` at least are there. ``k`` is chosen for each item by its terms' frequencies, which moves the cost and not the result.
No leak that the check would pass is missed, however often it or its words occur.
A candidate is checked on the words around it: contaminated is a longest common subsequence of ``min_lcs`` of the item's words, or of
``min_lcs_with_answer`` if the item's answer (its last ``ANSWER`` words) is there in order within the same region, which catches paraphrases.

The benchmark is taken in blocks of ``block`` items, each with a latent space of its own, so what is broadcast is bounded for any benchmark.

Defined results: null and empty texts match nothing; items that are null or have no word are ignored; an empty benchmark or an empty table gives an
empty result; repeated rows give one result, their pairs being equal; other columns are ignored, or carried by ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm.common import drop_stash, stash, table

PASSAGE, ANSWER = 64, 8
TERM_BITS = 17
RANK, OVERSAMPLE, BLOCK_ITEMS = 96, 8, 1000
MIN_COSINE, MIN_LCS, MIN_LCS_ANSWER = 0.25, 0.8, 0.6
#: How rarely a passage should hold the words asked for by chance.
RARE = 1e-4
#: The most frequent columns, taken as a dense product.
DENSE = 256
CHUNK_PASSAGES = 512
HALF = PASSAGE // 2
FOUND = "doc_id long, text_hash long, item_id long, lcs_share double, cosine double, has_answer boolean"
_LOG_TF = np.r_[0.0, 1 + np.log(np.arange(1, PASSAGE + 1))]


#: Bytes of text in lower case, and those that are dropped: ASCII but white space, letters, digits and underscores.
_LOWER = bytes(range(256)).lower()
_DROPPED = bytes(i for i in range(128) if not (i == 32 or 9 <= i <= 13 or i == 95 or chr(i).isalnum()))


#: Bytes of text hashed at a time; the longest word that is hashed eight bytes a step with all others.
HASH_BYTES, LONG_WORD = 1 << 21, 64
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: The first n bytes of a little-endian long.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _hash_words(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its words' hashes, all texts at once: eight bytes of every word a step."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    joined = b" ".join([*texts, b" " * 8])
    space = _SPACE[np.frombuffer(joined, np.uint8)]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not space[0]:
        starts = np.r_[0, starts]
    size = np.flatnonzero(~space[:-1] & space[1:]) + 1 - starts
    eights = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))
    h = _mixed(size.astype(np.uint64))
    going = np.flatnonzero(size <= LONG_WORD)
    for done in range(0, LONG_WORD, 8):
        going = going[size[going] > done] if done else going
        if not len(going):
            break
        h[going] = _mixed(h[going] ^ (eights[starts[going] + done] & _FIRST[np.minimum(size[going] - done, 8)]))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(joined[starts[i] : starts[i] + size[i]], 10)
    return np.split((_mixed(h) >> np.uint64(32)).astype(np.uint32), np.searchsorted(starts, ends[:-1]))


def word_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of the text's words, less punctuation, in ASCII lower case."""
    return _hash_words([(text or b"").translate(_LOWER, _DROPPED)])[0]


def terms_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint32(32 - TERM_BITS)).astype(np.int32)


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, words): the words' hashes, four bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, held, size = [], [], 0
            for t in batch.column("text"):
                held.append((t.as_buffer().to_pybytes() if t.is_valid else b"").translate(_LOWER, _DROPPED))
                size += len(held[-1])
                if size >= HASH_BYTES:
                    words += [w.tobytes() for w in _hash_words(held)]
                    held, size = [], 0
            words += [w.tobytes() for w in _hash_words(held)] if held else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(words, pa.binary())], ["doc_id", "text_hash", "words"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary"))
    return narrow.mapInArrow(run, "doc_id long, text_hash long, words binary")


def _words(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(w, np.uint32) for w in batch.column("words").to_pylist()]


def _passages(terms: np.ndarray, step: int) -> np.ndarray:
    """Rows of PASSAGE terms every ``step`` (PASSAGE or half of it) places, the last filled up with -1."""
    parts = max(1, -(-len(terms) // step))
    grid = np.full((parts, step), -1, np.int32)
    grid.ravel()[: len(terms)] = terms
    if step == PASSAGE:
        return grid
    if parts == 1:
        return np.hstack([grid, np.full_like(grid, -1)])
    return np.hstack([grid[:-1], grid[1:]])


def _chunks(texts: Iterator[np.ndarray], step: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int]]]]:
    """Texts as passages: rows of sorted terms, and for each its (text, first word)."""
    held, where = [], []
    for row, words in enumerate(texts):
        if not len(words):
            continue
        rows = _passages(terms_of(words), step)
        for at in range(0, len(rows), CHUNK_PASSAGES):
            part = rows[at : at + CHUNK_PASSAGES]
            held.append(part)
            where += [(row, (at + i) * step) for i in range(len(part))]
            if len(where) >= CHUNK_PASSAGES:
                yield np.sort(np.concatenate(held), axis=1), where
                held, where = [], []
    if where:
        yield np.sort(np.concatenate(held), axis=1), where


def _entries(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (passage, term) of sorted rows, with how often each occurs."""
    new = rows >= 0
    new[:, 1:] &= rows[:, 1:] != rows[:, :-1]
    at = np.flatnonzero(new.ravel())
    passage = at // PASSAGE
    return passage, rows.ravel()[at], np.minimum(np.r_[at[1:], rows.size], (passage + 1) * PASSAGE) - at


def _weights(passage: np.ndarray, term: np.ndarray, tf: np.ndarray, idf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF weights over the passage's length, and the lengths."""
    w = idf[term] * _LOG_TF[tf]
    length = np.sqrt(np.bincount(passage, w * w, n))
    return (w / np.maximum(length, 1e-9)[passage]).astype(np.float32), length


def _add_sums(key: np.ndarray, rows: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Adds rows to out[key], key ascending."""
    if len(key):
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        out[key[at]] += np.add.reduceat(rows, at, axis=0)
    return out


def _project(passage: np.ndarray, column: np.ndarray, w: np.ndarray, n: int, matrix: np.ndarray, add_to: np.ndarray | None = None) -> np.ndarray:
    """X @ matrix, with X the ``n`` passages' weights by column; adds X^T (X @ matrix) to ``add_to``. The first ``DENSE`` columns are most entries and go as a dense product."""
    often = column < DENSE
    x = np.zeros((n, min(DENSE, len(matrix))), np.float32)
    x[passage[often], column[often]] = w[often]
    y = x @ matrix[:DENSE]
    passage, column, w = passage[~often], column[~often], w[~often]
    _add_sums(passage, matrix[column] * w[:, None], y)
    if add_to is not None:
        add_to[:DENSE] += x.T @ y
        order = np.argsort(column)
        _add_sums(column[order], y[passage[order]] * w[order, None], add_to)
    return y


def passage_frequencies(words: DataFrame) -> tuple[np.ndarray, int]:
    """How many passages hold each term, and the number of passages, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << TERM_BITS, np.int64), 0
        for batch in batches:
            for rows, where in _chunks(iter(_words(batch)), PASSAGE):
                new = rows >= 0
                new[:, 1:] &= rows[:, 1:] != rows[:, :-1]
                seen += np.bincount(rows[new], minlength=1 << TERM_BITS)
                n += len(where)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[n, seen[at]])], ["term", "n"])

    counted = words.select("words").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << TERM_BITS)
    terms, counts = counted["term"].to_numpy(), counted["n"].to_numpy()
    out[terms[terms >= 0]] = counts[terms >= 0]
    return out, int(counts[terms < 0].sum())


def latent_space(words: DataFrame, items: np.ndarray, vocabulary: np.ndarray, idf: np.ndarray, *, rank: int) -> np.ndarray:
    """Right singular vectors (terms of the vocabulary x at most ``rank``) of all passages and the items, which weigh as much together as the passages do."""
    v, width = items.shape[1], rank + OVERSAMPLE
    shared = words.sparkSession.sparkContext.broadcast((vocabulary, idf))

    def test_matrix() -> np.ndarray:
        return np.random.default_rng(42).standard_normal((v, width)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, idf = shared.value
        g, z, energy = test_matrix(), np.zeros((v, width), np.float32), 0.0
        for batch in batches:
            for rows, where in _chunks(iter(_words(batch)), PASSAGE):
                passage, term, tf = _entries(rows)
                w, _ = _weights(passage, term, tf, idf, len(where))
                column = vocabulary[term]
                use = np.flatnonzero(column >= 0)
                passage, column, w = passage[use], column[use], w[use]
                energy += float(w @ w)
                _project(passage, column, w, len(where), g, z)
        at = np.flatnonzero(z.any(axis=1))
        parts = [np.float64(energy).tobytes(), *(z[i].tobytes() for i in at)]
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(parts, pa.binary())], ["row", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, part in zip(batch.column("row").to_pylist(), batch.column("part").to_pylist(), strict=True):
                x = np.frombuffer(part, np.float64 if row < 0 else np.float32).astype(np.float64)
                total[row] = total[row] + x if row in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["row", "part"])

    z, energy = np.zeros((v, width)), 0.0
    summed = words.select("words").mapInArrow(run, "row int, part binary").repartition("row").mapInArrow(add, "row int, part binary")
    for row, part in summed.collect():
        if row < 0:
            energy = float(np.frombuffer(part, np.float64)[0])
        else:
            z[row] = np.frombuffer(part, np.float64)
    g = test_matrix().astype(np.float64)
    own = float((items**2).sum())
    z += (energy / own if energy > 0 and own > 0 else 1.0) * (items.T @ (items @ g))
    core = g.T @ z
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > value.max() * 1e-7 if value.max() > 0 else value > 0
    if not good.any():
        return np.zeros((v, 1), np.float32)
    u, s, _ = np.linalg.svd(z @ (vector[:, good] / np.sqrt(value[good])), full_matrices=False)
    return u[:, : min(rank, int((s > s[0] * 1e-5).sum()))].astype(np.float32)


def common_subsequence(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence of an item (its words' bit masks) and ``words``."""
    full = (1 << n) - 1
    row = full
    for w in words:
        if m := masks.get(w):
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def bit_masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def required_terms(words: list[np.ndarray], share: np.ndarray, least: float) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """What a region must hold of each item so that a share of ``least`` of the item's words can be there in order.

    (column of each term or -1, for l = 1, 2, ... whether an item asks for l of a term (columns x items), how many of the asked-for words must be there, reach in half passages).
    """
    asked, needs = [], []
    for ws in words:
        n = len(ws)
        spare = n - int(np.ceil(n * least - 1e-9))
        order = terms_of(ws)[np.argsort(share[terms_of(ws)], kind="stable")]
        chance = np.cumsum(share[order]) * (2 * PASSAGE + 2 * n) / PASSAGE + 1e-9
        k = np.arange(spare + 1, n + 1)
        if not len(k):
            asked.append(order)
            needs.append(0)
            continue
        r, mean = k - spare, chance[k - 1]
        # How unlikely chance makes it that r of these words are there: as few words as do, since each costs work.
        score = np.where(r > mean, r * np.log(r / mean) - r + mean, r / mean - 1)
        enough = np.flatnonzero(score >= -np.log(RARE))
        best = int(enough[0] if len(enough) else np.argmax(score))
        asked.append(order[: k[best]])
        needs.append(int(r[best]))
    terms = np.unique(np.concatenate(asked))
    column = np.full(1 << TERM_BITS, -1, np.int32)
    column[terms] = np.arange(len(terms))
    counts = np.zeros((len(terms), len(words)), np.int32)
    for i, t in enumerate(asked):
        np.add.at(counts[:, i], column[t], 1)
    levels = [(counts >= level).astype(np.uint8) for level in range(1, min(HALF, int(counts.max())) + 1)]
    return column, levels, np.array(needs), np.array([-(-len(ws) // HALF) for ws in words])


def _holding(texts: list[np.ndarray], required: tuple) -> dict[tuple[int, int], list[int]]:
    """(text, first word) of each passage around which enough of an item's words are -> the items.

    Half passages are rows, with blank rows between texts, and items are columns in order of their reach. What a region holds is a difference of running sums
    (modulo 2**16, which differences under it don't feel).
    """
    column, levels, needs, reach = required
    order = np.argsort(reach, kind="stable")
    needs, reach = needs[order], reach[order]
    # Eight items are summed in one long, each in a byte: a half passage holds no more than HALF words of an item.
    wide = -(-len(order) // 8) * 8
    levels = [np.hstack([x[:, order], np.zeros((len(x), wide - len(order)), np.uint8)]).view(np.uint64) for x in levels]
    halo, out = int(reach.max()), {}
    blank = np.full((halo + 1, HALF), -1, np.int32)
    cuts = [*np.flatnonzero(np.r_[True, reach[1:] != reach[:-1]]).tolist(), len(reach)]

    def look(grids: list[np.ndarray], where: list[tuple[int, tuple[int, int, int]]]) -> None:
        grid = np.sort(np.concatenate([blank, *grids, blank]), axis=1)
        text, place = np.full(len(grid), -1), np.zeros(len(grid), np.int64)
        for row, (t, first, n) in where:
            text[row : row + n], place[row : row + n] = t, np.arange(first, first + n)
        new = grid >= 0
        new[:, 1:] &= grid[:, 1:] != grid[:, :-1]
        at = np.flatnonzero(new.ravel())
        half = at // HALF
        tf = np.minimum(np.r_[at[1:], grid.size], (half + 1) * HALF) - at
        col = column[grid.ravel()[at]]
        held = np.zeros((len(grid) + 1, wide), np.uint16)
        for level, wanted in enumerate(levels, 1):
            use = np.flatnonzero((col >= 0) & (tf >= level))
            if not len(use):
                break
            rows = half[use]
            first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            held[rows[first] + 1] += np.add.reduceat(wanted[col[use]], first, axis=0).view(np.uint8)
        np.cumsum(held, axis=0, out=held)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            h = int(reach[lo])
            region = held[2 + 2 * h :, lo:hi] - held[: -2 - 2 * h, lo:hi]
            for x in np.flatnonzero(region >= needs[lo:hi].astype(np.uint16)).tolist():
                row, q = divmod(x, hi - lo)
                if (t := int(text[row + h])) >= 0:
                    out.setdefault((t, int(place[row + h]) * HALF), []).append(int(order[lo + q]))

    grids, where, n = [], [], halo + 1
    for t, words in enumerate(texts):
        if not len(words):
            continue
        terms = _halves(terms_of(words))
        last = max(1, len(terms) - 1)
        for a in range(0, last, 2 * CHUNK_PASSAGES):
            b = min(a + 2 * CHUNK_PASSAGES, last)
            lo, hi = max(0, a - halo), min(len(terms), b + halo + 1)
            grids += [terms[lo:hi], blank]
            where.append((n + a - lo, (t, a, b - a)))
            n += hi - lo + len(blank)
            if n >= 4 * CHUNK_PASSAGES:
                look(grids, where)
                grids, where, n = [], [], halo + 1
    if where:
        look(grids, where)
    return out


def _halves(terms: np.ndarray) -> np.ndarray:
    """Rows of HALF terms, the last filled up with -1."""
    grid = np.full((-(-len(terms) // HALF), HALF), -1, np.int32)
    grid.ravel()[: len(terms)] = terms
    return grid


def _search(words: DataFrame, block: list[tuple], idf: np.ndarray, rarity: np.ndarray, options: dict) -> DataFrame:
    item_words = [word_hashes(t.encode()) for _, t in block]
    terms = np.unique(terms_of(np.concatenate(item_words)))
    terms = terms[np.argsort(-rarity[terms], kind="stable")]
    vocabulary = np.full(1 << TERM_BITS, -1, np.int32)
    vocabulary[terms] = np.arange(len(terms))
    items = np.zeros((len(block), len(terms)), np.float32)
    for i, ws in enumerate(item_words):
        t, tf = np.unique(terms_of(ws), return_counts=True)
        items[i, vocabulary[t]], _ = _weights(np.zeros(len(t), np.int64), t, np.minimum(tf, PASSAGE), idf, 1)
    space = latent_space(words, items, vocabulary, idf, rank=options["rank"])
    queries = items @ space
    queries = (queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    required = required_terms(item_words, rarity, options["min_lcs_with_answer"]) if options["guarantee"] else None
    shared = words.sparkSession.sparkContext.broadcast((vocabulary, idf, space, queries, [i for i, _ in block], [w.tolist() for w in item_words], required))
    low = options["min_cosine"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, idf, space, queries, ids, item_words, required = shared.value
        masks, answers = [bit_masks(w) for w in item_words], [bit_masks(w[-ANSWER:]) for w in item_words]
        counts = [{w: m.bit_count() for w, m in mask.items()} for mask in masks]
        needed = [len(w) * options["min_lcs_with_answer"] - 1e-9 for w in item_words]
        for batch in batches:
            texts, out = _words(batch), {}
            doc_ids, hashes = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
            holding = _holding(texts, required) if required else {}
            lists: dict[int, list[int]] = {}
            for sorted_terms, where in _chunks(iter(texts), HALF):
                passage, term, tf = _entries(sorted_terms)
                w, _ = _weights(passage, term, tf, idf, len(where))
                column = vocabulary[term]
                use = column >= 0
                rich = np.bincount(passage[use], w[use].astype(np.float64) ** 2, len(where)) >= low * low
                left = np.flatnonzero(rich)
                use &= rich[passage]
                place = np.full(len(where), -1)
                place[left] = np.arange(len(left))
                rows = place[passage[use]]
                near = _project(rows, column[use], w[use], len(left), space) @ queries.T
                p, q = np.nonzero(near >= low)
                wanted = dict(zip(zip(left[p].tolist(), q.tolist(), strict=True), near[p, q].tolist(), strict=True))
                if holding:
                    for i in compress(range(len(where)), map(holding.__contains__, where)):
                        for q in holding[where[i]]:
                            wanted.setdefault((i, q), None)
                for (i, q), cosine in wanted.items():
                    row, at = where[i]
                    n = len(item_words[q])
                    if (region := lists.get(row)) is None:
                        region = lists[row] = texts[row].tolist()
                    region = region[max(0, at - n) : at + PASSAGE + n]
                    # A subsequence holds no more than the item's words that are here at all.
                    if sum(map(counts[q].__getitem__, counts[q].keys() & region)) < needed[q]:
                        continue
                    lcs = common_subsequence(masks[q], n, region) / n
                    if lcs < options["min_lcs_with_answer"]:
                        continue
                    if cosine is None:
                        cosine = float(near[place[i], q]) if place[i] >= 0 else 0.0
                    answer = common_subsequence(answers[q], min(n, ANSWER), region) == min(n, ANSWER)
                    if lcs >= options["min_lcs"] or answer:
                        key = (row, q)
                        out[key] = max(out.get(key, (0.0, 0.0, False)), (lcs, cosine, answer))
            if out:
                cols = [[doc_ids[r] for r, _ in out], [hashes[r] for r, _ in out], [ids[q] for _, q in out], *zip(*out.values(), strict=True)]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "text_hash", "item_id", "lcs_share", "cosine", "has_answer"])

    return words.mapInArrow(run, FOUND)


def _found(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    rank: int = RANK,
    min_cosine: float = MIN_COSINE,
    min_lcs: float = MIN_LCS,
    min_lcs_with_answer: float = MIN_LCS_ANSWER,
    block: int = BLOCK_ITEMS,
    guarantee: bool = True,
) -> DataFrame:
    """FOUND: the items each row holds."""
    options = {"rank": rank, "min_cosine": min_cosine, "min_lcs": min_lcs, "min_lcs_with_answer": min_lcs_with_answer, "guarantee": guarantee}
    rows = benchmark.select(F.col("item_id").cast("long"), "text").filter("text is not null and item_id is not null").orderBy("item_id", "text").toLocalIterator()
    found, held, words = None, [], None

    def search(part: list[tuple]) -> DataFrame:
        nonlocal words, idf, rarity
        if words is None:
            words = stash(hashed(docs), "decontamination-words")
            frequency, n = passage_frequencies(words)
            idf, rarity = np.log1p(n / np.maximum(frequency, 1)).astype(np.float32), frequency / max(n, 1)
        return stash(_search(words, part, idf, rarity, options), "contaminated")

    idf = rarity = np.zeros(0)
    for r in rows:
        if len(word_hashes(r.text.encode())):
            held.append((r.item_id, r.text))
        if len(held) == block:
            found, held = search(held) if found is None else found.union(search(held)), []
    if held:
        found = search(held) if found is None else found.union(search(held))
    if words is not None:
        drop_stash(words)
    return docs.sparkSession.createDataFrame([], FOUND) if found is None else found


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, lcs_share, cosine, has_answer): the items each document holds."""
    found = _found(docs, benchmark, **options)
    best = F.max(F.struct("lcs_share", "cosine", "has_answer")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, told by (doc_id, text) as ids may repeat or be null."""
    hit = _found(docs, benchmark, **options).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(hit, docs["doc_id"].cast("long").eqNullSafe(hit["__id"]) & (F.xxhash64(docs["text"]) == hit["__hash"]), "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
