"""SimHash near-dedup of whole texts: five-word shingles, 256-bit fingerprints, multi-index hashing.

``simhash`` links 64-bit fingerprints of 3-word shingles at 3 bits or fewer, which finds copies and hardly changed texts only. Here a text's
fingerprint has 256 bits, each set if it is set in over half of the hashes of its distinct-or-not 5-word shingles. Texts whose shingle sets have a Jaccard
similarity of 0.8 differ in about 38 of them (15 %, give or take 5 bits), so fingerprints link at ``RADIUS`` = 42 bits or fewer: nearly all pairs of 0.8 or more and, as a fingerprint is an
estimate, some just below.

Links are found in two steps. The first is fast and joins most groups: candidates come from ``SEGMENTS`` pieces of ``WIDTH`` bits. Texts with an equal piece meet first. Then table and probes both enumerate
the Hamming ball of radius 1 around each piece, so two texts meet in a bucket wherever a piece differs in 2 bits or fewer; complete distances are verified in the bucket.
That is certain up to 23 bits only (at 42 bits about two pairs of three meet). A bucket of chance holds (WIDTH + 1) / 2**WIDTH of the distinct texts.
A text is in up to SEGMENTS * (WIDTH + 1) buckets, and those of one group have different heads. So balls tell links by the roots of what equal pieces have joined: a text next to a group gives it one link, in however many buckets they meet.

A bucket is cut in parts of ``bucket_limit`` members at most. In a part all links are followed (a member compares with what is not reached yet, so a group
of like texts costs one comparison each), and one member of each group found goes on to a next round in which the parts of a bucket meet, as long as groups merge. Pieces held by over
1 / ``HOT_GROUPS`` of the texts, hence few, are broadcast and their buckets salted, so that no task reads such a bucket whole.

The second step is exact and leaves out no link between different groups. A fingerprint is cut in RADIUS + 1 cells of 5 or 6 bits, in a ring. Of two fingerprints at RADIUS bits or fewer
there is a cell in which they are equal and after which they differ in at most l bits in the next l cells, for every l (their differences are fewer than the cells, so going round the ring from
behind the place where the sum of (differences - 1) was last at its highest, that sum stays below zero). So every fingerprint is filed under each of its cells; a task compares the rows of one
cell value whose next one or two cells are near enough, first on the cells that follow within 64 bits, then whole. Values held by many more rows than others are cut in parts, and each two parts meet.
Its work is a small share of all pairs (about 1 % with two cells) but grows with their number.

Defined results: null or blank text has fingerprint zero; a text of fewer than five words is one shingle; rows equal in id and text are one document; an
empty table gives an empty result; all columns are carried. Of a group the row with the smallest doc_id stays, rows without an id only where no row of the group has one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm.common import drop_stash, stash
from casegraph.llm.components import components
from casegraph.llm.repeats import WordHashes, mixed

SHINGLE, SEGMENTS, WIDTH, RADIUS = 5, 8, 28, 42
BUCKET_LIMIT, HOT_GROUPS, HOT_ROWS = 4096, 256, 4096
#: Rows of a cell value that one task compares with each other, at most.
CELL_ROWS = 1 << 18
SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes, known: dict) -> np.ndarray:
    """Four unsigned longs."""
    words = text.lower().split()
    if not words:
        return np.zeros(4, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(h))
    n = len(h) - size + 1
    x = np.zeros(n, np.uint64)
    for i in range(size):
        x = x * _STEP + h[i : i + n]
    ones = np.zeros(256, np.int64)
    for at in range(0, n, 1 << 14):
        bits = mixed(x[at : at + (1 << 14), None] ^ SEEDS[None, :])
        ones += np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64)


def pieces(fp: np.ndarray) -> np.ndarray:
    """The first SEGMENTS pieces of WIDTH bits."""
    bits = np.unpackbits(fp.view(np.uint8), bitorder="little")[: SEGMENTS * WIDTH].reshape(SEGMENTS, WIDTH)
    return bits @ (1 << np.arange(WIDTH, dtype=np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp binary, node long, pieces): ``node`` names the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            prints = [fingerprint(t or b"", known) for t in batch.column("text").to_pylist()]
            cols = [pa.array([p.tobytes() for p in prints], pa.binary()), pa.array([pieces(p) for p in prints], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *cols], ["doc_id", "text_hash", "fp", "pieces"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary"))
    return narrow.mapInArrow(run, "doc_id long, text_hash long, fp binary, pieces array<long>").withColumn("node", F.xxhash64("fp"))


def _repeated(limit: int):
    """Rows (key, node) sorted by key -> (key, part, node) of keys with two rows or more, in parts of ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_node, held_place = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

        def emit(key: np.ndarray, node: np.ndarray, place: np.ndarray, shared: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key[shared]), pa.array((place[shared] // limit).astype(np.int64)), pa.array(node[shared])], ["key", "part", "node"])

        for batch in batches:
            key = np.concatenate([held_key, batch.column("key").to_numpy()])
            node = np.concatenate([held_node, batch.column("node").to_numpy()])
            if not len(key):
                continue
            first = np.r_[True, key[1:] != key[:-1]]
            start = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
            place = np.arange(len(key)) - start + np.where(start == 0, held_place, 0)
            shared = (place[:-1] > 0) | ~first[1:]
            held_key, held_node, held_place = key[-1:], node[-1:], int(place[-1])
            yield emit(key[:-1], node[:-1], place[:-1], shared)
        if len(held_key):
            yield emit(held_key, held_node, np.array([held_place]), np.array([held_place > 0]))

    return run


def grow(prints: np.ndarray, radius: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Links that join whatever chains of ``radius`` join, and one member of each group. ``prints``: n x 4."""
    left, edges, heads = np.arange(len(prints)), [], []
    while len(left):
        heads.append(int(left[0]))
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            after = []
            for at in range(0, len(front), step := max(1, (1 << 20) // max(1, len(left)))):
                part = front[at : at + step]
                near = np.bitwise_count(prints[part][:, None] ^ prints[left][None, :]).sum(axis=2, dtype=np.int32) <= radius
                hit = near.any(axis=0)
                edges += zip(part[near.argmax(axis=0)[hit]].tolist(), left[hit].tolist(), strict=True)
                after.append(left[hit])
                left = left[~hit]
                if not len(left):
                    break
            front = np.concatenate(after)
    return edges, heads


def _verify(limit: int, radius: int):
    """Rows (key, part, node, root, fp) sorted by key and part -> (a, b, key): links of roots, and with a null b a head (a node) of a bucket that has other parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(table: pa.Table) -> pa.RecordBatch:
            key, part, node, root = (table.column(c).to_numpy() for c in ("key", "part", "node", "root"))
            prints = np.frombuffer(b"".join(table.column("fp").to_pylist()), np.uint64).reshape(-1, 4)
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            size = np.diff(np.r_[start, len(key)])
            two = start[size == 2]
            two = two[np.bitwise_count(prints[two] ^ prints[two + 1]).sum(axis=1, dtype=np.int32) <= radius]
            a, b, of = [root[two]], [root[two + 1]], []
            for lo, n in zip(start.tolist(), size.tolist(), strict=True):
                split = n == limit or part[lo] > 0 or key[lo] >= 1 << 32
                if n == 2 and not split:
                    continue
                edges, heads = grow(prints[lo : lo + n], radius)
                if edges:
                    x, y = np.array(edges).T + lo
                    a.append(root[x])
                    b.append(root[y])
                if split:
                    of += [(int(node[lo + i]), int(key[lo])) for i in heads]
            a, b = np.concatenate(a), np.concatenate(b)
            a, b = a[a != b], b[a != b]
            links = sorted(set(zip(np.maximum(a, b).tolist(), np.minimum(a, b).tolist(), strict=True)))
            rows = [(x, y, None) for x, y in links] + [(x, None, k) for x, k in of]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["a", "b", "key"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            key, part = table.column("key").to_numpy(), table.column("part").to_numpy()
            whole = np.flatnonzero((key != key[-1]) | (part != part[-1]))
            cut = int(whole[-1]) + 1 if len(whole) else 0
            if cut:
                yield settle(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield settle(pa.Table.from_batches(held))

    return run


def _ball(piece: DataFrame) -> DataFrame:
    """Every piece and its neighbours at 1 bit, as ``key``."""
    flip = F.when(F.col("b") < 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b")))
    return piece.withColumn("b", F.explode(F.sequence(F.lit(-1), F.lit(WIDTH - 1)))).withColumn("key", F.col("piece").bitwiseXOR(flip)).drop("b", "piece")


def _pieces(nodes: DataFrame) -> DataFrame:
    return nodes.select("node", F.posexplode("pieces").alias("s", "v")).select("node", (F.shiftleft(F.col("s").cast("long"), WIDTH) + F.col("v")).alias("piece"))


def _same(piece: DataFrame) -> DataFrame:
    """Every piece alone, as ``key``."""
    return piece.withColumnRenamed("piece", "key")


def _hot(nodes: DataFrame, total: int) -> DataFrame:
    """(piece, n): pieces of many nodes. At most HOT_GROUPS a segment, so this has a bound that doesn't grow."""
    counted = _pieces(nodes).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    return stash(counted.filter(F.col("n") > max(HOT_ROWS, total // HOT_GROUPS)), "near-hot")


def _filed(nodes: DataFrame, hot: DataFrame, around: Callable[[DataFrame], DataFrame], bucket_limit: int) -> DataFrame:
    """(key, node): every piece with what ``around`` adds, the keys of hot pieces salted above bit 32."""
    keys = around(_pieces(nodes))
    if hot.isEmpty():
        return keys.select("key", "node")
    salts = around(hot).groupBy("key").agg(F.ceil(F.sum("n") / F.lit(bucket_limit)).alias("salts"))
    salted = keys.join(F.broadcast(salts), "key", "left")
    salt = F.pmod(F.xxhash64("node", "key"), F.coalesce("salts", F.lit(1))) + F.when(F.col("salts").isNotNull(), 1).otherwise(0)
    return salted.select((F.col("key") + F.shiftleft(salt.cast("long"), 32)).alias("key"), "node")


def _window(prints: np.ndarray, at: int) -> np.ndarray:
    """The 64 bits of each fingerprint from ``at`` on, round the ring."""
    j, shift = divmod(at % 256, 64)
    low = prints[:, j] >> np.uint64(shift)
    return low | prints[:, (j + 1) % 4] << np.uint64(64 - shift) if shift else low


def _low(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _edges(radius: int) -> list[int]:
    """Where the cells begin, and the end."""
    return [i * 256 // (radius + 1) for i in range(radius + 2)]


def _cells(radius: int):
    """Rows (node, root, fp) -> and ``keys``: for each cell its number above bit 32, and its value (its first 32 bits, if longer)."""
    edges = _edges(radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint64).reshape(-1, 4)
            values = [_window(prints, lo) & _low(min(hi - lo, 32)) | np.uint64(i << 32) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]
            keys = np.stack(values, axis=1).astype(np.int64)
            offsets = np.arange(len(prints) + 1, dtype=np.int32) * keys.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, keys.ravel())], ["node", "root", "fp", "keys"])

    return run


def _meeting(radius: int):
    """A block's rows (node, root, fp, key, here, i, j) -> (a, b): links that join whatever groups (roots) have members near each other, one in part i and one in part j."""
    edges = _edges(radius)

    def ahead(cell: int) -> list[int]:
        """Bits of the next 0, 1, 2, ... cells, as far as 64 bits hold them."""
        widths = [edges[(cell + k) % (radius + 1) + 1] - edges[(cell + k) % (radius + 1)] for k in range(1, radius + 1)]
        sums = np.cumsum([0, *widths])
        return sums[sums <= 64].tolist()

    def run(block: pa.Table) -> pa.Table:
        node, root, here = (block[c].to_numpy() for c in ("node", "root", "here"))
        prints = np.frombuffer(b"".join(block["fp"].to_pylist()), np.uint64).reshape(-1, 4)
        cell, i, j = (block[c][0].as_py() for c in ("key", "i", "j"))
        cell >>= 32
        sums = ahead(cell)
        word, bound, out = _window(prints, edges[cell + 1]) & _low(sums[-1]), len(sums) - 1, []
        of_root, label = np.unique(root, return_inverse=True)
        parent = np.arange(len(of_root))

        def find(x: int) -> int:
            while (up := int(parent[x])) != x:
                parent[x] = x = int(parent[up])
            return x

        def compare(t: np.ndarray, q: np.ndarray) -> None:
            nonlocal label
            near = (np.bitwise_count(word[t, None] ^ word[q]) <= bound).ravel()
            if not near.any():
                return
            hit = np.flatnonzero(near)
            x, y = t[hit // len(q)], q[hit % len(q)]
            other = label[x] != label[y]
            x, y = x[other], y[other]
            if not len(x):
                return
            near = np.bitwise_count(prints[x] ^ prints[y]).sum(axis=1, dtype=np.int32) <= radius
            x, y = x[near], y[near]
            _, first = np.unique(label[x] * len(parent) + label[y], return_index=True)
            for a, b in zip(x[first].tolist(), y[first].tolist(), strict=True):
                ra, rb = find(int(label[a])), find(int(label[b]))
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
                    out.append((int(max(node[a], node[b])), int(min(node[a], node[b]))))
            # What is joined now needn't meet again; where there is little of it, telling that would cost more.
            if len(x) > 1 << 10:
                label = np.array([find(k) for k in range(len(parent))])[label]

        def meet(t: np.ndarray, q: np.ndarray) -> None:
            """``t`` against ``q`` by parts; the members of a large group don't meet each other."""
            while len(t):
                part, others = t, q
                if len(t) * len(q) > 1 << 20:
                    t = t[np.argsort(label[t], kind="stable")]
                    n = int(np.searchsorted(label[t], label[t[0]], "right"))
                    if n < 64:
                        n = len(t)
                    else:
                        others = q[label[q] != label[t[0]]]
                    part = t[: min(n, max(1, (1 << 20) // max(1, len(others))))]
                compare(part, others)
                t = t[len(part) :]

        t, q = np.flatnonzero(here == i), np.flatnonzero(here == j)
        if len(t) and len(q) and len(of_root) > 1:
            # How many cells to sort by: a step for each value costs about as much as 20,000 comparisons.
            balls = [np.flatnonzero(np.bitwise_count(np.arange(1 << b)) <= k) for k, b in enumerate(sums) if b <= 16]
            of = dict(zip(sums, balls))
            bits = min(of, key=lambda b: 20_000 * min(1 << b, len(t)) + len(t) * len(q) * len(of[b]) / (1 << b))
            value = (word & _low(bits)).astype(np.int64)
            t, q = t[np.argsort(value[t], kind="stable")], q[np.argsort(value[q], kind="stable")]
            start = np.searchsorted(value[q], np.arange((1 << bits) + 1))
            cuts = np.flatnonzero(np.r_[True, value[t[1:]] != value[t[:-1]], True])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                near = value[t[lo]] ^ of[bits]
                if i == j:
                    meet(t[lo:hi], t[lo:hi])
                    near = near[near > value[t[lo]]]
                n = start[near + 1] - start[near]
                meet(t[lo:hi], q[np.repeat(start[near] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        ends = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    return run


def _rest(rooted: DataFrame, total: int, radius: int, bucket_limit: int) -> DataFrame:
    """rooted (node, root, fp) -> (a, b): links between its groups, so that none is left out."""
    cells = stash(rooted.mapInArrow(_cells(radius), "node long, root long, fp binary, keys array<long>"), "near-cells")
    filed = cells.select("node", "root", "fp", F.explode("keys").alias("key"))
    limit = min(CELL_ROWS, max(bucket_limit, int(4 * total / 2 ** (256 / (radius + 1)))))
    hot = stash(filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("key", F.ceil(F.col("n") / F.lit(limit)).alias("p")), "near-hot-cells")
    if hot.isEmpty():
        blocks = filed.select("*", *(F.lit(0).cast("long").alias(c) for c in ("here", "i", "j")))
    else:
        parted = filed.join(hot, "key", "left").withColumn("p", F.coalesce("p", F.lit(1).cast("long"))).withColumn("here", F.pmod(F.xxhash64("node"), "p"))
        met = parted.withColumn("there", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") - 1)))
        blocks = met.select("node", "root", "fp", "key", "here", F.least("here", "there").alias("i"), F.greatest("here", "there").alias("j"))
    out = stash(blocks.groupBy("key", "i", "j").applyInArrow(lambda block: _meeting(radius)(block), "a long, b long"), "near-rest")
    drop_stash(cells)
    return out


def _tree(rooted: DataFrame) -> DataFrame:
    """(node, root) -> (a, b): one link for each node but the roots."""
    return rooted.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def _buckets(waiting: DataFrame, rooted: DataFrame, radius: int, bucket_limit: int) -> DataFrame:
    """(key, node), rooted (node, root, fp) -> (a, b): links of roots that join what is linked in a bucket."""
    low, found, last = F.lit((1 << 32) - 1), None, None
    while True:
        parts = waiting.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_repeated(bucket_limit), "key long, part long, node long")
        told = stash(parts, "near-buckets")
        met = told.join(rooted, "node").repartition("key", "part").sortWithinPartitions("key", "part", "node")
        out = stash(met.mapInArrow(_verify(bucket_limit, radius), "a long, b long, key long"), "near-links")
        drop_stash(told)
        edges = out.filter("b is not null").select("a", "b")
        found = edges if found is None else found.union(edges)
        heads = out.filter("b is null").select(F.col("key").bitwiseAND(low).alias("key"), F.col("a").alias("node")).distinct()
        n = heads.count()
        if n == 0 or n == last:
            return found.distinct()
        waiting, last = heads, n


def links(nodes: DataFrame, *, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """nodes (node, fp, pieces), written -> (a, b): links that join the groups of all pairs at ``radius`` bits or fewer."""
    total = nodes.count()
    hot, rooted = _hot(nodes, total), nodes.select("node", F.col("node").alias("root"), "fp")
    for around in (_same, _ball):
        found = _buckets(_filed(nodes, hot, around, bucket_limit), rooted, radius, bucket_limit)
        joined = nodes.select("node", "fp").join(components(_tree(rooted).union(found)), "node", "left")
        rooted = stash(joined.select("node", F.coalesce("root", "node").alias("root"), "fp"), "near-rooted")
    return _tree(rooted).union(_rest(rooted, total, radius, bucket_limit)).distinct()


def keep_one(docs: DataFrame, *, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row of each group.

    A row is told by (doc_id, text), as ids may repeat or be null. Of rows equal in both the least in all columns stays.
    """
    prints = stash(fingerprints(docs), "near-prints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first_id")
    nodes = stash(prints.groupBy("node").agg(least, F.first("fp").alias("fp"), F.first("pieces").alias("pieces")), "near-nodes")
    linked = components(links(nodes, radius=radius, bucket_limit=bucket_limit))
    rooted = nodes.select(F.col("node").alias("n"), "first_id").join(linked, F.col("n") == F.col("node"), "left").select("first_id", F.coalesce("root", "n").alias("root"))
    kept = stash(rooted.groupBy("root").agg(F.min("first_id").alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.text_hash").alias("__hash")), "near-kept")
    out = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["__id"]) & (F.xxhash64(docs["text"]) == kept["__hash"]), "left_semi")
    # The aggregate is paid for only where rows repeat.
    if prints.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        return out
    row = F.struct(*out.columns)
    return out.groupBy("doc_id", F.xxhash64("text").alias("__hash")).agg(F.min_by(row, F.to_json(row)).alias("__row")).select("__row.*")
