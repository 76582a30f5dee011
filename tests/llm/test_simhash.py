import random

import numpy as np
import pytest

from casegraph.llm import near_copies, simhash


def brute(prints):
    """doc_id -> smallest reachable doc_id, by comparing all pairs."""
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in prints:
        for j, b in prints:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in prints}


@pytest.mark.parametrize("limit", [4096, 3])
def test_links_reach_what_brute_force_reaches(spark, limit):
    rng = random.Random(7)
    values = []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            v = base
            for _ in range(rng.randint(0, 5)):
                v ^= 1 << rng.randrange(64)
            values.append(v)
    values = list(dict.fromkeys(values))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(nodes, limit)).collect()}
    want = brute(list(zip(signed, values)))
    groups = {}
    for v in signed:
        groups.setdefault(found.get(v, v), set()).add(v)
    expected = {}
    for v in signed:
        expected.setdefault(want[v], set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
    assert any(len(g) > 5 for g in groups.values())


def test_nulls_copies_and_empty_tables(spark, documents):
    rows = [(3, "A b c d", "s"), (1, "a B c d", "s"), (1, "a B c d", "s"), (5, None, None), (4, " \n", "s"), (None, "x y", "s"), (9, "solo", None)]
    out = {(r.doc_id, r.fp): r.component_id for r in simhash.groups(documents(rows)).collect()}
    by_id = {i: c for (i, _), c in out.items()}
    assert by_id[3] == by_id[1] == 1 and by_id[5] == by_id[4] == 4 and by_id[9] == 9 and by_id[None] is None
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in near_copies.keep_one(documents(rows)).collect())
    assert kept == [(False, 1), (False, 4), (False, 9), (True, 0)]
    assert simhash.groups(documents([])).count() == 0


def test_rows_with_null_or_repeated_ids_stay(spark, documents):
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(30))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(None, a, "s"), (None, b, "s"), (None, b, "t"), (7, c, "s"), (7, d, "s"), (None, c, "s"), (9, e, "s"), (8, e, "s"), (7, f, "t"), (7, f, "s")]
    for n in (1, 5):
        got = near_copies.keep_one(documents(rows).repartition(n)).collect()
        assert sorted((r.doc_id or 0, r.text, r.source) for r in got) == sorted([(0, a, "s"), (0, b, "s"), (7, c, "s"), (7, d, "s"), (8, e, "s"), (7, f, "s")])


def test_fingerprint_follows_its_definition():
    import xxhash

    text = "One two THREE four five four".encode()
    w = text.lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(text) == want


def brute_groups(prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if np.bitwise_count(prints[i] ^ prints[j]).sum() <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize(("limit", "hot"), [(4096, 4096), (4, 5)])
def test_near_copies_reach_what_brute_force_reaches(spark, documents, monkeypatch, limit, hot):
    monkeypatch.setattr(near_copies, "HOT_ROWS", hot)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for g in range(12):
        base = [word() for _ in range(150)]
        for c in range(8):
            near = list(base)
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = word()
            rows.append((100 * g + c, " ".join(near), "s"))
    known = near_copies.WordHashes()
    prints = [near_copies.fingerprint(t.encode(), known) for _, t, _ in rows]
    want = {rows[r][0] for r in brute_groups(prints, near_copies.RADIUS)}
    got = {r.doc_id for r in near_copies.keep_one(documents(rows), bucket_limit=limit).collect()}
    assert got >= want and len(got - want) <= 1 and len(want) < 20


def test_grow_follows_chains_and_names_every_group():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 63, (60, 4), np.uint64)
    for i in range(1, 40):
        prints[i] = prints[i - 1]
        prints[i, 0] ^= np.uint64(1) << np.uint64(i)
    edges, heads = near_copies.grow(prints, 1)
    assert len(edges) == 39 and sorted(heads) == [0, *range(40, 60)]
    assert all(np.bitwise_count(prints[a] ^ prints[b]).sum() <= 1 for a, b in edges)


def test_long_texts_have_one_fingerprint(spark, documents):
    text = " ".join(f"w{i % 977}" for i in range(60_000))
    got = near_copies.keep_one(documents([(2, text, "s"), (1, text + " more", "s"), (3, "other words stand here alone", "s")])).collect()
    assert sorted(r.doc_id for r in got) == [1, 3]
    assert {r.component_id for r in simhash.groups(documents([(2, text, "s"), (1, text, "s")])).collect()} == {1}


def nodes_of(spark, prints):
    rows = [(i, p.tobytes(), near_copies.pieces(p).tolist()) for i, p in enumerate(prints)]
    return spark.createDataFrame(rows, "node long, fp binary, pieces array<long>").repartition(3)


def reached(links, n):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def flipped(p, bits):
    p = p.copy()
    for b in bits:
        p[b // 64] ^= np.uint64(1 << (b % 64))
    return p


@pytest.mark.parametrize(("limit", "hot"), [(4096, 4096), (6, 4096), (4, 4096), (1, 4096), (4, 5)])
def test_parts_of_a_bucket_meet_even_if_nothing_links_inside_one(spark, monkeypatch, limit, hot):
    """Pairs 35 bits apart that share one piece only, and no link within any part."""
    monkeypatch.setattr(near_copies, "HOT_ROWS", hot)
    monkeypatch.setattr(near_copies, "HOT_GROUPS", 10**9)
    rng, width = np.random.default_rng(3), near_copies.WIDTH
    prints, shared = [], rng.integers(0, 1 << 62, 4, np.uint64) & np.array([(1 << width) - 1, 0, 0, 0], np.uint64)
    for _ in range(6):
        p = (rng.integers(0, 1 << 62, 4, np.uint64) & ~np.array([(1 << width) - 1, 0, 0, 0], np.uint64)) | shared
        prints.append(p)
    prints += [flipped(p, [s * width + 5 * k for s in range(1, 8) for k in range(5)]) for p in prints[:6]]
    got = reached([tuple(r) for r in near_copies.links(nodes_of(spark, prints), bucket_limit=limit).collect()], 12)
    assert got == [*range(6), *range(6)] == brute_groups(prints, near_copies.RADIUS)


@pytest.mark.parametrize("limit", [3, 5])
def test_groups_of_several_parts_are_joined_by_members_that_are_not_heads(spark, limit):
    """Chains through one bucket: neighbours are near, their ends are far, so heads of parts don't meet."""
    rng, width = np.random.default_rng(8), near_copies.WIDTH
    far = [s * width + k for s in range(1, 8) for k in range(width)]
    prints = []
    for _ in range(2):
        p = (rng.integers(0, 1 << 62, 4, np.uint64) >> np.uint64(width)) << np.uint64(width)
        chain = [p]
        for step in range(9):
            chain.append(flipped(chain[-1], far[step::10][:19] if step % 2 else far[step::9][:20]))
        prints += chain
    order = np.random.default_rng(1).permutation(len(prints))
    prints = [prints[i] for i in order]
    got = reached([tuple(r) for r in near_copies.links(nodes_of(spark, prints), bucket_limit=limit).collect()], len(prints))
    assert got == brute_groups(prints, near_copies.RADIUS)


def random_prints(rng, n):
    return list(rng.integers(0, 1 << 64, (n, 4), np.uint64))


@pytest.mark.parametrize("distance", [24, 36, 42, 43])
def test_pairs_at_the_radius_are_linked_and_none_beyond(spark, distance):
    """Pieces of 28 bits differ in 2 bits or fewer for sure up to 23 bits only."""
    rng = np.random.default_rng(distance)
    prints = random_prints(rng, 150)
    prints += [flipped(p, rng.choice(256, distance, replace=False).tolist()) for p in prints]
    got = {tuple(r) for r in near_copies.links(nodes_of(spark, prints)).collect()}
    assert got == ({(150 + i, i) for i in range(150)} if distance <= near_copies.RADIUS else set())


@pytest.mark.parametrize(("radius", "limit"), [(42, 4096), (42, 2), (5, 3), (0, 4), (3, 4096), (90, 5)])
def test_links_are_exact_at_any_radius(spark, radius, limit):
    """Chains of fingerprints of which neighbours are ``radius`` bits apart, evenly spread or not, with strangers around."""
    rng = np.random.default_rng(radius)
    prints = random_prints(rng, 10)
    for _ in range(5):
        prints += (chain := random_prints(rng, 1))
        for step in range(6):
            spread = [(k * 256) // max(1, radius) for k in range(radius)]
            chain.append(flipped(chain[-1], spread if step == 2 else rng.choice(256, max(1, radius + step // 5), replace=False).tolist()))
        prints += chain[1:]
    prints = list({p.tobytes(): p for p in prints}.values())
    order = rng.permutation(len(prints))
    prints = [prints[i] for i in order]
    got = reached([tuple(r) for r in near_copies.links(nodes_of(spark, prints), radius=radius, bucket_limit=limit).collect()], len(prints))
    assert got == brute_groups(prints, radius)


@pytest.mark.parametrize("n", [40, 3000])
def test_a_block_joins_what_brute_force_joins(n):
    """Equal in the first cell, 1 bit apart in the next, 40 beyond 64 bits. With 3,000 rows the block is sorted by the next cell; large groups known before don't meet their own."""
    rng = np.random.default_rng(n)
    prints = np.array(random_prints(rng, n // 4))
    prints = np.concatenate([prints, *([flipped(p, [int(rng.integers(5, 11)), *(69 + rng.choice(187, 40, replace=False)).tolist()]) for p in prints] for _ in range(3))])
    prints[:, 0] &= ~np.uint64((1 << 5) - 1)
    root = np.arange(len(prints))
    root[: n // 8] = 0
    zeros = np.zeros(len(prints), np.int64)
    cols = {"node": np.arange(len(prints)), "root": root, "fp": [p.tobytes() for p in prints], "key": zeros}

    def groups(here, blocks):
        links = [(i, 0) for i in range(n // 8)]
        for i, j in blocks:
            rows = np.flatnonzero((here == i) | (here == j))
            block = {k: [v[r] for r in rows] for k, v in {**cols, "here": here, "i": zeros + i, "j": zeros + j}.items()}
            out = near_copies._meeting(42)(near_copies.pa.table(block))
            links += list(zip(out["a"].to_pylist(), out["b"].to_pylist()))
        assert all(np.bitwise_count(prints[a] ^ prints[b]).sum() <= 42 for a, b in links[n // 8 :])
        return reached(links, len(prints))

    want = [i % (n // 4) for i in range(len(prints))]
    want = [0 if w < n // 8 else w for w in want]
    assert groups(zeros, [(0, 0)]) == want
    assert groups(np.arange(len(prints)) % 2, [(0, 0), (0, 1), (1, 1)]) == want


def test_a_large_group_has_a_few_links_a_node(spark, monkeypatch):
    """Near copies meet in many buckets, under different heads; components are fed few links of each text nevertheless, and the groups are those of brute force."""
    rng = np.random.default_rng(6)
    middle, rates = rng.integers(0, 2, 256).astype(bool), rng.uniform(0.01, 0.2, 600)
    bits = middle ^ (rng.random((600, 256)) < rates[:, None])
    prints = list(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
    real, fed = near_copies.components, []
    monkeypatch.setattr(near_copies, "components", lambda edges: fed.append(edges.count()) or real(edges))
    out = near_copies.links(nodes_of(spark, prints)).collect()
    want = brute_groups(prints, near_copies.RADIUS)
    assert max(want.count(r) for r in set(want)) > 300 and reached([tuple(r) for r in out], 600) == want
    assert max(*fed, len(out)) < 5 * 600
