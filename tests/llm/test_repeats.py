import hashlib
import random
from collections import defaultdict

import pytest

from casegraph.llm import repeats, substring_dedup, suffix_array


def corpus(seed, null_ids=False):
    """Texts over few words with shared passages, copies, near copies, repeats inside a text, and the odd cases."""
    rng = random.Random(seed)
    word = lambda: rng.choice("a bb the öne of in ßx und qu".split()) + rng.choice("0123456789")
    passage = [[word() for _ in range(rng.randint(25, 60))] for _ in range(5)]
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passage)
        rows.append([i * 3 % 61, " ".join(words), "s"])
        if rng.random() < 0.4:
            near = list(words)
            if near:
                near[rng.randrange(len(near))] = word()
            rows.append([100 + i, rng.choice([" ", "\n"]).join(near), None])
    rows += [[200, None, "s"], [201, "", "s"], [202, "x " * 300, "s"]]
    if null_ids:
        rows += [[None, rows[0][1], "s"], rows[1], rows[2], [rows[3][0], rows[4][1], "s"]]
    return [tuple(r) for r in rows]


def key(row):
    return (row[0] is not None, row[0] or 0)


def brute_words(rows, window=20):
    seen = {}
    distinct = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (key(r),))
    for i, text in distinct:
        w = (text or "").split()
        for s in range(len(w) - window + 1):
            seen.setdefault(tuple(w[s : s + window]), (key((i,)), s))
    out = []
    for i, text, _ in rows:
        w = (text or "").split()
        gone = set()
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] < (key((i,)), s):
                gone.update(range(s, s + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((key((i,)), len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def brute_bytes(rows, window):
    n = defaultdict(int)
    for _, text in {(r[0], r[1]) for r in rows}:
        b = (text or "").encode()
        for s in range(len(b) - window + 1):
            n[b[s : s + window]] += 1
    out = []
    for i, text, _ in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - window + 1):
            if n[b[s : s + window]] > 1:
                gone[s : s + window] = [True] * window
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((key((i,)), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("seed", "limit"), [(1, 2000), (2, 2)])
def test_words_against_brute_force(spark, documents, seed, limit):
    rows = corpus(seed)
    docs = repeats.keyed(documents(rows))
    out = repeats.with_spans(docs, substring_dedup.word_spans(docs, shard_limit=limit), substring_dedup.word_digest, "n_words long, n_removed long, kept_sha256 string", ("doc_id",))
    got = sorted((key(r), *r[1:]) for r in out.collect())
    assert got == brute_words(rows)
    assert sum(r[2] for r in got) > 500


@pytest.mark.parametrize(("seed", "limit", "odd"), [(3, 2000, False), (4, 2, False), (5, 2000, True)])
def test_bytes_against_brute_force(spark, documents, seed, limit, odd):
    rows = corpus(seed, odd)
    docs = repeats.keyed(documents(rows))
    spans = suffix_array.byte_spans(docs, window=60, keep_first=False, shard_limit=limit)
    out = repeats.with_spans(docs, spans, suffix_array.byte_digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", ("doc_id",))
    assert sorted((key(r), *r[1:]) for r in out.collect()) == brute_bytes(rows, 60)


def test_keep_first_keeps_columns_and_first_copies(spark, documents):
    line = " ".join(f"wörd{i}" for i in range(60))
    out = suffix_array.remove_repeats(documents([(5, "x " + line, "s"), (2, line + " y", None), (7, None, "s")]), window=200)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size"]
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[2] == line + " y" and len(got[5]) < 10 and got[7] is None
    assert suffix_array.remove_repeats(documents([])).count() == 0


def test_previous_factors_on_a_small_text():
    import numpy as np

    text = b"abracadabra abracadabra"
    order, common = suffix_array.suffix_order(np.frombuffer(text, np.uint8), np.arange(len(text)), 16)
    assert [text[i:] for i in order] == sorted((text[i:] for i in range(len(text))), key=lambda s: s.ljust(40, b"\0"))
    where, length, source = suffix_array.previous_factors(order, common, 4)
    best = {}
    for i in range(len(text)):
        n = max((next((k for k in range(len(text) - i) if text[j + k] != text[i + k]), len(text) - i) for j in range(i)), default=0)
        if n >= 4:
            best[i] = n
    assert dict(zip(where.tolist(), length.tolist())) == best


def test_long_texts_are_tiled(monkeypatch, spark, documents):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, text, "s"), (2, "q" + text[1000:290_000], "s")]
    docs = repeats.keyed(documents(rows))
    spans = suffix_array.byte_spans(docs, window=400, keep_first=True)
    out = repeats.with_spans(docs, spans, suffix_array.byte_digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", ("doc_id",))
    assert {r.doc_id: r.n_removed for r in out.collect()} == {1: 0, 2: 289_000}


@pytest.mark.parametrize(("seed", "limit", "odd"), [(6, 2000, False), (7, 2, True)])
def test_digest_judges_two_lengths(spark, documents, monkeypatch, seed, limit, odd):
    monkeypatch.setattr(repeats, "HOT_ROWS", 2)
    rows = corpus(seed, odd)
    out = suffix_array.digest(repeats.keyed(documents(rows)), window=60, passage=30, shard_limit=limit).collect()
    assert sorted((key(r), *r[1:5]) for r in out) == brute_bytes(rows, 60)
    assert sorted((key(r), r.n_bytes, r.n_passage_bytes) for r in out) == [r[:3] for r in brute_bytes(rows, 30)]


def test_odd_rows_and_empty_tables_on_words(spark, documents):
    rows = corpus(8, null_ids=True)
    for some in (rows, []):
        docs = repeats.keyed(documents(some))
        out = repeats.with_spans(docs, substring_dedup.word_spans(docs), substring_dedup.word_digest, "n_words long, n_removed long, kept_sha256 string", ("doc_id",))
        assert sorted((key(r), *r[1:]) for r in out.collect()) == brute_words(some)


def test_thue_morse_words_have_different_hashes():
    import numpy as np

    bits = np.array([bin(i).count("1") % 2 for i in range(1 << 12)], np.uint8)
    x = repeats.BYTE_VALUES[np.concatenate([bits, 1 - bits])]
    n = len(bits)
    total = np.r_[np.uint64(0), np.cumsum(x * repeats.Powers.get(2 * n + 1)[0][: 2 * n])]
    down = repeats.Powers.get(2 * n + 1)[1]
    assert total[n] == ((total[2 * n : 2 * n + 1] - total[n]) * down[n])[0]  # equal modulo 2**64
    a, b = repeats.pieces31(repeats.sums31(x), np.array([0, n]), np.array([n, 2 * n]))
    assert a != b and a == sum(int(v) * pow(repeats._B31, i, repeats._P31) for i, v in enumerate(x[:n])) % repeats._P31
