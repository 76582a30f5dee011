import random

import numpy as np
import pytest

from casegraph.llm import importance, toxicity

LABELS = "doc_id long, quality int, toxic int"


def texts(n, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 120))]
        toxic, junk = i % 5 == 0, i % 4 == 1
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vequor", "loweiz", "scumz"]) + rng.choice(["", "a", "en"]))
        if junk:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), f"s{i % 3}"))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(not junk), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def corpus(spark, documents):
    rows, labels = texts(600)
    rows += [(1000, None, None), (1001, "", None), (None, "plain words here", "s"), (3, rows[3][1], "again"), (1002, "abc def ghi " * 20_000, "s")]
    labels += [(5, None, None), (1000, 0, 0), (9999, 1, 1)]
    return documents(rows), spark.createDataFrame(labels, LABELS), dict((i, i % 5 == 0) for i in range(600))


def test_toxicity_on_held_out_rows(corpus):
    docs, labels, toxic = corpus
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert len(held) > 100
    right = sum(r.predicted == toxic[r.doc_id] for r in held)
    assert right / len(held) > 0.97
    assert all(not r.held_out for r in got if r.doc_id is None)


def test_held_out_is_crc32(spark):
    import zlib

    for r in spark.range(50).selectExpr("id as doc_id").select("doc_id", toxicity.held_out("doc_id").alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_without_labels(spark, documents):
    docs = documents([(1, "a b", "s"), (2, None, "s")])
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.5}
    assert all(r.kept for r in importance.resampled(docs, none).collect())
    assert toxicity.toxicity(documents([]), none).count() == importance.resampled(documents([]), none).count() == 0


def test_grams_are_character_ngrams():
    assert len(toxicity.grams("abc")) == 3 + 2 + 1  # " abc " has 5 characters
    assert np.array_equal(toxicity.grams("A  b\nc"), toxicity.grams("a b c"))
    assert set(toxicity.grams("bcd")) <= set(toxicity.grams("xbcd y bcd"))


def test_resampling_keeps_clean_and_drops_junk(corpus):
    docs, labels, _ = corpus
    got = importance.resampled(docs, labels, keep_share=0.76).collect()
    assert len(got) == docs.count()
    known = [r for r in got if r.doc_id is not None and r.doc_id < 600]
    junk = [r.kept for r in known if r.doc_id % 4 == 1]
    clean = [r.kept for r in known if r.doc_id % 4 != 1]
    assert sum(clean) / len(clean) > 0.97 and sum(junk) / len(junk) < 0.05
    assert [r.kept for r in got if r.doc_id == 3] in ([True, True], [False, False])
    again = importance.resampled(docs.repartition(7), labels, keep_share=0.76).collect()
    assert sorted((str(r.doc_id), r.kept) for r in got) == sorted((str(r.doc_id), r.kept) for r in again)


def test_log_weights_against_a_plain_count(spark, documents):
    rows, labels = texts(40)
    docs, good = documents(rows), {i for i, q, _ in labels if q == 1}
    got = {r.doc_id: r.log_weight for r in importance.resampled(docs, spark.createDataFrame(labels, LABELS)).collect()}
    known = importance._Known()
    counts = {i: np.bincount(importance.ngram_buckets(t, known), minlength=importance.BUCKETS) for i, t, _ in rows}
    target, raw = (sum(counts[i] for i in ids) + 1.0 for ids in (good, counts))
    gain = np.log(target / target.sum()) - np.log(raw / raw.sum())
    assert all(got[i] == pytest.approx((c * gain).sum()) for i, c in counts.items())


@pytest.mark.parametrize("k", [1, 3, 50, 99, 100])
def test_kth_largest(spark, k):
    values = [random.Random(k).randint(-(2**62), 2**62) for _ in range(99)] + [-5]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert importance.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_rows_without_an_id_are_drawn_each_by_its_own_key(corpus, documents):
    docs, labels, _ = corpus
    good, junk = docs.filter("doc_id = 2").first().text, " ".join(["ZZZQ!!"] * 200)
    more = docs.unionByName(documents([(None, good, "a"), (None, junk, "b"), (700, good, "a"), (700, junk, "b"), (700, good, "c")]))
    told = {(r.doc_id, r.text_hash): r.kept for r in importance.resampled(more, labels).collect()}
    kept = [(r.doc_id, r.text) for r in importance.keep_good(more, labels).collect()]
    for i in (None, 700):
        assert (i, junk) not in kept and kept.count((i, good)) == (2 if i else 1)
    assert len(kept) == sum(told[r.doc_id, r.text_hash] for r in importance.resampled(more, labels).collect())


@pytest.mark.parametrize("entries", [toxicity.ENTRIES, 400])
def test_toxicity_against_a_plain_computation(spark, documents, entries):
    """Ratios, fit and scores with dictionaries and dense rows, from the definition in the docstring."""
    import math
    import zlib

    rows, labels = texts(90, seed=4)
    rows += [(1000, None, None), (1001, "", None), (1002, "Vequor  \t ÄBC", "s")]
    docs, label_rows = documents(rows), spark.createDataFrame([*labels, (1000, 0, 0), (5, None, None), (None, 1, 1)], LABELS)
    text, known = {i: t for i, t, _ in rows}, [(i, y) for i, _, y in [*labels, (1000, 0, 0)] if zlib.crc32(str(i).encode()) % 3 != 1]
    present = {i: set(toxicity.grams(t).tolist()) for i, t in text.items()}
    p, q = {}, {}
    for i, y in known:
        for f in present[i]:
            side = p if y else q
            side[f] = side.get(f, 0) + 1
    all_p, all_q = sum(p.values()), sum(q.values())
    ratio = {f: math.log((p.get(f, 0) + 1) / all_p) - math.log((q.get(f, 0) + 1) / all_q) for f in set(p) | set(q) if p.get(f, 0) + q.get(f, 0) >= toxicity.MIN_DOCS}
    order, total, chosen = sorted((f for f in ratio if abs(ratio[f]) >= toxicity.MIN_RATIO), key=lambda f: (-abs(ratio[f]), f)), 0, []
    for f in order:
        total += p.get(f, 0) + q.get(f, 0)
        if total > entries:
            break
        chosen.append(f)
    assert chosen and (len(chosen) < len(order)) == (entries == 400)
    x = np.array([[ratio[f] * (f in present[i]) for f in chosen] for i, _ in known])
    y, w, b = np.array([float(y > 0) for _, y in known]), np.zeros(len(chosen)), 0.0
    m = v = np.zeros(len(chosen) + 1)
    for t in range(1, 401):
        error = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y
        grad = np.append(x.T @ error + w, error.sum()) / len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    want = {i: 1 / (1 + math.exp(-(b + sum(w[k] * ratio[f] for k, f in enumerate(chosen) if f in found)))) for i, found in present.items()}
    weights, intercept = toxicity.train(docs, label_rows, entries=entries)
    got = {r.doc_id: r.score for r in toxicity.score(docs, weights, intercept).collect()}
    assert got == pytest.approx(want, rel=1e-6)
    assert max(want.values()) > 0.7 > 0.3 > min(want.values())


def test_very_long_texts_and_labels_given_twice(spark, documents):
    rows, labels = texts(60, seed=6)
    docs = documents([*rows, (2000, "vequor und " * 200_000, "s"), (2001, "vequor und " * 4, "s")])
    got = {r.doc_id: r for r in toxicity.toxicity(docs, spark.createDataFrame([*labels, *labels[:5], (0, None, None)], LABELS)).collect()}
    # Features are there or not, so four rounds say what 200,000 do.
    assert len(got) == 62 and got[2000].score == got[2001].score
