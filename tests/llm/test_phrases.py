import random
import re
from collections import Counter, defaultdict

import pytest

from casegraph.llm import phrases


def corpus(seed=2):
    rng = random.Random(seed)
    words = "new york city of the the a große Berlin Straße rare x1".split() + [f"w{i}" for i in range(12)]
    passages = [[rng.choice(words) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(80):
        out = []
        for _ in range(rng.randint(0, 12)):
            out += rng.choice(passages) if rng.random() < 0.4 else [rng.choice(words)]
            out[-1:] = [out[-1] + rng.choice(["", "", "", ",", ".", "\n", "\t"])] if out else []
        rows.append((i, " ".join(out), rng.choice(["en", "de", None, "und"])))
    rows += [(None, "New York CITY new york city", None), rows[0], rows[0], (200, None, "en"), (201, "", None), (202, "the of " * 2000, "en"), (203, "w" * 500 + " " + "w" * 500, "en")]
    return rows


def brute(rows, min_count, percent, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        longer = defaultdict(int)
        for p, a in candidates.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], a)
        told = []
        for p, a in candidates.items():
            if len(p) == 2 and p in longer and 100 * longer[p] >= percent * a:
                continue
            score, _, left, right = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            told.append((-score, -a, " ".join(p).encode(), left, right))
        told.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(told[:top])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(t, lang, i, "x") for i, t, lang in rows], "text string, lang string, doc_id long, phrase string")


@pytest.mark.parametrize("options", [{}, {"budget": 40}, {"budget": 1}, {"numbered": 6, "filter_bits": 128, "budget": 50}, {"numbered": 0, "filter_bits": 1 << 12}])
def test_phrases_are_those_of_plain_counts(spark, options):
    rows = corpus()
    for min_count, top in ((3, 2000), (5, 7)):
        got = phrases.collocations(frame(spark, rows).repartition(3), min_count=min_count, top=top, **options).collect()
        assert sorted(map(tuple, got)) == brute(rows, min_count, 50, top)


def test_small_blocks_and_flushes(spark, monkeypatch):
    """Blocks and flushes of a few words, within one task: functions of this module are pickled by name, so local limits apply in the driver's process only."""
    import pyarrow as pa

    rows = corpus()
    batch = pa.RecordBatch.from_pydict({"lang": [r[2] or "und" for r in rows], "text": [None if r[1] is None else r[1].encode() for r in rows]})
    whole = Counter()
    for words, langs in phrases._words(iter([batch]), 0):
        whole.update((langs[t], words.bytes_of(i)) for i, t in enumerate(words.text.tolist()))
    monkeypatch.setattr(phrases, "BLOCK", 50)
    parts = Counter()
    for words, langs in phrases._words(iter([batch]), 0):
        parts.update((langs[t], words.bytes_of(i)) for i, t in enumerate(words.text.tolist()))
    assert whole == parts


def test_empty_table(spark):
    assert phrases.collocations(frame(spark, [(1, "a b", "en")]).limit(0)).count() == 0
    assert phrases.collocations(frame(spark, [(1, None, None), (2, "a b", "en")])).count() == 0


def test_products_beyond_64_bits(spark):
    df = spark.createDataFrame([(4_000_000_000, 5_000_000_000, 6_000_000_007)], "a long, l long, r long")
    assert df.select(phrases._score("a", "l", "r").alias("s")).first().s == 10**6 * 4_000_000_000**2 // (5_000_000_000 * 6_000_000_007)
