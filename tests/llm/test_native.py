import re
from collections import Counter, defaultdict

import pytest

from casegraph.llm import mixing, quality_rules

ROWS = [(1, "a b c d", "x"), (2, "e " * 40, "x"), (3, None, "y"), (4, " \t", None), (5, "f g", "z"), (5, "f g", "z"), (None, "h i j", None), (7, "k " * 500, "w")]


def fill(sizes, weights, budget, epochs):
    """Water-filling by repeated sharing, as one would by hand."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    clamped = set()
    while True:
        left = budget * sum(sizes.values()) - sum(epochs * sizes[s] for s in clamped)
        open_ = [s for s in names if s not in clamped]
        share = {s: left * w[s] / sum(w[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > epochs * sizes[s]}
        if not over:
            return {s: share.get(s, float(epochs * sizes[s])) for s in names}
        clamped |= over


@pytest.mark.parametrize("rows", [ROWS, ROWS[:3], []])
def test_mixing(spark, documents, rows):
    got = mixing.mix(documents(rows)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = fill(sizes, (3, 1, 2), 1.5, 2) if rows else {}
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(documents(rows).repartition(5)).collect()))


def test_rules_against_brute_force(spark, documents):
    shared = "Accept all Cookies 2024 now"
    rows = [(i, f"{shared} \nline {'abc'[i % 3]} of doc{i} " + " ".join(f"w{i}x{j}" for j in range(60 if i % 4 else 3)), "h" if i % 2 else None) for i in range(60)]
    rows += [(100, None, "h"), (101, "", None), (102, "re pe at " * 30, "h"), (103, "one two three one two three\nsame line\nsame line\n\n# $ <b>", "h"), (103, "ä " * 55, None)]
    got = quality_rules.line_rules(documents(rows), min_docs=5, max_share=0.01).collect()
    normal = lambda x: " ".join(re.sub("[0-9]+", "0", x.lower()).split())
    holders, hosts = defaultdict(set), Counter(h for *_, h in rows)
    for n, (_, t, h) in enumerate(rows):
        for line in (t or "").split("\n"):
            if line.split():
                holders[h, normal(line)].add(n)
    want = []
    for i, t, h in rows:
        words, lines = (t or "").split(), [x for x in (t or "").split("\n") if x.split()]
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often = Counter(grams)
        covered = {k + d for k, g in enumerate(grams) if often[g] > 1 for d in range(3)}
        gone = sum(len(x.split()) for x in lines if len(holders[h, normal(x)]) > max(5, 0.01 * hosts[h]))
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        want.append((i, len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed, not failed and len(words) - gone >= 0.2 * len(words), gone))
    pick = lambda r: (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.n_removed_words)
    assert sorted(map(pick, got), key=str) == sorted(want, key=str)
    assert quality_rules.line_rules(documents([])).count() == 0


def test_lines_are_removed_and_depleted_documents_rejected(spark, documents):
    own = lambda i: " ".join("w" * (i + 1) + chr(97 + j % 26) + chr(97 + j // 26) for j in range(60))
    notice = " ".join(f"notice{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(400))
    rows = [(i, f"{notice}\n{own(i)}", "h") for i in range(10)] + [(50, own(50), "h")]
    got = {r.doc_id: (r.kept, r.n_removed_words) for r in quality_rules.line_rules(documents(rows), min_docs=5).collect()}
    assert got[50] == (True, 0) and all(got[i] == (False, 400) for i in range(10))


def test_frequent_lines_leave_the_texts(spark, documents):
    spelled = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(4))  # noqa: E731  (digits would all be one)
    body = lambda i: " ".join(spelled(100 * i + j) for j in range(60))
    menu = "Home About  Contact"
    rows = [(i, f"{menu}\n{body(i)}\n\nhome ABOUT contact", "a") for i in range(30)]
    rows += [(100 + i, f"{menu}\n{body(100 + i)}", "b") for i in range(3)]
    rows += [(200 + i, "\n".join([" ".join(spelled(90_000 + 30 * k + j) for j in range(30)) for k in range(3)]), "a") for i in range(25)]  # copies: nothing of them is left
    rows += [(None, f"{menu}\n{body(7)}", None), (300, None, "a"), (301, "", "a"), rows[0]]
    got = quality_rules.remove_frequent_lines(documents(rows), min_docs=20, max_share=0.01)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "size"]
    want = [(i, f"{body(i)}\n", "a") for i in [*range(30), 0]] + [(100 + i, f"{menu}\n{body(100 + i)}", "b") for i in range(3)] + [(None, f"{menu}\n{body(7)}", None)]
    assert sorted(((r.doc_id, r.text, r.source) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert {r.doc_id for r in quality_rules.line_rules(documents(rows), min_docs=20).filter("kept").collect()} == {w[0] for w in want}
    assert quality_rules.remove_frequent_lines(documents([])).count() == 0


def test_rows_without_an_id_are_spread_and_reruns_agree(spark, documents):
    rows = [(None, f"word{i} " * (i % 7 + 1), "s") for i in range(200)] + [(5, f"other{i} " * (i % 3 + 1), "t") for i in range(50)]
    runs = []
    for n in (1, 6):
        out = mixing.mix(documents(rows).repartition(n), keep=("text",))
        runs.append(sorted(((r.text, r.size, r.taken) for r in out.collect()), key=str))
    assert runs[0] == runs[1]
    whole = sum(x[1] for x in runs[0])
    assert abs(sum(x[2] for x in runs[0]) - 1.5 * whole) <= 2 and all(x[2] <= 2 * x[1] for x in runs[0])
