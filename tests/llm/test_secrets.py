import hashlib
import random
import re

import pytest

from casegraph.llm import secrets
from casegraph.llm.automaton import compile_rules, run

BITS = (
    "token|secret|PassWord|passwd|api_key|apikey|=|:| |\"|'|abc|0123456789abcdef|AKIA|ABCDEFGH12345678|deadbeef|eyJ|.|ghp_|" + "x" * 40
    + "|-----BEGIN |RSA |PRIVATE KEY-----|\n|AIza|xoxb-|sk_live_|1234567890|é|漢|\u017fecret|to\u212aen=abcdefg"
).split("|")


def text(rng):
    return "".join(rng.choice(BITS) for _ in range(rng.randint(0, 40)))


def brute(t):
    """Each rule alone, by backtracking search over code points."""
    found = []
    for k, r in enumerate(secrets.RULES):
        for m in re.finditer(r.pattern, t, re.ASCII | re.IGNORECASE if r.fold else 0):
            if len(m[r.group]) >= r.least:
                found.append((m.start(), k, m.end()))
    told = lambda spans: ",".join(f"{secrets.RULES[k].kind}:{s}:{e}" for s, k, e in sorted(spans))
    base = [x for x in found if x[1] < len(secrets.BASE)]
    return (*(sum(k == j for _, k, _ in base) for j in range(len(secrets.BASE))), hashlib.sha256(told(base).encode()).hexdigest(), told(found))


def test_spans_are_those_of_each_rule_alone(spark, documents, tmp_path):
    rng = random.Random(5)
    rows = [(i, text(rng), "s") for i in range(400)]
    rows += [(None, rows[0][1], None), rows[1], rows[1], (401, None, None), (402, "", "s"), (403, "ab" * 400_000 + " token=" + "q" * 300_000, "s"), (404, "token " * 50_000, "s")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, secrets.op11_secrets(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i, *brute(t or "")) for i, t, _ in rows), key=str)
    assert sum(x[1] for x in got) > 50 and sum(x[2] for x in got) > 5 and sum(x[3] for x in got) > 50


def test_letters_beyond_ascii_are_not_folded(documents):
    found = secrets.find(documents([(1, "\u017fecret=abcdefgh to\u212aen=abcdefgh", "s")])).first()
    assert list(found.kinds) == []


def test_failed_match_is_passed_over(documents):
    """A match that is too short still ends where it ends: nothing within it is tried again."""
    found = secrets.find(documents([(1, "token=token:abcdefgh", "s"), (2, "token=abc token:abcdefgh", "s")]))
    assert {r.doc_id: list(r.starts) for r in found.collect()} == {1: [], 2: [10]}


def test_empty_table(documents):
    assert secrets.find(documents([(1, "a", "s")]).limit(0)).count() == 0


@pytest.mark.parametrize("pattern", ["a(b|cd)*e?", "[a-c]+d|ab", "(aa|aab)c?", "x?y*z+"])
def test_automaton_accepts_what_the_pattern_matches(pattern):
    rng = random.Random(pattern)
    automaton = compile_rules([(pattern, False)], anchored=True)
    start, kinds = automaton.start(), automaton.kind.tobytes()
    for _ in range(500):
        t = "".join(rng.choice("abcdexyz") for _ in range(rng.randint(1, 7))).encode()
        end = run(start, t.translate(kinds))[-1]
        assert bool(automaton.accepts[end]) == bool(re.fullmatch(pattern.encode(), t))


def test_automaton_is_minimal():
    """Three ways to write one language give automata of one size."""
    sizes = {len(compile_rules([(p, False)], anchored=True).move) for p in ("(ab|ac)d*", "a(b|c)d*", "a[bc](d+)?")}
    assert len(sizes) == 1
