"""Secrets in texts by one combined automaton of all rules.

All rules are compiled into one minimal deterministic automaton (:mod:`automaton`). A text's bytes pass through it once; the states on the way tell
where each rule is under way and where it has matched. Where one has, within a stretch in which it was never given up, the rule's own
minimal automaton finds the leftmost longest matches, one after the other. A match whose counted group is shorter than the rule asks is dropped.
For the rules here the longest match from a place is also the one that a backtracking search finds.

The automata depend on the rules alone and are sent to every task. No row meets another, so nothing is shuffled.

Defined results: null and empty texts have no secrets; repeated rows give equal results; an empty table gives an empty result; other columns are ignored.
Positions are code points, the end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from casegraph.llm.automaton import Automaton, compile_rules, run
from casegraph.llm.common import dealt, table

#: Bytes that pass the automaton at a time; a longer text goes alone.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Rule:
    """``least`` characters in ``group`` (0: in the whole match). ``fold``: ASCII letters of the pattern in either case."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    fold: bool = False


#: The kinds that are counted.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=\-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Published forms of service keys.
RULES = (
    *BASE,
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("google", r"AIza[A-Za-z0-9_\-]+", 39),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9\-]+", 24),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
)
FOUND = "doc_id long, kinds array<string>, starts array<long>, ends array<long>"


class Scanner:
    """The automata of ``rules`` in the form that tasks use."""

    def __init__(self, rules: tuple[Rule, ...], every: Automaton, own: list[Automaton]) -> None:
        self.rules, self.every, self.start, self.kinds = rules, every, every.start(), every.kind.tobytes()
        self.own = [(a.start(), a.kind.tolist(), (a.accepts != 0).tolist(), (a.alive != 0).tolist()) for a in own]
        self.check = [re.compile(r.pattern.encode(), re.IGNORECASE if r.fold else 0) for r in rules]

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, sorted."""
        state = run(self.start, text.translate(self.kinds))
        matched = self.every.accepts[state]
        any_hit = np.bitwise_or.reduce(matched) if len(matched) else 0
        alive = self.every.alive[state] if any_hit else None
        out = []
        for k, rule in enumerate(self.rules):
            if not any_hit >> k & 1:
                continue
            # Stretches in which the rule is under way, long enough for a match and with one in it.
            on = np.r_[False, (alive >> k & 1).astype(bool), False]
            edge = np.flatnonzero(on[1:] != on[:-1])
            lo, hi = edge[::2], edge[1::2]
            hits = np.r_[0, np.cumsum(matched >> k & 1)]
            good = (hi - lo >= rule.least) & (hits[hi] > hits[lo])
            for a, b in zip(lo[good].tolist(), hi[good].tolist(), strict=True):
                out += [(s, k, e) for s, e in self._matches(k, text, a, b)]
        return sorted(out)

    def _matches(self, k: int, text: bytes, at: int, stop: int) -> Iterator[tuple[int, int]]:
        first, kind, accepts, alive = self.own[k]
        while at < stop:
            row, end = first, -1
            for i in range(at, stop):
                row = row[kind[text[i]]]
                if not alive[row[-1]]:
                    break
                if accepts[row[-1]]:
                    end = i + 1
            if end < 0:
                at += 1
                continue
            found = self.check[k].fullmatch(text, at, end)
            if len(found[self.rules[k].group]) >= self.rules[k].least:
                yield at, end
            at = end


def _blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts joined up to BLOCK bytes: a newline between two ends whatever was under way (no rule here crosses it)."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > BLOCK:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield held


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, kinds, starts, ends): each row's secrets by start, then as the rules are listed."""
    every = compile_rules([(r.pattern, r.fold) for r in rules])
    own = [compile_rules([(r.pattern, r.fold)], anchored=True) for r in rules]
    # A newline that no rule takes keeps joined texts apart.
    apart = not every.alive[every.move[:, every.kind[10]]].any()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules, every, own)
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text")]
            found: list[list[tuple[int, int, int]]] = []
            for held in _blocks(texts) if apart else ([t] for t in texts):
                joined = b"\n".join(held)
                spans = scanner.spans(joined)
                ends = np.cumsum([len(t) + 1 for t in held])
                here: list[list[tuple[int, int, int]]] = [[] for _ in held]
                if spans:
                    point = np.cumsum((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80)
                    owner = np.searchsorted(ends, [s for s, _, _ in spans], side="right")
                    for (s, k, e), d in zip(spans, owner.tolist(), strict=True):
                        low = int(point[ends[d - 1] - 1]) if d else 0
                        here[d].append((int(point[s]) - 1 - low, k, int(point[e - 1]) - low))
                found += here
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([[rules[k].kind for _, k, _ in f] for f in found], pa.list_(pa.string())),
                    pa.array([[s for s, _, _ in f] for f in found], pa.list_(pa.int64())),
                    pa.array([[e for _, _, e in f] for f in found], pa.list_(pa.int64())),
                ],
                ["doc_id", "kinds", "starts", "ends"],
            )

    narrow = dealt(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text")
    return narrow.mapInArrow(scan, FOUND)


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    found = find(table(spark, sf_dir, "documents")).selectExpr("doc_id", "arrays_zip(kinds, starts, ends) found")
    joined = "array_join(transform({}, x -> concat_ws(':', x.kinds, x.starts, x.ends)), ',')"
    return found.selectExpr(
        "doc_id",
        *(f"cast(size(filter(found, x -> x.kinds = '{r.kind}')) as long) n_{r.kind}" for r in BASE),
        f"sha2({joined.format(f'filter(found, x -> x.kinds in ({base}))')}, 256) base_sha256",
        f"{joined.format('found')} spans",
    )


def _sql() -> str:
    """The same by searching each pattern alone: matches and what lies between them give the places."""
    def one(k: int, r: Rule) -> str:
        # Cases are spelled out: a flag would fold letters beyond ASCII too.
        pattern = re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", r.pattern.split(")")[0]) + ")" + r.pattern.split(")", 1)[1] if r.fold else r.pattern
        quoted = pattern.replace("'", "''")
        length = f"length(regexp_extract(m, '{quoted}', {r.group}))" if r.group else "length(m)"
        return f"""SELECT row, {k} AS k, '{r.kind}' AS kind, {length} >= {r.least} AS good,
  list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0) AS s, s + length(m) AS e
  FROM (SELECT row, found, gaps, unnest(found) AS m, unnest(range(1, len(found) + 1)) AS i
    FROM (SELECT row, regexp_extract_all(text, '{quoted}') AS found, regexp_split_to_array(text, '{quoted}') AS gaps FROM d))"""

    spans = "\nUNION ALL ".join(one(k, r) for k, r in enumerate(RULES))
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{r.kind}" for k, r in enumerate(BASE))
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({spans}),
told AS (SELECT row, {counts}, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) FILTER (k < {len(BASE)}) AS base,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) AS spans FROM spans WHERE good GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (row)"""


OP11_SQL = _sql()
