"""Substring deduplication on words with suffix automata and matching statistics.

:mod:`repeats` brings every place where ``window`` words can repeat to the shard of its anchor. There the earlier segments are
the reference: a suffix automaton of their words grows in document order, and each segment is streamed past it before it is
added. The automaton's state gives the longest match that ends at each word (the matching statistics); wherever it is
``window`` or longer, the window that ends there starts earlier too. The union of those windows are the maximal
spans to remove.

The reference shards are not broadcast one after another: all reference text together grows with the corpus, and
every document would meet every shard, which is quadratic. A segment goes to the one shard that can match it, so both
sides are small in every task, and the result is the same.

Defined results: null text has no words; texts shorter than the window are unchanged; repeated rows (same id and text) are
one document and get the same result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from casegraph.llm.common import table
from casegraph.llm.repeats import Words, keyed, repeated_spans, with_spans

WINDOW, ANCHOR = 20, 6
SHARD_WORDS = 20_000


class SuffixAutomaton:
    """A suffix automaton of several word sequences, extended online."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _extend(self, last: int, word) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(word)) is not None:
            # The sequence so far is known already: at most a split is needed.
            return q if length[q] == length[last] + 1 else self._split(last, q, word)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p != -1:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, word)
        return new

    def _split(self, p: int, q: int, word) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and nxt[p].get(word) == q:
            nxt[p][word] = clone
            p = link[p]
        return clone

    def add(self, words: list) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def matching_statistics(self, words: list) -> list[int]:
        """For each place, the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.length
        state, n, out = 0, 0, []
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            if (to := nxt[state].get(w)) is not None:
                state, n = to, n + 1
            out.append(n)
        return out


def matcher(window: int, shard_words: int = SHARD_WORDS):
    """Rows (key, __doc, at, lo, n, piece) sorted by key, __doc, at -> (__doc, start, end) of windows that start earlier too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, last = SuffixAutomaton(), 0, None
        for batch in batches:
            kind = batch.schema.field("__doc").type
            docs, starts, ends = [], [], []
            for key, doc, lo, piece in zip(*(batch.column(c).to_pylist() for c in ("key", "__doc", "lo", "piece")), strict=True):
                if key != last and held >= shard_words:
                    shard, held = SuffixAutomaton(), 0
                last = key
                words = piece.split()
                run_from = None
                for end, n in enumerate(shard.matching_statistics(words), 1):
                    if n >= window and run_from is None:
                        run_from = end - window
                    elif n < window and run_from is not None:
                        docs.append(doc)
                        starts.append(lo + run_from)
                        ends.append(lo + end - 1)
                        run_from = None
                if run_from is not None:
                    docs.append(doc)
                    starts.append(lo + run_from)
                    ends.append(lo + len(words))
                shard.add(words)
                held += len(words)
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(docs, kind), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["__doc", "start", "end"])

    return run


def word_spans(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, **limits) -> DataFrame:
    """keyed() docs -> (__doc, start, end) in words of all windows that start earlier too."""
    return repeated_spans(docs, Words, window, anchor, matcher(window), keep_first=True, **limits)


def word_digest(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, str]:
    words = text.split()
    kept, at = [], 0
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        kept += words[at:s]
        at = e
    kept += words[at:]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keyed(table(spark, sf_dir, "documents"))
    return with_spans(docs, word_spans(docs), word_digest, "n_words long, n_removed long, kept_sha256 string", ("doc_id",))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
f AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM g) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, s + j AS i FROM f, (SELECT unnest(range(20)) AS j)),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept, count(*) AS n FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i WHERE c.i IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
