"""Audit chains, memory, conversations and answers."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegraph.functions.normalize import canonical_json

GENESIS = "0" * 64
ENTRY = ("action", "actor", "payload_sha256", "prev_hash", "ref", "seq", "ts")


def entry_hash(prev: Column) -> Column:
    """sha256 of the previous hash and the entry as canonical JSON."""
    return F.sha2(F.concat(prev, canonical_json(**{c: F.col(c) for c in ENTRY})), 256)


def append(new: DataFrame, tails: DataFrame) -> DataFrame:
    """L1: new entries (case_id, position, ts, actor, action, ref, payload_sha256) chained onto each case's tail (case_id, seq, hash).

    A chain is sequential within its case by definition, so a case's new entries meet in one task, which streams them in order; cases run in parallel.
    """
    seeded = new.join(tails.select("case_id", F.col("seq").alias("tail_seq"), F.col("hash").alias("tail_hash")), "case_id", "left")
    schema = "case_id string, seq long, ts string, actor string, action string, ref string, payload_sha256 string, prev_hash string, hash string"
    kinds = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in schema.split(", ")])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        case, seq, prev = None, 0, GENESIS
        for batch in batches:
            rows = []
            for e in batch.to_pylist():
                if e["case_id"] != case:
                    case, seq, prev = e["case_id"], e["tail_seq"] or 0, e["tail_hash"] or GENESIS
                seq += 1
                entry = {c: e[c] for c in ("action", "actor", "payload_sha256", "ref", "ts")} | {"prev_hash": prev, "seq": seq}
                prev = hashlib.sha256((prev + json.dumps(entry, sort_keys=True, separators=(",", ":"), ensure_ascii=False)).encode()).hexdigest()
                rows.append({"case_id": case, **entry, "hash": prev})
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return seeded.repartition("case_id").sortWithinPartitions("case_id", "position").mapInArrow(chain, schema)


def verify(chain: DataFrame) -> DataFrame:
    """L2: (case_id, entries, ok, broken_at, reason): the first gap, broken link or altered entry, by place in the chain.

    Entries are hashed where they are read; then each meets the one before it by (case, seq), so a case's entries are spread over all tasks. As places count from 1, the first gap shows as an entry
    without a successor (but for the last), a number twice, or a first number that is not 1; until then place and number are one.
    """
    told = chain.select("case_id", "seq", "hash", "prev_hash", (F.col("hash") == entry_hash(F.col("prev_hash"))).alias("good"))
    one = told.groupBy("case_id", "seq").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("good", "prev_hash", "hash")).alias("e"))
    after = one.select("case_id", (F.col("seq") + 1).alias("seq"), F.col("e.hash").alias("before"))
    met = one.join(after, ["case_id", "seq"], "full")
    here, at = F.col("times").isNotNull(), F.col("seq")
    known = F.coalesce("before", F.when(at == 1, F.lit(GENESIS)))
    broken = F.when(here & (F.col("e.prev_hash") != known), F.struct(at.alias("place"), F.lit(1).alias("kind"))).when(here & ~F.coalesce(F.col("e.good"), F.lit(False)), F.struct(at.alias("place"), F.lit(2).alias("kind")))
    by_case = met.groupBy("case_id").agg(
        F.sum("times").alias("entries"), F.min(broken).alias("broken"), F.min(F.when(F.col("times") > 1, at + 1)).alias("twice"),
        F.min(F.when(~here, at)).alias("missing"), F.min(F.when(here, at)).alias("first"), F.max(F.when(here, at)).alias("last"),
    )
    gap = F.least(F.when(F.col("first") != 1, F.lit(1).cast("long")), F.col("twice"), F.when(F.col("missing") <= F.col("last"), F.col("missing")))
    worst = F.least(F.when(gap.isNotNull(), F.struct(gap.alias("place"), F.lit(0).alias("kind"))), F.col("broken"))
    reason = F.element_at(F.array(*map(F.lit, ("sequence gap", "broken link", "altered content"))), F.col("x.kind") + 1)
    out = by_case.select("case_id", "entries", worst.alias("x"))
    return out.select("case_id", "entries", F.col("x").isNull().alias("ok"), F.col("x.place").cast("int").alias("broken_at"), F.when(F.col("x").isNotNull(), reason).alias("reason"))


def latest(log: DataFrame, n: int, *, key: str = "case_id", order: str = "seq") -> DataFrame:
    """The last n entries of each key, oldest first by ``order``."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return log.withColumn("__k", k).filter(F.col("__k") <= n).drop("__k")


def memory_id(kind: Column, text: Column) -> Column:
    return F.sha2(F.concat(kind, F.lower(F.trim(text))), 256)


def remember(entries: DataFrame) -> DataFrame:
    """Entries (case_id, kind, text, status, confidence, at) merged by content: created first, last status and confidence."""
    keyed = entries.withColumn("id", memory_id(F.col("kind"), F.col("text")))
    last = [F.max_by(c, F.struct("at", c)).alias(c) for c in ("text", "status", "confidence")]
    return keyed.groupBy("case_id", "id", "kind").agg(*last, F.min("at").alias("created"), F.max("at").alias("updated"))


def conclusions(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (case_id, position, kind, text, status, confidence, at, actor, ts) -> what the memory keeps, and the audit rows that :func:`append` chains: each names its memory and the hash of what was said."""
    payload = F.sha2(canonical_json(kind=F.col("kind"), text=F.col("text"), status=F.col("status"), confidence=F.col("confidence")), 256)
    audit = entries.select("case_id", "position", "ts", "actor", F.lit("infer").alias("action"), memory_id(F.col("kind"), F.col("text")).alias("ref"), payload.alias("payload_sha256"))
    return remember(entries), audit


def uncleared(turns: DataFrame, cleared: DataFrame) -> DataFrame:
    """Turns after the last clearing of their conversation; cleared (case_id, seq)."""
    last = cleared.groupBy("case_id").agg(F.max("seq").alias("cleared"))
    return turns.join(last, "case_id", "left").filter("cleared is null or seq > cleared").drop("cleared")


def recall(memory: DataFrame, *, kind: str | None = None, status: str | None = None, text: str | None = None, limit: int = 50) -> DataFrame:
    """By kind, status and text, newest first."""
    if kind:
        memory = memory.filter(F.col("kind") == kind)
    if status:
        memory = memory.filter(F.col("status") == status)
    if text:
        memory = memory.filter(F.lower("text").contains(text.lower()))
    return memory.orderBy(F.col("updated").desc(), "id").limit(limit)


def close(memory: DataFrame, ids: DataFrame) -> DataFrame:
    """The listed memories closed."""
    done = ids.select("case_id", "id").distinct().withColumn("closed", F.lit(True))
    return memory.join(done, ["case_id", "id"], "left").withColumn("status", F.when(F.col("closed"), "closed").otherwise(F.col("status"))).drop("closed")


def merged_turns(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) -> runs of one role as one message; blank ones skipped, and what comes before the first user turn."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    said = turns.filter("trim(coalesce(text, '')) <> ''").withColumn("opened", F.max(F.when(F.col("role") == "user", 1).otherwise(0)).over(order)).filter("opened = 1")
    said = said.withColumn("change", F.when(F.lag("role").over(order) == F.col("role"), 0).otherwise(1)).withColumn("run", F.sum("change").over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n")
    return said.groupBy("conv_id", "run", "role").agg(text.alias("text"), F.count(F.lit(1)).alias("turns"))


def referents(turns: DataFrame, nodes: DataFrame, *, limit: int = 8) -> DataFrame:
    """Turns (case_id, seq, role, node_ids) -> the entities of the latest assistant turn, the first few, with labels."""
    last = turns.filter("role = 'assistant' and size(node_ids) > 0").groupBy("case_id").agg(F.max_by("node_ids", "seq").alias("ids"))
    named = last.select("case_id", F.posexplode(F.slice("ids", 1, limit)).alias("place", "id"))
    return named.join(nodes.select("case_id", "id", "label"), ["case_id", "id"], "left")


def fresh_findings(findings: DataFrame, briefed: DataFrame, *, limit: int = 8) -> DataFrame:
    """Findings whose headline was not told before, the first few by rank."""
    new = findings.join(briefed.select("case_id", "headline"), ["case_id", "headline"], "left_anti")
    return new.withColumn("k", F.row_number().over(Window.partitionBy("case_id").orderBy("rank"))).filter(F.col("k") <= limit)


#: The kind of claim that has to rest on the case; an answer that doesn't say is one.
EVIDENCE = "evidence"


def verify_citations(answers: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Answers (case_id, answer_id, claim_type, confidence, cited_nodes, cited_edges, highlight_path) against the nodes (case_id, id) and edges (case_id, id) of their cases.

    Ids that are not there leave their list, in place, and are told as dropped_nodes and dropped_edges; a path only loses them. An answer is ok if nothing was dropped and a node is left: of evidence
    only a node will do, other kinds of claim need none. One that is not ok has low confidence; caveats say why.
    """
    slots = {"cited_nodes": "node", "cited_edges": "edge", "highlight_path": "node"}
    keys = ["case_id", "answer_id"]

    def placed(slot: str, kind: str) -> Column:
        ids = F.coalesce(slot, F.array().cast("array<string>"))
        return F.transform(ids, lambda x, i: F.struct(F.lit(slot).alias("slot"), F.lit(kind).alias("kind"), i.alias("place"), x.alias("id")))

    each = F.flatten(F.array(*(placed(slot, kind) for slot, kind in slots.items())))
    cited = answers.select(*keys, F.explode(each).alias("x")).select(*keys, "x.*")
    known = nodes.select("case_id", F.lit("node").alias("kind"), "id").union(edges.select("case_id", F.lit("edge").alias("kind"), "id")).distinct().withColumn("known", F.lit(True))
    met = cited.join(known, ["case_id", "kind", "id"], "left")
    listed = lambda slot, good: F.transform(
        F.array_sort(F.collect_list(F.when((F.col("slot") == slot) & (F.col("known").isNotNull() if good else F.col("known").isNull()), F.struct("place", "id")))), lambda x: x["id"]
    )
    lists = met.groupBy(*keys).agg(
        listed("cited_nodes", True).alias("cited_nodes"), listed("cited_edges", True).alias("cited_edges"), listed("highlight_path", True).alias("highlight_path"),
        listed("cited_nodes", False).alias("dropped_nodes"), listed("cited_edges", False).alias("dropped_edges"),
    )
    out = answers.drop(*slots).join(lists, keys, "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, none) for c in (*slots, "dropped_nodes", "dropped_edges")}).withColumn("claim_type", F.coalesce("claim_type", F.lit(EVIDENCE)))
    dropped, bare = F.size("dropped_nodes") + F.size("dropped_edges") > 0, (F.size("cited_nodes") == 0) & (F.col("claim_type") == EVIDENCE)
    return out.withColumn("ok", ~dropped & ~bare).withColumn("confidence", F.when(F.col("ok"), F.col("confidence")).otherwise("low"))


def caveats(verified: DataFrame) -> DataFrame:
    """Verified answers with what to warn of: ids that were dropped, nodes first, and evidence without a node; after the answer's own."""
    ids = F.concat("dropped_nodes", "dropped_edges")
    dropped = F.when(F.size(ids) > 0, F.concat(F.lit("dropped unknown ids: "), F.array_join(ids, ", ")))
    bare = F.when((F.size("cited_nodes") == 0) & (F.col("claim_type") == EVIDENCE), "cites nothing known")
    own = F.coalesce("caveats", F.array().cast("array<string>")) if "caveats" in verified.columns else F.array().cast("array<string>")
    return verified.withColumn("caveats", F.concat(own, F.array_compact(F.array(dropped, bare))))


def bounded(lists: DataFrame, column: str, *, limit: int = 40) -> DataFrame:
    """A list cut to ``limit`` items, with its true size."""
    return lists.withColumn("total", F.size(column)).withColumn(column, F.slice(column, 1, limit))
