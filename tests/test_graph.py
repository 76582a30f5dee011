import random
from collections import deque
from functools import reduce
from itertools import combinations

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph import plans
from casegraph.operators import anomalies, caselog, findings, graph, iterative, mentions


def graph_of(spark, edges, case="c"):
    rows = [(case, min(a, b), max(a, b), float(w), 1.0 / w) for a, b, w in edges]
    return spark.createDataFrame(rows, "case_id string, a string, b string, weight double, distance double")


PATH = [("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("d", "e", 1)]
STAR = [("hub", x, 1) for x in "vwxyz"]
BARBELL = [(*p, 1) for p in combinations(["a1", "a2", "a3", "a4"], 2)] + [(*p, 1) for p in combinations(["b1", "b2", "b3", "b4"], 2)] + [("a1", "b1", 1)]
TRIANGLE = [("a", "b", 4), ("b", "c", 4), ("a", "c", 1)]  # the detour over b is shorter


def brute_betweenness(edges):
    """Counts shortest paths by listing all simple ones."""
    near = {}
    for a, b, w in edges:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = round(1 / w, 12)
    score = dict.fromkeys(near, 0.0)
    for s, t in combinations(near, 2):
        found, queue = [], deque([([s], 0.0)])
        while queue:
            path, d = queue.popleft()
            if path[-1] == t:
                found.append((round(d, 9), path))
                continue
            queue += [([*path, n], d + x) for n, x in near[path[-1]].items() if n not in path]
        if found:
            best = [p for d, p in found if d == min(found)[0]]
            for p in best:
                for n in p[1:-1]:
                    score[n] += 1 / len(best)
    n = len(near)
    return {k: v * 2 / ((n - 1) * (n - 2)) for k, v in score.items()}


@pytest.mark.parametrize("limit", [10**6, 0])
def test_betweenness_of_several_cases_at_once(spark, limit):
    graphs = {"path": PATH, "star": STAR, "barbell": BARBELL, "triangle": TRIANGLE}
    rows = reduce(DataFrame.union, [graph_of(spark, edges, case) for case, edges in graphs.items()])
    got = {(r.case_id, r.node): r.betweenness for r in iterative.betweenness(rows, case_pairs=limit).collect()}
    assert got == pytest.approx({(case, n): v for case, edges in graphs.items() for n, v in brute_betweenness(edges).items()})


def test_unfinished_distances_are_an_error(spark):
    with pytest.raises(RuntimeError):
        iterative.betweenness(graph_of(spark, PATH), max_rounds=2, case_pairs=0)


def test_sampled_betweenness_is_flagged(spark):
    got = iterative.betweenness(graph_of(spark, BARBELL), exact_to=4, pivots=3).collect()
    assert all(r.estimated for r in got) and len(got) == 8


@pytest.mark.parametrize("limit", [10**6, 0])
def test_pagerank_sums_to_one_by_case(spark, limit):
    both = graph_of(spark, BARBELL).union(graph_of(spark, STAR, "d"))
    got = iterative.pagerank(both, case_pairs=limit)
    assert [round(r.s, 6) for r in got.groupBy("case_id").agg(F.sum("rank").alias("s")).collect()] == [1.0, 1.0]
    assert got.filter("case_id = 'd'").orderBy(F.desc("rank")).first().node == "hub"


@pytest.mark.parametrize("limit", [10**6, 0])
def test_a_case_that_does_not_settle_leaves_the_others_alone(spark, limit):
    alone = {r.node: r["rank"] for r in iterative.pagerank(graph_of(spark, BARBELL), iterations=30).collect()}
    both = iterative.pagerank(graph_of(spark, BARBELL).union(graph_of(spark, STAR, "d")), iterations=30, case_pairs=limit).collect()
    assert {r.node: r["rank"] for r in both if r.case_id == "c"} == pytest.approx(alone) and len(set(alone.values())) > 1
    assert {r["rank"] for r in both if r.case_id == "d"} == {1 / 6}


def test_sampled_betweenness_ranks_like_the_exact(spark):
    rng = random.Random(8)
    edges = {tuple(sorted((f"n{i}", f"n{int(i * rng.random() ** 2)}"))) for i in range(1, 700) for _ in range(3)}
    pairs = graph_of(spark, [(a, b, rng.randint(1, 4)) for a, b in sorted(edges) if a != b])  # sorted: sets of text differ from run to run
    exact = {r.node: r.betweenness for r in iterative.betweenness(pairs, exact_to=10**6).collect()}
    drawn = {r.node: (r.betweenness, r.estimated) for r in iterative.betweenness(pairs).collect()}
    assert all(e for _, e in drawn.values()) and exact.keys() == drawn.keys()
    rank = lambda score: {n: i for i, n in enumerate(sorted(score, key=lambda n: (score[n], n)))}
    x, y, n = rank(exact), rank({k: v for k, (v, _) in drawn.items()}), len(exact)
    assert 1 - 6 * sum((x[k] - y[k]) ** 2 for k in x) / (n * (n * n - 1)) > 0.9
    top = sorted(exact, key=exact.get)[-20:]
    assert len(set(top) & set(sorted(drawn, key=lambda k: drawn[k][0])[-20:])) >= 15


def modularity(edges, of):
    total, inside, strength = sum(w for *_, w in edges), 0.0, {}
    for a, b, w in edges:
        inside += w * (of[a] == of[b])
        for n in (a, b):
            strength[of[n]] = strength.get(of[n], 0) + w
    return inside / total - sum((s / (2 * total)) ** 2 for s in strength.values())


@pytest.mark.parametrize("limit", [10**6, 0])
def test_communities_reach_the_planted_modularity(spark, limit):
    rng = random.Random(9)
    edges = [(f"{min(i, j):03d}", f"{max(i, j):03d}", 1) for i in range(120) for j in range(i) if rng.random() < (0.4 if i % 6 == j % 6 else 0.01)]
    got = {r.node: r.community for r in iterative.communities(graph_of(spark, edges), case_pairs=limit).collect()}
    planted = {n: int(n) % 6 for n in got}
    assert modularity(edges, got) > 0.97 * modularity(edges, planted) > 0.6


@pytest.mark.parametrize("limit", [10**6, 0])
def test_communities_find_cliques(spark, limit):
    got = {r.node: r.community for r in iterative.communities(graph_of(spark, BARBELL), case_pairs=limit).collect()}
    assert len(got) == 8 and len({got[x] for x in ("a1", "a2", "a3", "a4")}) == 1 and len({got[x] for x in ("b1", "b2", "b3", "b4")}) == 1 and got["a1"] != got["b1"]


def plain_louvain(edges):
    """Nodes in turn move to the community that raises modularity most, computed anew each time; then communities become nodes."""
    of = {n: n for e in edges for n in e[:2]}
    while True:
        level = {}
        for a, b, w in edges:
            key = tuple(sorted((of[a], of[b])))
            level[key] = level.get(key, 0) + w
        level, names = [(a, b, w) for (a, b), w in level.items()], sorted(set(of.values()))
        at, moved, going = {n: n for n in names}, False, True
        while going:
            going = False
            for n in names:
                near = {at[b if a == n else a] for a, b, _ in level if n in (a, b)} | {at[n]}
                best = max(sorted(near), key=lambda c: (round(modularity(level, {**at, n: c}), 12), c == at[n]))
                if best != at[n]:
                    at[n], moved, going = best, True, True
        if not moved:
            return of
        of = {n: at[c] for n, c in of.items()}


@pytest.mark.parametrize("limit", [10**6, 0])
@pytest.mark.parametrize("kind", ["groups", "weights", "tree"])
def test_communities_are_as_good_as_plain_louvain(spark, kind, limit):
    rng = random.Random(kind)
    if kind == "groups":
        edges = [(f"{j:02d}", f"{i:02d}", 1) for i in range(40) for j in range(i) if rng.random() < (0.5 if i % 4 == j % 4 else 0.03)]
    elif kind == "weights":
        edges = [(f"{j:02d}", f"{i:02d}", rng.randint(1, 9)) for i in range(30) for j in range(i) if rng.random() < 0.15]
    else:
        edges = [(f"{i // 2:02d}", f"{i:02d}", 1) for i in range(2, 50)]
    got = {r.node: r.community for r in iterative.communities(graph_of(spark, edges), case_pairs=limit).collect()}
    assert modularity(edges, got) >= 0.99 * modularity(edges, plain_louvain(edges)) > 0.2


def test_a_huge_case_beside_many_small_ones(spark):
    """Only the case over the limit leaves the fast path; all have the same results as alone."""
    many = graph_of(spark, BARBELL).drop("case_id").crossJoin(spark.range(300).select(F.concat(F.lit("s"), "id").alias("case_id")))
    rng = random.Random(5)
    big = graph_of(spark, sorted({(f"n{int(i * rng.random()):02d}", f"n{i:02d}", 1) for i in range(1, 40) for _ in range(2)}), "big")
    both = many.select(*big.columns).union(big)
    assert big.count() > 20
    got = {(r.case_id, r.node): r.betweenness for r in iterative.betweenness(both, case_pairs=20).collect()}
    want = {(r.case_id, r.node): r.betweenness for r in iterative.betweenness(both).collect()}
    assert got == pytest.approx(want) and len(got) == 300 * 8 + len({n for c, n in got if c == "big"})
    named = iterative.communities(both, case_pairs=20).filter("case_id <> 'big'").groupBy("case_id").agg(F.count_distinct("community").alias("n"))
    assert {r.n for r in named.collect()} == {2} and named.count() == 300


def test_long_chains_are_followed_pivot_by_pivot(spark):
    """More steps than rounds: the exact betweenness of a path's i-th node of n is 2 i (n - 1 - i) / ((n - 1) (n - 2))."""
    n = 150
    got = {int(r.node): r.betweenness for r in iterative.betweenness(graph_of(spark, [(f"{i:03d}", f"{i + 1:03d}", 1) for i in range(n - 1)])).collect()}
    assert got == pytest.approx({i: 2 * i * (n - 1 - i) / ((n - 1) * (n - 2)) for i in range(n)})


def test_empty_graph(spark):
    none = graph_of(spark, PATH).filter("false")
    assert iterative.pagerank(none).count() == iterative.betweenness(none).count() == iterative.communities(none).count() == 0


@pytest.mark.parametrize(("query", "job"), [("g8_g9_betweenness", "betweenness"), ("g10_communities", "communities")])
def test_iterative_queries_take_all_orders(spark, sf_dir, monkeypatch, query, job):
    given = []
    monkeypatch.setattr(iterative, job, lambda pairs: given.append(pairs) or pairs.selectExpr("case_id", "a as node", "weight as betweenness", "true as estimated"))
    plans.queries()[query](spark, sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey")).count()
    assert given[0].agg(F.sum("weight")).first()[0] == 2 * lines


def test_simple_paths_are_the_shortest(spark):
    rng = random.Random(3)
    edges = {tuple(sorted(rng.sample("abcdefgh", 2))) for _ in range(14)}
    edges = [(a, b, rng.randint(1, 3)) for a, b in edges]
    asked = spark.createDataFrame([("c", "a", "h")], "case_id string, a string, b string")
    got = [(r.hops, -r.weight, r.path) for r in graph.simple_paths(graph_of(spark, edges), asked, max_hops=5, limit=4).orderBy("rank").collect()]
    weight = {frozenset((a, b)): w for a, b, w in edges}
    want, queue = [], deque([["a"]])
    while queue:
        p = queue.popleft()
        if p[-1] == "h":
            want.append((len(p) - 1, -float(sum(weight[frozenset(x)] for x in zip(p, p[1:]))), p))
        elif len(p) <= 5:
            queue += [[*p, n] for n in "abcdefgh" if n not in p and frozenset((p[-1], n)) in weight]
    assert got == sorted(want)[:4]


def test_paths_past_hubs(spark):
    """Two hubs of 20,000 leaves each between the asked nodes: halves stay as many as edges, and a path through a hub twice is none."""
    leaves = spark.range(20_000).select(F.concat(F.lit("leaf"), "id").alias("b"))
    hubs = [leaves.select(F.lit("c").alias("case_id"), F.lit(h).alias("a"), "b", F.lit(1.0).alias("weight"), F.lit(1.0).alias("distance")) for h in ("hub1", "hub2")]
    few = graph_of(spark, [("a", "hub1", 2), ("hub2", "z", 3)])
    pairs = few.select("case_id", "a", "b", "weight", "distance").union(hubs[0]).union(hubs[1])
    asked = spark.createDataFrame([("c", "a", "z")], "case_id string, a string, b string")
    got = graph.simple_paths(pairs, asked, max_hops=6, limit=3).orderBy("rank").collect()
    assert [(r.hops, r.weight, r.path[2]) for r in got] == [(4, 7.0, "leaf0"), (4, 7.0, "leaf10000"), (4, 7.0, "leaf10001")]


def test_hops_and_document_nodes(spark):
    p = graph_of(spark, [*PATH, ("a", "doc:x", 1), ("doc:x", "e", 1)])
    seeds = spark.createDataFrame([("c", "a")], "case_id string, seed string")
    assert {r.node: r.hop for r in graph.hops(p, seeds, 2).collect()} == {"a": 0, "b": 1, "doc:x": 1, "c": 2, "e": 2}
    asked = spark.createDataFrame([("c", "a", "e")], "case_id string, a string, b string")
    assert [r.path for r in graph.simple_paths(p, asked).collect()] == [["a", "b", "c", "d", "e"]]


def test_chain_breaks_are_found(spark):
    rows = [(c, i, "2024", "me", "ingest", None if i % 2 else f"doc:{i}", "ab") for c in "xyz" for i in range(5)]
    new = spark.createDataFrame(rows, "case_id string, position long, ts string, actor string, action string, ref string, payload_sha256 string")
    chain = caselog.append(new, spark.createDataFrame([], "case_id string, seq long, hash string"))
    bad = chain.withColumn("actor", F.when((F.col("case_id") == "y") & (F.col("seq") == 4), "other").otherwise(F.col("actor"))).filter("not (case_id = 'z' and seq = 2)")
    got = {r.case_id: (r.ok, r.broken_at, r.reason) for r in caselog.verify(bad).collect()}
    assert got == {"x": (True, None, None), "y": (False, 4, "altered content"), "z": (False, 2, "sequence gap")}


def test_swap_and_hidden_broker(spark):
    rows = [("c", "device:1", "phone:1", "REGISTERED_TO", None, None), ("c", "device:1", "phone:2", "REGISTERED_TO", None, None), ("c", "device:2", "phone:3", "REGISTERED_TO", None, None)]
    e = spark.createDataFrame(rows, "case_id string, src string, dst string, type string, ts timestamp, amount double")
    assert [r.node_ids for r in anomalies.handset_swaps(e).collect()] == [["device:1", "phone:1", "phone:2"]]
    p = graph_of(spark, [(f"person:a{i}", f"person:a{j}", 1) for i, j in combinations(range(3), 2)] + [(f"person:b{i}", f"person:b{j}", 1) for i, j in combinations(range(3), 2)] + [("person:x", "person:a0", 1), ("person:x", "person:b0", 1)])
    named = spark.createDataFrame([("c", f"person:{g}{i}", "doc:1") for g in "ab" for i in range(3)], "case_id string, node string, doc_id string")
    docs = spark.createDataFrame([("c", "doc:1", "fir")], "case_id string, doc_id string, kind string")
    found = findings.hidden_brokers(iterative.betweenness(p), graph.degrees(p), findings.reported(named, docs)).collect()
    assert [r.node_ids for r in found] == [["person:x"]]


def prose(spark, text):
    return spark.createDataFrame([("c", "d", text)], "case_id string, doc_id string, text string")


def test_nearest_person_owns_the_phone(spark):
    docs = prose(spark, "Während one Ram Kumar was seen with one Gurpreet Singh (mob. 9876543210). Accused Manjit Singh. Accused Sukhwinder left.")
    found = mentions.mentions(docs)
    assert {r.node_id for r in found.collect()} == {"person:ram_kumar", "person:gurpreet_singh", "phone:919876543210", "person:manjit_singh", "person:sukhwinder"}
    links = mentions.prose_links(found, spark.createDataFrame([("c", "d", 0.7)], "case_id string, doc_id string, factor double")).collect()
    assert [(r.src, r.dst, r.confidence) for r in links if r.type == "OWNS"] == [("person:gurpreet_singh", "phone:919876543210", 0.42)]
    text = docs.first().text
    for r in found.filter("kind = 'phone'").collect():
        assert text[r.start : r.end] == "9876543210"


def test_overlaps_and_dates(spark):
    found = mentions.identifiers(prose(spark, "IMEI 359881234567890 and A/C No. 12345678901, mail ram@okaxis"))
    assert sorted((r.kind, r.value) for r in found.collect()) == [("account", "12345678901"), ("imei", "359881234567890"), ("upi", "ram@okaxis")]
    got = mentions.dates(prose(spark, "on 2024-03-05 at 10:30 pm, 13/25/2024, 02/13/24 and 5 March 2024"))
    assert sorted(str(r.ts) for r in got.collect()) == ["2024-02-13 00:00:00", "2024-03-05 00:00:00", "2024-03-05 22:30:00"]


def test_cases_of_several_million_pairs_need_no_joined_rounds(spark, monkeypatch):
    """Scaled down: cases over ``case_pairs``, up to five times as large, are settled in tasks by numbered nodes."""
    for rounds in ("_relaxed", "_moved", "_joined_ranks"):
        monkeypatch.setattr(iterative, rounds, lambda *a: pytest.fail("by joins"))
    graphs = {"path": PATH, "star": STAR, "barbell": BARBELL, "triangle": TRIANGLE}
    rows = reduce(DataFrame.union, [graph_of(spark, edges, case) for case, edges in graphs.items()])
    told = lambda df: {(r.case_id, r.node): r[2] for r in df.collect()}
    assert told(iterative.betweenness(rows, case_pairs=3)) == pytest.approx({(case, n): v for case, edges in graphs.items() for n, v in brute_betweenness(edges).items()})
    assert told(iterative.pagerank(rows, case_pairs=3)) == pytest.approx(told(iterative.pagerank(rows)))
    assert told(iterative.communities(rows, case_pairs=3)) == told(iterative.communities(rows))
    random.seed(3)
    edges = [(f"n{a}", f"n{b}", random.randint(1, 4)) for a, b in combinations(range(60), 2) if random.random() < 0.1]
    sampled = lambda limit: told(iterative.betweenness(graph_of(spark, edges), exact_to=10, pivots=20, case_pairs=limit))
    assert sampled(len(edges) - 1) == pytest.approx(sampled(10**6))


@pytest.mark.parametrize("group", [4096, 7])
def test_pairs_are_counted_without_being_shuffled(spark, group):
    random.seed(5)
    rows = [(random.choice("xyz"), random.choice([*range(60), None]), random.randint(0, 9000)) for _ in range(800)]
    points = spark.createDataFrame(rows, "k string, who long, at long")
    told = lambda df: sorted(map(tuple, df.collect()))
    out = mentions.pair_counts_within(points, keys=["k"], at="at", id_="who", within=20, group=group)
    want = mentions.pairs_within(points, keys=["k"], at="at", id_="who", within=20).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    assert told(out) == told(want) and want.count() > 100
    # Neither joined nor summed up by pairs.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
