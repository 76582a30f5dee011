"""Graph views, degrees, neighbourhoods and paths (G1-G6, Q4-Q6). Everything is by case."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casegraph.sources.shared import kept

OWNABLE = ("phone:", "account:", "device:", "vehicle:")


def pairs(edges: DataFrame) -> DataFrame:
    """(case_id, a, b, weight, distance, types, n): parallel and opposite edges as one pair."""
    ends = edges.filter("src <> dst").select("case_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight", "type")
    out = ends.groupBy("case_id", "a", "b").agg(F.sum("weight").alias("weight"), F.array_sort(F.collect_set("type")).alias("types"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("distance", 1 / F.greatest("weight", F.lit(1e-6)))


def pair_edges(edges: DataFrame) -> DataFrame:
    """The edge ids of each pair, apart from the pairs: ids stay out of the loops."""
    return edges.select("case_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "id")


def owners(edges: DataFrame, *, fold_devices: bool = False) -> DataFrame:
    """(case_id, identifier, owner): the person with the strongest claim; devices through their phone with ``fold_devices``."""
    claims = edges.filter("type in ('OWNS', 'REGISTERED_TO')")
    one = Window.partitionBy("case_id", "identifier").orderBy(F.col("confidence").desc(), "nat_key")
    held = claims.filter("src like 'person:%'").select("case_id", F.col("dst").alias("identifier"), F.col("src").alias("owner"), "confidence", "nat_key")
    held = held.filter(F.substring_index("identifier", ":", 1).isin("phone", "account", "device", "vehicle"))
    held = held.withColumn("k", F.row_number().over(one)).filter("k = 1").select("case_id", "identifier", "owner")
    if not fold_devices:
        return held
    devices = claims.filter("src like 'device:%'").select("case_id", F.col("src").alias("device"), F.col("dst").alias("identifier"), "confidence", "nat_key")
    through = devices.join(held, ["case_id", "identifier"]).select("case_id", F.col("device").alias("identifier"), "owner", "confidence", "nat_key")
    through = through.withColumn("k", F.row_number().over(one)).filter("k = 1").select("case_id", "identifier", "owner")
    return held.union(through.join(held, ["case_id", "identifier"], "left_anti"))


def project(pairs_: DataFrame, owner: DataFrame) -> DataFrame:
    """Pairs with identifiers folded into their owners; what then lies inside one owner goes."""
    oa = owner.select("case_id", F.col("identifier").alias("a"), F.col("owner").alias("oa"))
    ob = owner.select("case_id", F.col("identifier").alias("b"), F.col("owner").alias("ob"))
    folded = pairs_.join(oa, ["case_id", "a"], "left").join(ob, ["case_id", "b"], "left")
    folded = folded.select("case_id", F.coalesce("oa", "a").alias("x"), F.coalesce("ob", "b").alias("y"), "weight", "n").filter("x <> y")
    out = folded.groupBy("case_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))
    return out.withColumn("distance", 1 / F.greatest("weight", F.lit(1e-6)))


def absorbed(owner: DataFrame, *, limit: int | None = None) -> DataFrame:
    """(case_id, node, absorbed, n): the identifiers folded into each owner, all or the first ``limit`` by id, and how many they are. ``owner`` itself has them as rows."""
    listed = owner
    if limit is not None:
        listed = owner.withColumn("k", F.row_number().over(Window.partitionBy("case_id", "owner").orderBy("identifier"))).filter(F.col("k") <= limit)
    lists = listed.groupBy("case_id", F.col("owner").alias("node")).agg(F.array_sort(F.collect_list("identifier")).alias("absorbed"))
    return lists.join(owner.groupBy("case_id", F.col("owner").alias("node")).agg(F.count(F.lit(1)).alias("n")), ["case_id", "node"])


def both_ways(pairs_: DataFrame, *columns: str) -> DataFrame:
    """(case_id, u, v, ...): each pair from either end."""
    there = pairs_.select("case_id", F.col("a").alias("u"), F.col("b").alias("v"), *columns)
    return there.union(pairs_.select("case_id", F.col("b").alias("u"), F.col("a").alias("v"), *columns))


def degrees(pairs_: DataFrame) -> DataFrame:
    """(case_id, node, weighted degree, neighbours)."""
    return both_ways(pairs_, "weight").groupBy("case_id", F.col("u").alias("node")).agg(F.sum("weight").alias("weighted"), F.count(F.lit(1)).alias("neighbours"))


def hops(pairs_: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Q4: seeds (case_id, seed) -> (case_id, seed, node, hop), many seeds at once; a seed reaches itself at hop 0."""
    steps = both_ways(pairs_).distinct()
    reached = kept(seeds.select("case_id", "seed", F.col("seed").alias("node"), F.lit(0).alias("hop")).distinct(), "hops")
    frontier = reached
    for hop in range(1, depth + 1):
        new = frontier.join(steps, (frontier["case_id"] == steps["case_id"]) & (frontier["node"] == steps["u"])).select(frontier["case_id"], "seed", F.col("v").alias("node")).distinct()
        frontier = kept(new.join(reached, ["case_id", "seed", "node"], "left_anti").withColumn("hop", F.lit(hop)), "hops")
        reached = reached.union(frontier)
    return reached


def neighbourhood_edges(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Q4: (case_id, seed, id): the edges between nodes a seed reaches."""
    r = reached.select("case_id", "seed", "node")
    return edges.select("case_id", "id", "src", "dst").join(r.withColumnRenamed("node", "src"), ["case_id", "src"]).join(r.withColumnRenamed("node", "dst"), ["case_id", "seed", "dst"]).select("case_id", "seed", "id").distinct()


def simple_paths(pairs_: DataFrame, asked: DataFrame, *, max_hops: int = 6, limit: int = 5, through: str = "not node like 'doc:%'") -> DataFrame:
    """Q5: asked (case_id, a, b) -> (case_id, a, b, path, hops, weight, rank): the ``limit`` shortest simple paths, then the heaviest.

    Paths of h hops are halves of h / 2 hops from both ends that meet in a node and share no other, so partial paths have half the length (three hops of six). A half is only grown while its end can
    still reach the other side in the hops left, and an asked pair stops at the length that completes enough paths: what is shorter is complete by then. Of each length only the best ``limit`` are kept.
    """
    steps = kept(both_ways(pairs_, "weight"), "steps")
    ends = kept(asked.select("case_id", F.col("a").alias("from"), F.col("b").alias("to")).distinct(), "asked")
    pair, sides = ["case_id", "from", "to"], {"from": "to", "to": "from"}
    # How far each node is from the other side.
    away = {side: kept(hops(pairs_, ends.select("case_id", F.col(other).alias("seed")).distinct(), max_hops).select("case_id", F.col("seed").alias(other), F.col("node").alias("v"), F.col("hop").alias("left")), "away") for side, other in sides.items()}
    halves = {side: [ends.select(*pair, F.array(side).alias("path"), F.lit(0.0).alias("weight"), F.col(side).alias("node"))] for side in sides}
    open_pairs, done = ends, None

    def grow(side: str) -> None:
        other, last = sides[side], halves[side][-1]
        n = len(halves[side])
        at = last.filter(F.col("node") != F.col(other)).join(open_pairs, pair, "left_semi")
        out = at.join(steps, (at["case_id"] == steps["case_id"]) & (at["node"] == steps["u"])).select(at["case_id"], "from", "to", "path", (at["weight"] + steps["weight"]).alias("weight"), "v")
        out = out.filter(~F.array_contains("path", F.col("v"))).filter((F.col("v") == F.col(other)) | F.expr(through.replace("node", "v")))
        out = out.join(away[side], ["case_id", other, "v"]).filter(F.col("left") <= max_hops - n)
        halves[side].append(kept(out.select(*pair, F.concat("path", F.array("v")).alias("path"), "weight", F.col("v").alias("node")), "halves"))

    order = lambda *first: Window.partitionBy(*pair).orderBy(*first, F.col("weight").desc(), F.array_join("path", ">"))
    for h in range(1, max_hops + 1):
        there, back = h - h // 2, h // 2
        for side, n in (("from", there), ("to", back)):
            if len(halves[side]) <= n:
                grow(side)
        x = halves["from"][there].join(open_pairs, pair, "left_semi")
        y = halves["to"][back].select(*pair, F.col("path").alias("rest"), F.col("weight").alias("more"), "node")
        met = x.join(y, [*pair, "node"]).filter(F.size(F.array_intersect("path", "rest")) == 1)
        whole = F.concat("path", F.reverse(F.slice("rest", F.lit(1), F.size("rest") - 1)))
        level = met.select(*pair, whole.alias("path"), (F.col("weight") + F.col("more")).alias("weight"), F.lit(h).alias("hops"))
        level = kept(level.withColumn("k", F.row_number().over(order())).filter(F.col("k") <= limit).drop("k"), "paths")
        done = level if done is None else done.union(level)
        full = done.groupBy(*pair).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= limit)
        open_pairs = kept(ends.join(full, pair, "left_anti"), "open")
        if open_pairs.isEmpty():
            break
    ranked = done.withColumn("rank", F.row_number().over(order("hops"))).filter(F.col("rank") <= limit)
    return ranked.select("case_id", F.col("from").alias("a"), F.col("to").alias("b"), "path", "hops", "weight", "rank")


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Q6: (case_id, a, b, rank, edge_ids): the edges along each path, in order of id."""
    links = paths.select("case_id", "a", "b", "rank", F.explode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("x"), F.slice("path", F.lit(2), F.size("path") - 1).alias("y"))).alias("s"))
    links = links.select("case_id", F.col("a").alias("from"), F.col("b").alias("to"), "rank", F.least("s.x", "s.y").alias("a"), F.greatest("s.x", "s.y").alias("b"))
    return links.join(pair_edges(edges), ["case_id", "a", "b"]).groupBy("case_id", F.col("from").alias("a"), F.col("to").alias("b"), "rank").agg(F.array_sort(F.collect_list("id")).alias("edge_ids"))
