"""Ranks, closures, components and neighbourhoods of graphs of edges (a, b). Rounds are written between, so that a round's
plan is one join and one aggregate however many rounds there are; adjacency is written once, dealt by its first node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .lineage import beside, bucket_labels, bucketed, dropped, written


def adjacency(pairs: DataFrame) -> DataFrame:
    """(a, b, deg) of every pair both ways, each once."""
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    deg = both.groupBy("a").agg(F.count(F.lit(1)).alias("deg"))
    return written(both.join(deg, "a").repartition("a"), "edges")


def rank_lossy(pairs: DataFrame, is_seed: Column, iterations: int = 12, damping: float = 0.85, teleport: float = 0.15) -> DataFrame:
    """(node, rank): each seed begins with 1 and gets `teleport` in every round, whatever their number; what a node without
    edges holds is lost. is_seed is a condition on node. Nodes of rank 0 are not carried."""
    edges = adjacency(pairs)
    nodes = edges.select(F.col("a").alias("node")).distinct()
    seeds = written(nodes.where(is_seed))
    rank = seeds.select("node", F.lit(1.0).alias("rank"))
    for i in range(iterations):
        moved = edges.join(rank, edges["a"] == rank["node"]).select(F.col("b").alias("node"), (damping * F.col("rank") / F.col("deg")).alias("rank"))
        new = moved.union(seeds.select("node", F.lit(teleport).alias("rank"))).groupBy("node").agg(F.sum("rank").alias("rank"))
        new = written(new) if i % 4 == 3 or i == iterations - 1 else new
        rank = new
    return nodes.join(rank, "node", "left").select("node", F.coalesce("rank", F.lit(0.0)).alias("rank"))


#: Edges of a cell, of which there are CELLS (by first node, by second node) at most.
CELL_EDGES, CELLS = 2_000_000, (4, 6)


def rank_conserved(edges: DataFrame, reset: DataFrame, damping: float = 0.5, most: int = 100, tolerance: float = 1e-10) -> DataFrame:
    """(node, rank) of weighted directed edges (a, b, weight) and reset (node, reset), which is made to sum to 1: what nodes
    without outgoing edges hold goes back by reset, until the sum of changes is below tolerance. Each round is written; what
    such nodes hold and how much has changed is observed while it is.

    Edges are dealt once to cells, by a class of each of their nodes. A round sends a node's share to the cells of its class,
    and of each cell the sums by second node: some ten rows for a node, however many edges it has."""
    spark = edges.sparkSession
    reset = written(reset.select("node", F.col("reset").cast("double").alias("reset")), "reset")
    total = reset.agg(F.sum("reset")).first()[0] or 0.0
    if not total:
        return reset.select("node", F.lit(0.0).alias("rank"))
    edges = written(edges.where("a is not null").select("a", "b", "weight"), "edges")
    many = edges.count() > CELL_EDGES
    rows, columns = CELLS if many else (1, 1)
    labels = bucket_labels(spark, rows * columns)
    row = lambda c: F.pmod(F.xxhash64(c), F.lit(rows)).cast("int")
    at = F.element_at(F.array(*map(F.lit, labels)), row(F.col("a")) * columns + F.pmod(F.xxhash64("b"), F.lit(columns)).cast("int") + 1)
    moves = bucketed(edges.withColumn("cell", at), "cell", len(labels), "a", "cells")
    dropped(edges)
    none = F.lit(None).cast("double")
    ends = moves.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("out")).withColumn("reset", none)
    ends = ends.union(moves.select("b").distinct().select(F.col("b").alias("node"), none.alias("out"), none.alias("reset"))).union(reset.select("node", none.alias("out"), "reset"))
    base = ends.groupBy("node").agg(F.sum("out").alias("out"), (F.coalesce(F.sum("reset"), F.lit(0.0)) / total).alias("reset"))

    def kept(x: DataFrame) -> tuple[DataFrame, float, float]:
        seen = Observation()
        held = F.sum(F.when(F.col("out").isNull(), F.col("rank"))).alias("held")
        x = written(x.observe(seen, held, F.sum(F.abs(F.col("rank") - F.col("old"))).alias("change")).drop("old"), "ranks")
        return x, seen.get["held"] or 0.0, seen.get["change"] or 0.0

    x, held, _ = kept(base.withColumns({"rank": F.col("reset"), "old": F.lit(0.0)}))
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    was = spark.conf.get(setting)
    spark.conf.set(setting, "false")  # rows of a cell are together: they need not be dealt out by their nodes too
    try:
        for _ in range(most):
            cells = F.slice(F.array(*map(F.lit, labels)), row(F.col("node")) * columns + 1, columns)
            sent = x.where("out is not null and rank <> 0").select(F.explode(cells).alias("cell"), F.col("node").alias("a"), (F.col("rank") / F.col("out")).alias("share"))
            sent = sent.repartition(len(labels), "cell").hint("shuffle_hash")
            moved = moves.join(sent, ["cell", "a"]).groupBy(F.col("b").alias("node")).agg(F.sum(F.col("share") * F.col("weight")).alias("moved"))
            rank = (1 - damping) * F.col("reset") + damping * (F.coalesce("moved", F.lit(0.0)) + F.lit(held) * F.col("reset"))
            before = x
            x, held, change = kept(x.select("node", "out", "reset", F.col("rank").alias("old")).join(moved, "node", "left").select("node", "out", "reset", rank.alias("rank"), "old"))
            dropped(before)
            if change < tolerance:
                break
    finally:
        spark.conf.set(setting, was)
    dropped(moves, reset)
    return x.select("node", "rank")


def reached(edges: DataFrame, seeds: DataFrame, hops: int | None = None) -> DataFrame:
    """(node, hop) of all nodes that directed edges (a, b) lead to from seeds (node), with the fewest hops; hops bounds
    them. Each round joins the newest nodes alone."""
    found = written(seeds.select("node").distinct().withColumn("hop", F.lit(0)))
    front, parts, hop = found, [found], 0
    n = total = found.count()
    while hops is None or hop < hops:
        hop += 1
        old = parts[0]
        for p in parts[1:]:
            old = old.union(p)
        new = edges.join(beside(front, n), edges["a"] == front["node"]).select(F.col("b").alias("node")).distinct().join(beside(old, total), "node", "left_anti").withColumn("hop", F.lit(hop))
        front = written(new)
        n = front.count()
        if not n:
            break
        total += n
        parts.append(front)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def erased(sources: DataFrame, roots: DataFrame) -> DataFrame:
    """(id) of the roots and of all derived rows none of whose sources (id, source) is left: a round takes those whose
    last source went in the rounds before."""
    gone = written(roots.select("id").distinct())
    need = written(sources.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("need")))
    pairs = written(sources.distinct().repartition("source"))
    while True:
        lost = pairs.join(gone.select(F.col("id").alias("source")), "source").groupBy("id").agg(F.count(F.lit(1)).alias("lost"))
        new = written(lost.join(need, "id").where("lost = need").select("id").join(gone, "id", "left_anti"))
        if new.isEmpty():
            return gone
        both = written(gone.union(new))
        dropped(gone, new)
        gone = both


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node of pairs (a, b): root is the smallest node connected. Each round a node takes the least
    root near it and then that root's root, so that chains shorten by half, until nothing changes."""
    edges = adjacency(pairs)
    root = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")))
    while True:
        near = edges.join(root, edges["b"] == root["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = root.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        up = root.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = written(step.join(up, "root", "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root"), "old"))
        changed = not new.where("root <> old").isEmpty()
        dropped(root)
        root = new.select("node", "root")
        if not changed:
            return root
        root = written(root)
        dropped(new)


def ends(links: DataFrame) -> DataFrame:
    """(id, end) of links (id, next): the row that following next leads to in the end, itself where next is null. Each
    round doubles the steps taken, until none leads further; what is on a cycle, or leads to one, has no end."""
    now = written(links.select("id", F.coalesce("next", "id").alias("end")))
    for _ in range(62):
        on = now.select(F.col("id").alias("end"), F.col("end").alias("further"))
        new = written(now.join(on, "end", "left").select("id", F.coalesce("further", "end").alias("end"), (F.coalesce("further", "end") != F.col("end")).alias("moved")))
        dropped(now)
        now = new
        if now.where("moved").isEmpty():
            break
    goes_on = links.where("next is not null").select(F.col("id").alias("end"), F.lit(True).alias("cyclic"))
    return now.join(goes_on, "end", "left").select("id", F.when(F.col("cyclic").isNull(), F.col("end")).alias("end"))
