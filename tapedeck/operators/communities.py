"""Communities of a weighted graph by moves that raise modularity, all by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapedeck.sources.shared import cut

#: A move must gain more than this; smaller gains are noise of sums in another order.
LEAST_GAIN = 1e-12


def _both_ways(edges: DataFrame, a: str, b: str, by: tuple[str, ...]) -> DataFrame:
    def name(c: str):
        return F.struct(*by, F.col(c).alias("name"))

    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)) & (F.col("weight") > 0)).select(name(a).alias("node"), name(b).alias("other"), "weight")
    return e.unionByName(e.select(F.col("other").alias("node"), F.col("node").alias("other"), "weight")).groupBy("node", "other").agg(F.sum("weight").alias("w"))


def _moves(links: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """node, to: moves that gain modularity and don't touch one another.

    labels: node, label, k (a node's weight) and m2 (twice that of all edges of its graph). Of neighbours that would move, the
    one that gains most does; every other turn only one node enters a community.
    """
    own = labels.select("node", "label", "k", "m2")
    sums = labels.groupBy("label").agg(F.sum("k").alias("sum_k"))
    near = links.join(labels.select(F.col("node").alias("other"), F.col("label").alias("to")), "other").groupBy("node", "to").agg(F.sum("w").alias("w"))
    near = near.join(own, "node")
    stay = near.groupBy("node").agg(F.sum(F.when(F.col("to") == F.col("label"), F.col("w")).otherwise(0.0)).alias("w_own"))
    options = near.where("`to` <> label").join(stay, "node").join(sums.select(F.col("label").alias("to"), F.col("sum_k").alias("k_to")), "to").join(sums.withColumnRenamed("sum_k", "k_own"), "label")
    gain = F.round((F.col("w") - F.col("w_own")) / F.col("m2") - F.col("k") * (F.col("k_to") - F.col("k_own") + F.col("k")) / (F.col("m2") * F.col("m2")), 15)
    best = options.withColumn("gain", gain).where(F.col("gain") > LEAST_GAIN).groupBy("node").agg(F.max_by(F.struct("to", "gain"), F.struct("gain", F.xxhash64("to"))).alias("x"))
    # by gain, then by a hash that changes with the turn
    wish = best.select("node", F.col("x.to").alias("to"), F.struct(F.col("x.gain").alias("gain"), F.xxhash64(F.lit(turn), "node").alias("lot")).alias("rank"))
    ahead = links.join(wish.select("node", "rank"), "node").join(wish.select(F.col("node").alias("other"), F.col("rank").alias("others")), "other").where("others > rank").select("node").distinct()
    free = wish.join(ahead, "node", "left_anti")
    if turn % 2:
        return free.groupBy("to").agg(F.max_by("node", "rank").alias("node")).select("node", "to")
    return free.select("node", "to")


def modularity(links: DataFrame, labels: DataFrame) -> DataFrame:
    """What the labels' communities are worth in each graph: m2, modularity."""
    inside = links.join(labels.select("node", "label", "m2"), "node").join(labels.select(F.col("node").alias("other"), F.col("label").alias("other_label")), "other")
    inside = inside.groupBy("m2").agg(F.sum(F.when(F.col("label") == F.col("other_label"), F.col("w")).otherwise(0.0)).alias("w"))
    spread = labels.groupBy("m2", "label").agg(F.sum("k").alias("k")).groupBy("m2").agg(F.sum(F.col("k") * F.col("k")).alias("kk"))
    return inside.join(spread, "m2").select("m2", (F.col("w") / F.col("m2") - F.col("kk") / (F.col("m2") * F.col("m2"))).alias("modularity"))


def communities(edges: DataFrame, nodes: DataFrame | None = None, *, a: str = "artist_a", b: str = "artist_b", node: str = "artist_name", by: tuple[str, ...] = (), most_turns: int = 80) -> DataFrame:
    """The community of each node: *by, node, community (from 0 by smallest member; -1: alone).

    Takes edges (*by, a, b, weight); edges with null ends, loops and weights that aren't above 0 don't count, repeated ones add
    up. nodes (*by, node) may name further ones, which are alone. Each node starts by itself; turn by turn nodes move to the
    neighbouring community where modularity gains most, until no move gains any (or most_turns). The neighbours of a node
    are only ever summed by community, so no task holds a graph. The same rows at any partitioning.
    """
    links = cut(_both_ways(edges, a, b, by))
    weights = links.groupBy("node").agg(F.sum("w").alias("k"))
    part = F.struct(*[F.col(f"node.{c}") for c in by]) if by else F.lit(0)
    totals = weights.groupBy(part.alias("part")).agg(F.sum("k").alias("m2"))
    labels = cut(weights.withColumn("part", part).join(totals, "part").select("node", F.col("node").alias("label"), "k", "m2"))
    still = 0
    for turn in range(most_turns):
        moves = _moves(links, labels, turn)
        moved = cut(labels.join(moves, "node", "left").select("node", F.coalesce("to", "label").alias("label"), "k", "m2", F.col("to").isNotNull().alias("moved")))
        still = still + 1 if moved.where("moved").isEmpty() else 0
        labels = moved.drop("moved")
        if still:
            break
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1")
    # one row a community of each graph
    order = Window.partitionBy(*[F.col(f"first.{c}") for c in by]).orderBy("first") if by else Window.orderBy("first")
    numbers = sizes.select("label", (F.row_number().over(order) - 1).alias("community"))
    out = labels.join(numbers, "label", "left").select(*[F.col(f"node.{c}").alias(c) for c in by], F.col("node.name").alias(node), F.coalesce("community", F.lit(-1)).alias("community"))
    if nodes is not None:
        out = nodes.select(*by, node).distinct().join(out, [*by, node], "full").select(*by, node, F.coalesce("community", F.lit(-1)).alias("community"))
    return out
