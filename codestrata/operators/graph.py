"""Operators over directed edges ``src, dst``."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import cut


def degrees(edges: DataFrame) -> DataFrame:
    """``node, fan_in, fan_out, instability``: instability is out / (in + out). Repeated edges count once."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    out = ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return out.withColumn("instability", F.col("fan_out") / (F.col("fan_in") + F.col("fan_out")))


def god_nodes(edges: DataFrame, most: int, k: int = 10) -> DataFrame:
    """The ``k`` nodes with the most edges among those with more than ``most`` in or out (a top-k report)."""
    d = degrees(edges).filter((F.col("fan_in") > most) | (F.col("fan_out") > most))
    return d.withColumn("degree", F.col("fan_in") + F.col("fan_out")).orderBy(F.desc("degree"), "node").limit(k)


def closure(edges: DataFrame, seeds: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``node, depth`` of everything that depends on a seed: edges are followed from dst to src.

    A frontier loop: each round joins the last round's nodes with the edges and keeps what is new; rounds end
    when nothing is. Cycles end by themselves. Lineage is cut by a written table in each round. With ``max_rounds``
    a graph that needs more is an error.
    """
    reverse = cut(edges.select(F.col("dst").alias("node"), F.col("src").alias("next")).distinct())
    seen = cut(seeds.select("node", F.lit(0).alias("depth")).distinct())
    frontier = seen
    for depth in count(1):
        step = frontier.join(reverse, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = cut(step.select("node", F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            break
        if max_rounds is not None and depth > max_rounds:
            raise ValueError(f"nodes deeper than {max_rounds} edges")
        seen = seen.unionByName(frontier)
    return seen


def cycles(edges: DataFrame, longest: int = 4) -> DataFrame:
    """Distinct simple cycles of 2 to ``longest`` nodes, each once, beginning at its smallest node: ``path, length``.

    Paths are extended only over nodes larger than their first one, which makes every cycle appear in its
    canonical rotation only. Self-loops are no cycles.
    """
    e = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    paths = e.filter("dst > src").select(F.array("src", "dst").alias("p"), F.col("dst").alias("last"))
    out = None
    for length in range(2, longest + 1):
        closed = paths.join(e.select(F.col("src").alias("last"), F.col("dst").alias("back")), "last").filter(F.col("back") == F.col("p")[0])
        found = closed.select(F.array_join(F.transform("p", lambda x: x.cast("string")), ">").alias("path"), F.lit(length).alias("length"))
        out = found if out is None else out.unionByName(found)
        if length < longest:
            step = paths.join(e.select(F.col("src").alias("last"), F.col("dst").alias("nxt")), "last")
            step = step.filter((F.col("nxt") > F.col("p")[0]) & ~F.array_contains("p", F.col("nxt")))
            paths = step.select(F.concat("p", F.array("nxt")).alias("p"), F.col("nxt").alias("last"))
    return out


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, component, size`` of every node on a cycle of two or more: the exact answer where paths are too many to list.

    A component is named by its smallest node. Rounds of colouring: every node takes the largest node that reaches it;
    of those of one colour, the ones that reach back to it are its component and leave the graph. Nodes without a
    way in or out leave first. Every round settles at least the largest node of every colour, so the rounds end.
    """
    e = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    done = None
    while not e.isEmpty():
        while True:  # trim what can be on no cycle
            keep = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            kept = cut(keep.select("src", "dst"))
            if kept.count() == e.count():
                break
            e = kept
        if e.isEmpty():
            break
        nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
        colour = cut(nodes.withColumn("colour", F.col("node")))
        while True:
            given = colour.unionByName(colour.join(e, colour.node == e.src).select(F.col("dst").alias("node"), "colour"))
            new = cut(given.groupBy("node").agg(F.max("colour").alias("colour")))
            moved = new.join(colour.withColumnRenamed("colour", "old"), "node").filter("colour <> old").isEmpty()
            colour = new
            if moved:
                break
        a, b = colour.withColumnsRenamed({"node": "src", "colour": "ca"}), colour.withColumnsRenamed({"node": "dst", "colour": "cb"})
        inner = cut(e.join(a, "src").join(b, "dst").filter("ca = cb").select("src", "dst", F.col("ca").alias("colour")))
        back = cut(colour.filter("node = colour"))
        frontier = back
        while True:
            step = frontier.select(F.col("node").alias("dst"), "colour").join(inner, ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            frontier = cut(step.join(back, ["node", "colour"], "left_anti"))
            if frontier.isEmpty():
                break
            back = cut(back.unionByName(frontier))
        done = back if done is None else done.unionByName(back)
        gone = back.select("node")
        e = cut(e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    if done is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component"), F.lit(0).cast("bigint").alias("size")).limit(0)
    sizes = done.groupBy("colour").agg(F.min("node").alias("component"), F.count("*").alias("size")).filter("size > 1")
    return done.join(sizes, "colour").select("node", "component", "size")


def first_cycles(found: DataFrame, k: int) -> DataFrame:
    """TOP10: the first ``k`` cycles, shortest first (a top-k report)."""
    return found.orderBy("length", "path").limit(k)
