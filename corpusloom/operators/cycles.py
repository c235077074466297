"""Dependency graphs with cycles: strongly connected components, and layers of what they leave when contracted."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.storage import scratch, shared_root


def waiting(links: DataFrame) -> DataFrame:
    """(a, b): a waits for b. `depends` goes from a node to what it waits for, `blocks` the other way; null ends are no links."""
    one = links.where("type = 'depends'").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    other = links.where("type = 'blocks'").select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return one.unionByName(other).where("a is not null and b is not null").distinct()


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("path")).unionByName(edges.select(F.col("b").alias("path"))).distinct()


def _trimmed(edges: DataFrame) -> DataFrame:
    """What is left when nodes that nothing leads to, or that lead nowhere, go until there are none."""
    n = edges.count()
    while n:
        into, out = edges.select(F.col("b").alias("a")).distinct(), edges.select(F.col("a").alias("b")).distinct()
        edges = scratch(edges.join(into, "a", "left_semi").join(out, "b", "left_semi").select("a", "b"))
        left = edges.count()
        if left == n:
            break
        n = left
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """(path, colour): the smallest node that each is reached from, itself included. Only what changed goes on."""
    now = scratch(_ends(edges).withColumn("colour", F.col("path")))
    news = now
    while not news.isEmpty():
        told = edges.join(news.select(F.col("path").alias("a"), "colour"), "a").groupBy(F.col("b").alias("path")).agg(F.min("colour").alias("told"))
        step = scratch(now.join(told, "path", "left").select("path", F.least("colour", "told").alias("colour"), F.coalesce(F.col("told") < F.col("colour"), F.lit(False)).alias("new")))
        now, news = step.select("path", "colour"), step.where("new").select("path", "colour")
    return now


def _back(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, component): what reaches its root (path, component) along edges of one colour."""
    front = roots
    seen = roots
    while not front.isEmpty():
        step = edges.join(front.select(F.col("path").alias("b"), "component"), "b").select(F.col("a").alias("path"), "component").distinct()
        front = scratch(step.join(seen, "path", "left_anti"))
        seen = scratch(seen.unionByName(front))
    return seen


def strong_components(edges: DataFrame) -> DataFrame:
    """(path, component) of the nodes on a cycle of edges (a, b), loops of one node included; component is its smallest node.

    Forward and backward by colours: after trimming, each node takes the smallest node that reaches it as its
    colour; what reaches, within its colour, the node that gave it is a component. Edges between colours and what
    was found go, the rest is done again. Every step is a join with what changed last; rounds grow with the
    longest way, not with the number of cycles. No graph at all gives an empty table.
    """
    spark = edges.sparkSession
    edges = scratch(edges.select("a", "b").distinct())
    loops = edges.where("a = b").select(F.col("a").alias("path"), F.col("a").alias("component"))
    found = [loops]
    left = _trimmed(scratch(edges.where("a <> b")))
    while not left.isEmpty():
        colour = _coloured(left)
        same = left.join(colour.select(F.col("path").alias("a"), F.col("colour").alias("ca")), "a").join(colour.select(F.col("path").alias("b"), F.col("colour").alias("cb")), "b")
        same = scratch(same.where("ca = cb").select("a", "b"))
        roots = colour.where("path = colour").select("path", F.col("colour").alias("component"))
        members = _back(same, roots)
        # a node on no cycle of others is a component of its own, which is none here
        sizes = members.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
        found.append(members.join(sizes, "component", "left_semi").select("path", "component"))
        gone = members.select("path")
        rest = same.join(gone.withColumnRenamed("path", "a"), "a", "left_anti").join(gone.withColumnRenamed("path", "b"), "b", "left_anti")
        left = _trimmed(scratch(rest.select("a", "b")))
    out = spark.createDataFrame([], edges.select(F.col("a").alias("path"), F.col("a").alias("component")).schema)
    for part in found:
        out = out.unionByName(part)
    return scratch(out.groupBy("path").agg(F.min("component").alias("component")))


def peeled(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, level) of a graph without cycles: the longest chain below each node, at any depth.

    A level goes at a time, each as a folder of its own, so the plan stays as long as it is however many there are.
    """
    spark = edges.sparkSession
    root = f"{shared_root(spark)}/levels-{uuid.uuid4().hex}"
    schema = nodes.select("path", F.lit(0).alias("level")).schema

    def put(paths: DataFrame, level: int) -> DataFrame:
        paths.select("path", F.lit(level).alias("level")).write.parquet(f"{root}/{level}")
        return spark.read.schema(schema).parquet(f"{root}/{level}")

    left, level = scratch(edges.select("a", "b")), 0
    gone = put(nodes.join(left.select(F.col("a").alias("path")), "path", "left_anti"), 0)
    while not left.isEmpty():
        level += 1
        took = gone.select(F.col("path").alias("b"))
        still = scratch(left.join(took, "b", "left_anti"))
        freed = left.join(took, "b", "left_semi").select(F.col("a").alias("path")).distinct()
        gone = put(freed.join(still.select(F.col("a").alias("path")), "path", "left_anti"), level)
        if gone.isEmpty():
            raise ValueError("the graph has a cycle; contract strong_components first")
        left = still
    return spark.read.schema(schema).parquet(f"{root}/*")


def cycle_layers(links: DataFrame) -> DataFrame:
    """(path, level, component, members, state) of each node that has a link of the kind.

    A cycle counts as one node, `component` its smallest path and `members` its size (a node on none: itself and 1).
    level: the longest chain of such nodes below. state: cycle for members, above for what waits for one directly or
    not, free for the others. Repeated links and null ends count once and not at all; no links give an empty table.
    """
    edges = scratch(waiting(links))
    on = strong_components(edges)
    nodes = _ends(edges).join(on, "path", "left").select("path", F.coalesce("component", "path").alias("component"), F.col("component").isNotNull().alias("cycle"))
    nodes = scratch(nodes)
    name = lambda c: nodes.select(F.col("path").alias(c), F.col("component").alias(f"c{c}"))
    between = edges.join(name("a"), "a").join(name("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    between = scratch(between)
    levels = peeled(between, nodes.select(F.col("component").alias("path")).distinct())
    # what waits for a cycle: a step up the contracted graph at a time
    cycles = nodes.where("cycle").select(F.col("component").alias("path")).distinct()
    seen = front = scratch(cycles)
    while not front.isEmpty():
        up = between.join(front.select(F.col("path").alias("b")), "b", "left_semi").select(F.col("a").alias("path")).distinct()
        front = scratch(up.join(seen, "path", "left_anti"))
        seen = scratch(seen.unionByName(front))
    sizes = nodes.groupBy("component").agg(F.count("*").alias("members"), F.max("cycle").alias("cycle"))
    parts = sizes.join(levels.withColumnRenamed("path", "component"), "component").join(seen.select(F.col("path").alias("component"), F.lit(True).alias("met")), "component", "left")
    state = F.when(F.col("cycle"), "cycle").when(F.col("met"), "above").otherwise("free")
    return nodes.select("path", "component").join(parts.select("component", "level", "members", state.alias("state")), "component").select("path", "level", "component", "members", "state")
