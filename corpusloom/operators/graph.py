"""Graph operators: ego sets, dependency layers, collapsed groups, sectors, tiers, layouts, overlaps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import analyze as A
from corpusloom.storage import scratch


def ego(links: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """(path, steps): what is within some steps of the roots, either way along links. One join with the frontier a step."""
    l = links.where("src <> dst").select("src", "dst")
    near = l.unionByName(l.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = front = roots.select("path").distinct().withColumn("steps", F.lit(0))
    for d in range(1, depth + 1):
        step = near.join(front.select(F.col("path").alias("src")), "src", "left_semi").select(F.col("dst").alias("path")).distinct()
        front = scratch(step.join(seen, "path", "left_anti").withColumn("steps", F.lit(d)))
        seen = seen.unionByName(front)
    return seen


def dependency_layers(links: DataFrame, most: int = 10_000) -> DataFrame:
    """(path, level, in_cycle): the longest chain of dependencies below each node that has any link of the kind.

    `depends` goes from a node to what it waits for, `blocks` the other way. Nodes are taken off from the
    bottom, a level at a time, as soon as all they wait for has gone; what can never go lies on or above a
    cycle and gets no level. Work by level is a join of what is left with what went.
    """
    waits = links.where("type = 'depends'").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    waits = waits.unionByName(links.where("type = 'blocks'").select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    waits = scratch(waits)
    nodes = waits.select(F.col("a").alias("path")).unionByName(waits.select(F.col("b").alias("path"))).distinct()
    free = nodes.join(waits.select(F.col("a").alias("path")), "path", "left_anti")
    done = gone = scratch(free.withColumn("level", F.lit(0)))
    left = scratch(waits)
    for level in range(1, most):
        if not left.limit(1).count():
            break
        # links to what went are fulfilled; who has none left goes next
        still = left.join(gone.select(F.col("path").alias("b")), "b", "left_anti")
        freed = left.join(gone.select(F.col("path").alias("b")), "b", "left_semi").select(F.col("a").alias("path")).distinct()
        gone = scratch(freed.join(still.select(F.col("a").alias("path")), "path", "left_anti").withColumn("level", F.lit(level)))
        if not gone.limit(1).count():
            break
        done = done.unionByName(gone)
        left = scratch(still)
    return nodes.join(done, "path", "left").select("path", "level", F.col("level").isNull().alias("in_cycle"))


def chain_layers(links: DataFrame) -> DataFrame:
    """Dependency layers where every node waits for one other at most (chains and trees): by pointer doubling,
    in as many rounds as the logarithm of the longest chain. Cycles get no level."""
    one = links.where("type = 'depends' and src <> dst").select(F.col("src").alias("path"), F.col("dst").alias("to"))
    ends = one.select(F.col("to").alias("path")).distinct().join(one.select("path"), "path", "left_anti")
    now = scratch(one.withColumn("level", F.lit(1)).unionByName(ends.select("path", F.lit(None).cast("string").alias("to"), F.lit(0).alias("level"))))
    for _ in range(40):
        if not now.where("to is not null").limit(1).count():
            break
        far = now.select(F.col("path").alias("to"), F.col("to").alias("next"), F.col("level").alias("more"))
        then = scratch(now.join(far, "to", "left").select("path", F.col("next").alias("to"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")))
        now = then
    return now.select("path", F.when(F.col("to").isNull(), F.col("level")).alias("level"), F.col("to").isNotNull().alias("in_cycle"))


def super_nodes(nodes: DataFrame) -> DataFrame:
    """From (group, x, y, colour, shown): group, x, y of the middle, members, radius, the commonest colour.

    Only what is shown counts; of equally common colours the smallest. Sums by group and colour come first.
    """
    c = nodes.where("shown").groupBy("group", "colour").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.count("*").alias("n"))
    g = c.groupBy("group").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("n").alias("members"), F.min(F.struct((-F.col("n")).alias("n"), "colour")).alias("most"))
    middle = lambda k: F.round(F.col(k) / F.col("members"), 6).alias(k)
    return g.select("group", middle("x"), middle("y"), "members", F.round(9 + F.sqrt("members") * 3.4, 6).alias("radius"), F.col("most.colour").alias("colour"))


def collapse(nodes: DataFrame, links: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(super nodes, super links) of nodes (path, x, y, colour, shown and a column to group by, such as zone or cluster)."""
    grouped = nodes.withColumn("group", F.col(by))
    return super_nodes(grouped), super_links(links, grouped.where("shown"))


def around(links: DataFrame, chosen: DataFrame) -> DataFrame:
    """(path) of what is linked with one of the chosen (path), in either direction, and not chosen itself."""
    l = links.select("src", "dst")
    both = l.unionByName(l.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = both.join(chosen.select(F.col("path").alias("src")), "src", "left_semi").select(F.col("dst").alias("path")).distinct()
    return near.join(chosen.select("path"), "path", "left_anti")


def super_links(links: DataFrame, groups: DataFrame) -> DataFrame:
    """From links and (path, group): a, b, n for each pair of groups, in either direction."""
    g = groups.select("path", "group")
    l = links.join(g.select(F.col("path").alias("src"), F.col("group").alias("ga")), "src").join(g.select(F.col("path").alias("dst"), F.col("group").alias("gb")), "dst")
    return l.where("ga <> gb").groupBy(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).agg(F.count("*").alias("n"))


def sectors(groups: DataFrame) -> DataFrame:
    """From (zone, n), one row for each zone: angle and span, in proportion to the root of n."""
    w = F.sqrt(F.greatest("n", F.lit(1)))
    upto = Window.orderBy("zone").rowsBetween(Window.unboundedPreceding, -1)
    s = groups.withColumn("w", w)
    span = F.col("w") / F.sum("w").over(Window.partitionBy()) * (2 * math.pi)
    before = F.coalesce(F.sum("w").over(upto), F.lit(0.0)) / F.sum("w").over(Window.partitionBy()) * (2 * math.pi)
    return s.select("zone", "n", F.round(before + span / 2 - math.pi / 2, 6).alias("angle"), F.round(span, 6).alias("span"))


def label_tiers(degrees: DataFrame) -> DataFrame:
    """path, deg, tier: the ten of highest degree 1, the next twenty 2, others 3. Only the top thirty are ordered in one place."""
    top = degrees.orderBy(F.desc("deg"), "path").limit(30).select("path", F.row_number().over(Window.orderBy(F.desc("deg"), "path")).alias("r"))
    d = degrees.join(F.broadcast(top), "path", "left")
    return d.select("path", "deg", F.when(F.col("r") <= 10, 1).when(F.col("r") <= 30, 2).otherwise(3).alias("tier"))


def fresh_layout(nodes: DataFrame, sector_table: DataFrame, now: Column) -> DataFrame:
    """path, x, y: nearer to the middle the newer, at the angle of the zone, scattered by the path's hash."""
    hours = F.least(A.age_hours(F.col("at"), now) + 1, F.lit(9600.0))
    r = 60 + F.log10(hours + 1) / math.log10(9600) * 380
    a = F.col("angle") + (A.scatter_hash(F.col("path")) - 0.5) * F.col("span") * 0.8
    n = nodes.join(sector_table.select("zone", "angle", "span"), "zone")
    return n.select("path", F.round(F.cos(a) * r, 4).alias("x"), F.round(F.sin(a) * r * 0.8, 4).alias("y"))


def scattered(nodes: DataFrame, least: float = 12, most: float = 46) -> DataFrame:
    """From (path, x, y): path, x, y a little away from the place, by hashes of the path."""
    a = A.scatter_hash(F.col("path")) * (2 * math.pi)
    r = least + A.scatter_hash(F.concat("path", F.lit("·"))) * most
    return nodes.select("path", (F.round(F.col("x") + F.cos(a) * r, 4) + 0.0).alias("x"), (F.round(F.col("y") + F.sin(a) * r, 4) + 0.0).alias("y"))  # no -0


def zone_layout(nodes: DataFrame, sector_table: DataFrame) -> DataFrame:
    """path, x, y: each node at the place of its zone, on an ellipse that grows with the number of visible nodes."""
    shown = F.count_if(F.coalesce("visible", F.lit(False)))
    r = nodes.agg((150 + F.coalesce(F.nullif(shown, F.lit(0)), F.count("*")) * 1.35).alias("r"))
    z = sector_table.select("zone", "angle").crossJoin(F.broadcast(r))  # one row
    z = z.select("zone", F.round(F.cos("angle") * F.col("r"), 4).alias("x"), F.round(F.sin("angle") * F.col("r") * 0.72, 4).alias("y"))
    return nodes.join(z, "zone").select("path", "x", "y")


def cluster_layout(nodes: DataFrame) -> DataFrame:
    """From (path, cluster): path, x, y in a disc for each cluster, the larger first around an ellipse."""
    n = nodes.groupBy("cluster").agg(F.count("*").alias("size")).withColumn("w", F.sqrt("size"))
    # one row for each cluster
    order = Window.orderBy(F.desc("size"), "cluster")
    before = F.coalesce(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    n = n.withColumns({"angle": (before + F.col("w") / 2) / F.sum("w").over(Window.partitionBy()) * (2 * math.pi) - math.pi / 2, "far": 170 + F.sum("size").over(Window.partitionBy()) * 1.25})
    c = n.select("cluster", (F.cos("angle") * F.col("far")).alias("cx"), (F.sin("angle") * F.col("far") * 0.72).alias("cy"), (26 + F.col("w") * 11).alias("r"))
    a = A.scatter_hash(F.col("path")) * (2 * math.pi)
    d = F.sqrt(A.scatter_hash(F.concat("path", F.lit("·")))) * F.col("r")
    return nodes.join(c, "cluster").select("path", F.round(F.col("cx") + F.cos(a) * d, 4).alias("x"), F.round(F.col("cy") + F.sin(a) * d, 4).alias("y"))


def layer_layout(layers: DataFrame) -> DataFrame:
    """From (path, level), level null on a cycle: path, x, y in columns by level, cycles in one on the right."""
    row = F.row_number().over(Window.partitionBy("level").orderBy("path")) - 1
    return layers.select("path", F.coalesce(-420 + F.col("level") * 190, F.lit(520)).alias("x"), (-240 + row * 46).alias("y"))


def style(nodes: DataFrame, now: Column, size_by: str = "bytes") -> DataFrame:
    """path, radius, warmth: by the share of the largest value (the root of it for bytes; as it is for deg and commits),
    and by the logarithm of the age."""
    most = nodes.agg(F.greatest(F.max(size_by), F.lit(1)).alias("most"))
    share = F.col(size_by) / F.col("most")
    t = 1 - F.least(F.log10(A.age_hours(F.col("at"), now) + 1) / math.log10(9600), F.lit(1.0))
    return nodes.crossJoin(F.broadcast(most)).select("path", F.round(3 + 7 * (F.sqrt(share) if size_by == "bytes" else share), 6).alias("radius"), F.round(t, 6).alias("warmth"))  # one row


def bounds(points: DataFrame, width: float, height: float, margin: float = 80.0) -> DataFrame:
    """min and max of the points and the scale that shows them all, from 0.25 to 1."""
    b = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    k = F.least(F.lit(width) / (F.col("x1") - F.col("x0") + margin), F.lit(height) / (F.col("y1") - F.col("y0") + margin))
    return b.withColumn("scale", F.round(F.greatest(F.lit(0.25), F.least(F.lit(1.0), k)), 6))


def nearest(points: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """The nearest point to a place, within a radius."""
    d = points.withColumn("d", F.round(F.hypot(F.col("x") - x, F.col("y") - y), 6)).where(F.col("d") <= radius)
    return d.orderBy("d", "id").limit(1).select("id", "d")


def overlaps(rects: DataFrame, cell: float = 64.0) -> DataFrame:
    """(a, b) of rectangles (id, x, y, w, h) that overlap: equal cells of a grid, then the exact test; a pair
    counts in the cell of its common lower left corner only."""
    span = lambda lo, size: F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(lo) + F.col(size)) / cell))
    g = rects.withColumn("cx", F.explode(span("x", "w"))).withColumn("cy", F.explode(span("y", "h")))
    b = g.select(*(F.col(c).alias(f"{c}2") if c not in ("cx", "cy") else F.col(c) for c in g.columns))
    j = g.join(b, ["cx", "cy"]).where("id < id2 and x < x2 + w2 and x + w > x2 and y < y2 + h2 and y + h > y2")
    return j.where((F.floor(F.greatest("x", "x2") / cell) == F.col("cx")) & (F.floor(F.greatest("y", "y2") / cell) == F.col("cy"))).select(F.col("id").alias("a"), F.col("id2").alias("b"))
