"""Connected components of a link table, without a collect and without localCheckpoint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import drop, materialise, tidy


class Forest:
    """Union by smallest member over positions 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's links become stars with the same components: at most one link for each node."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(nodes))
        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
            forest.join(x, y)
        roots = np.array([forest.root(i) for i in range(len(nodes))])
        keep = roots != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[roots[keep]])], names=["src", "dst"])


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable; nodes without links do not appear.

    `links` has two long columns src and dst, in any order, with repeats, with loops; rows with a null
    are no links. Alternating large-star and small-star steps: a logarithmic number of rounds, each
    of which moves at most two rows for each link. Rounds are written to the shared folder.
    """
    spark = links.sparkSession
    links = links.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst").mapInArrow(tidy(_thin), "src long, dst long")
    # src is always above dst from here on
    now = materialise(links.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "cc")
    for _ in range(max_rounds):
        both = now.select("src", "dst").unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        large = materialise(large, "cc")
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src").select(F.explode(F.array(F.struct("src", F.col("low").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")))).alias("x")).select("x.src", "x.dst").where("src <> dst").distinct()
        then = materialise(small, "cc")
        # a star forest: every node has one link, and no link's lower end has one
        rough = then.groupBy("src").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        deep = 0 if rough else then.join(then.select(F.col("src").alias("dst")), "dst", "left_semi").limit(1).count()
        drop(now, large)
        now = then
        if not rough and not deep:
            break
    else:
        raise RuntimeError("components did not settle")
    ends = now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return ends.unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
