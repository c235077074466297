"""Strongly connected components and layers against plain versions, on graphs with cycles."""

import random

import pytest

from corpusloom.operators import cycles as Y


def plain(pairs):
    """{node: (level, component, members, state)} by reachability."""
    nodes = sorted({x for p in pairs for x in p})
    reach = {n: {b for a, b in pairs if a == n} for n in nodes}
    for k in nodes:
        for n in nodes:
            if k in reach[n]:
                reach[n] |= reach[k]
    comp = {n: min([m for m in reach[n] if n in reach[m]] + [n]) for n in nodes}
    cyclic = {n for n in nodes if n in reach[n]}
    below = {}

    def level(c):
        if c not in below:
            below[c] = max((level(comp[b]) + 1 for a, b in pairs if comp[a] == c and comp[b] != c), default=0)
        return below[c]

    size = {c: sum(x == c for x in comp.values()) for c in comp.values()}
    return {n: (level(comp[n]), comp[n], size[comp[n]], "cycle" if n in cyclic else "above" if reach[n] & cyclic else "free") for n in nodes}


@pytest.mark.parametrize("seed", [2])
def test_layers_with_cycles(spark, seed):
    pick = random.Random(seed)
    pairs = {(f"n{pick.randrange(30):02}", f"n{pick.randrange(30):02}") for _ in range(34)}
    pairs |= {(f"c{i}", f"c{(i + 1) % 5}") for i in range(5)} | {("top", "c1"), ("c3", "leaf"), ("loop", "loop"), ("over", "loop")}
    rows = [(a, b, "depends") if pick.random() < 0.7 else (b, a, "blocks") for a, b in sorted(pairs)]
    rows += [rows[0], ("p", "q", "link"), (None, "c1", "depends")]
    got = Y.cycle_layers(spark.createDataFrame(rows, "src string, dst string, type string")).collect()
    assert {r["path"]: (r["level"], r["component"], r["members"], r["state"]) for r in got} == plain(pairs)
    assert len(got) == len({r["path"] for r in got})


def test_no_links(spark):
    assert Y.cycle_layers(spark.createDataFrame([], "src string, dst string, type string")).collect() == []


def test_a_cycle_is_no_graph_to_peel(spark):
    e = spark.createDataFrame([("x", "y"), ("y", "x")], "a string, b string")
    with pytest.raises(ValueError):
        Y.peeled(e, spark.createDataFrame([("x",), ("y",)], "path string"))
