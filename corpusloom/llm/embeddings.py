"""Near-duplicates among embeddings: p-stable hashing for Euclidean distance, exact cosines.

Normalised vectors are projected on Gaussian directions, shifted and cut into
steps of WIDTH; DEPTH such numbers make a key, and each vector has a key in
each of TABLES tables. At a cosine of 0.98 the distance is 0.2, one number
agrees with probability 0.936, so two vectors meet in some table with
probability above 0.99999; vectors at right angles agree in one with 0.57, and
in a key about four times in a million.

Vectors that are equal form a class first. Classes that meet in a table are
compared by exact cosine in blocks of bounded size. A pair counts in the first
table where it meets, so each is counted once without a list of pairs; a block
gives back sums of links and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import kernels as K
from corpusloom.llm.common import join_hot, map_groups, materialise, resident, tidy
from corpusloom.llm.components import Forest, components

WIDTH, DEPTH, TABLES, BLOCK = 2.5, 22, 44, 1024
_ROWS = 1024


def _map(dim: int) -> tuple[np.ndarray, np.ndarray]:
    def build() -> tuple[np.ndarray, np.ndarray]:
        n = DEPTH * TABLES
        shift = (K.splitmix(47, n) >> K.U64(11)).astype(float) / (1 << 53) * WIDTH
        return K.normals(43, n * dim).reshape(dim, n), shift

    return resident(("projections", dim), build)


def table_keys(x: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The keys of unit vectors in all tables; salt keeps groups apart."""
    out = np.empty((len(x), TABLES), K.U64)
    a, b = _map(x.shape[1])
    for i in range(0, len(x), _ROWS):
        steps = np.floor((x[i : i + _ROWS] @ a + b) / WIDTH).astype(np.int64).view(K.U64).reshape(-1, TABLES, DEPTH)
        key = np.repeat(salt[i : i + _ROWS, None], TABLES, 1) ^ np.arange(1, TABLES + 1, dtype=K.U64)
        for d in range(DEPTH):
            key = K.mix(key * K.U64(0x9E3779B97F4A7C15) + steps[:, :, d])
        out[i : i + _ROWS] = key
    return out


_SKETCH = "vec_id long, label string, one long, two long, x array<double>, keys array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Valid vectors only: with label, not null or zero, all components finite."""
    for batch in batches:
        vectors = batch.column(1)
        size = np.array([-1 if v is None else v for v in pc.list_value_length(vectors).to_pylist()])
        for dim in np.unique(size[size > 0]).tolist():
            rows = np.flatnonzero(size == dim)
            flat = vectors.take(pa.array(rows)).flatten()
            x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)  # null: nan
            with np.errstate(all="ignore"):
                scale = np.abs(x).max(1)
                unit = x / scale[:, None]
                unit /= np.linalg.norm(unit, axis=1)[:, None]
            good = np.isfinite(unit).all(1) & (scale > 0)
            rows, x, unit = rows[good], x[good], unit[good]
            if not len(rows):
                continue
            labels = batch.column(2).take(pa.array(rows))
            # equal vectors of one label have equal digests of their raw numbers
            raw = (x + 0.0).view(K.U64)
            powers = K.splitmix(53, dim) | K.U64(1)
            text = labels.to_pylist()
            salt = np.array([int.from_bytes(K.hashed(t), "little") for t in text], K.U64) ^ K.U64(dim)
            one, two = K.mix((K.mix(raw) * powers).sum(1) + salt), K.mix((K.mix(raw ^ K.U64(0x5555555555555555)) * powers).sum(1) ^ salt)
            keys = table_keys(unit, salt)
            ends = lambda n: pa.array(np.arange(0, (len(rows) + 1) * n, n, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), labels, pa.array(K.as_long(one)), pa.array(K.as_long(two)), pa.ListArray.from_arrays(ends(dim), pa.array(unit.reshape(-1))), pa.ListArray.from_arrays(ends(TABLES), pa.array(K.as_long(keys.reshape(-1))))],
                names=["vec_id", "label", "one", "two", "x", "keys"],
            )


def _compare(least: float):
    def run(group: pa.Table) -> list[pa.RecordBatch]:
        group = group.combine_chunks()
        ids, once = np.unique(group["cls"].to_numpy(), return_index=True)
        if len(ids) < 2:
            return []
        group = group.take(pa.array(once))
        block, i, j, t = group["block"].to_numpy(), group["i"][0].as_py(), group["j"][0].as_py(), group["t"][0].as_py()
        x = group["x"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        keys = group["keys"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        many = group["copies"].to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        near = x[left] @ x[right].T >= least
        if i == j:
            near = np.triu(near, 1)
        a, b = np.nonzero(near)
        a, b = left[a], right[b]
        if t:
            fresh = np.ones(len(a), bool)
            for k in range(t):
                fresh &= keys[a, k] != keys[b, k]
            a, b = a[fresh], b[fresh]
        if not len(a):
            return []
        links = np.bincount(a, many[b], len(ids)) + np.bincount(b, many[a], len(ids))
        forest = Forest(len(ids))
        for p, q in zip(a.tolist(), b.tolist()):
            forest.join(p, q)
        at = np.flatnonzero(links > 0)
        roots = np.array([forest.root(p) for p in at.tolist()])
        return [pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at].astype(np.int64)), pa.array(ids[roots])], names=["cls", "links", "root"])]

    return run


def near_vectors(vectors: DataFrame, least: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept.

    Vectors of one label are linked at a cosine of `least` or more, in double precision. n_links: other
    rows linked directly, equal vectors included; component_id: the smallest vec_id reachable, itself
    included; kept: it is the row's own. Vectors that are null, empty or zero or hold a null or non-finite
    number, and rows of a null label or vec_id, are linked with nothing and kept (component_id is their
    vec_id). Vectors of unlike length are not linked. Rows that repeat a vec_id count as rows each in
    n_links and as one in components. An empty table gives an empty result.
    """
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.col(label).cast("string").alias("label"))
    sketch = materialise(base.where("vec_id is not null and label is not null and embedding is not null").mapInArrow(tidy(_sketch), _SKETCH), "vectors")
    classes = materialise(sketch.groupBy("one", "two").agg(F.min("vec_id").alias("cls"), F.count("*").alias("copies")), "classes")
    mine = classes.select("one", "two", F.col("cls").alias("vec_id"), "copies")
    reps = sketch.join(mine, ["one", "two", "vec_id"]).select(F.col("vec_id").alias("cls"), "copies", "x", "keys")
    reps = materialise(reps, "reps")
    met = reps.select("cls", F.posexplode("keys").alias("t", "key")).groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.count("*").alias("n")).where("low < high")
    met = materialise(met.select("key", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks")), "buckets")
    places = reps.select("cls", F.posexplode("keys").alias("t", "key")).join(met, "key").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    places = places.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    places = places.select("cls", "key", "t", "block", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"))
    units = places.join(reps, "cls").select(F.xxhash64("key", "i", "j").alias("unit"), "cls", "copies", "t", "block", "i", "j", "x", "keys")
    links = materialise(map_groups(units, "unit", _compare(least), "cls long, links long, root long"), "links")
    counts = links.groupBy("cls").agg(F.sum("links").alias("links"))
    # a repeated vec_id joins the classes of its rows
    print_ = sketch.select("vec_id", "one", "two")
    twice = print_.distinct().groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id")
    other = print_.join(twice, "vec_id", "left_semi").join(classes, ["one", "two"]).where("vec_id <> cls").select(F.col("vec_id").alias("src"), F.col("cls").alias("dst"))
    joined = components(links.select(F.col("cls").alias("src"), F.col("root").alias("dst")).unionByName(other))
    ends = classes.join(counts, "cls", "left").join(joined.withColumnRenamed("node", "cls"), "cls", "left")
    ends = ends.select("one", "two", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component_id"))
    linked = join_hot(print_, materialise(ends, "ends"), ["one", "two"], "copies").select("vec_id", "n_links", "component_id")
    # rows that took no part
    bad = base.where(~valid(F.col("embedding")) | F.col("label").isNull() | F.col("vec_id").isNull())
    rest = bad.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def valid(x):
    """Whether a vector has a direction: numbers only, finite, not all zero."""
    infinite = F.lit(float("inf"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == infinite))
    return F.coalesce(~bad & F.exists(x, lambda v: v != 0), F.lit(False))
