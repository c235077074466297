"""Vector search by exact dot products: top k, best of each group, places of accepted results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.storage import scratch

#: Queries that meet the vectors in one product.
QUERY_BLOCK = 4096
#: Products that a task holds at once.
PRODUCTS = 1 << 20


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def quantise(v: Column) -> Column:
    """Components of a unit vector as whole numbers from -127 to 127."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.floor(x.cast("double") * 127 + 0.5))).cast("tinyint"))


def scored(vectors: DataFrame, query: DataFrame, scale: float = 1.0) -> DataFrame:
    """Adds score: the dot product with the normalised query (one row, column q)."""
    norm = F.sqrt(dot(F.col("q"), F.col("q")))
    q = query.select("q", F.when(norm == 0, F.lit(1.0)).otherwise(norm).alias("norm"))
    return vectors.crossJoin(F.broadcast(q)).withColumn("score", F.round(dot(F.col("embedding"), F.col("q")) / F.col("norm") / scale, 6)).drop("q", "norm")


def check(dim: int, model: str | None, query: list[float], query_model: str | None) -> None:
    """A query of another length or another model is an error."""
    if len(query) != dim:
        raise ValueError(f"the query has {len(query)} numbers, the vectors have {dim}")
    if model and query_model and model != query_model:
        raise ValueError(f"the vectors are of {model}, the query is of {query_model}")


def search(vectors: DataFrame, query: list[float], limit: int, model: str | None = None, query_model: str | None = None, scale: float = 1.0) -> DataFrame:
    """The best of the vectors for a query given as numbers; none without vectors, an error where the two do not fit."""
    spark, first = vectors.sparkSession, vectors.select(F.size("embedding").alias("dim")).where("dim >= 0").first()
    if first is None:
        return spark.createDataFrame([], "vec_id long, score double")
    check(first["dim"], model, query, query_model)
    return top(vectors, spark.createDataFrame([([float(x) for x in query],)], "q array<double>"), limit, scale)


def top(vectors: DataFrame, query: DataFrame, limit: int, scale: float = 1.0) -> DataFrame:
    return scored(vectors, query, scale).select("vec_id", "score").orderBy(F.desc("score"), "vec_id").limit(limit)


def best_per_group(vectors: DataFrame, query: DataFrame, group: str, limit: int) -> DataFrame:
    """The best vector of each group and the best groups; one aggregate with partial results."""
    s = scored(vectors, query).groupBy(group).agg(F.max(F.struct("score", (-F.col("vec_id")).alias("id"))).alias("m"))
    return s.select(group, (-F.col("m.id")).alias("vec_id"), "m.score").orderBy(F.desc("score"), group).limit(limit)


def first_places(vectors: DataFrame, queries: DataFrame, quantised: bool = False) -> DataFrame:
    """(query, place): the place, from 1, of the first other vector of the query's label among all by score.

    Two passes over the vectors, each with the queries in blocks: the best accepted (score, vec_id) of each
    query, then how many are ahead of it. Products are matrix products of a batch with a block, and what
    leaves a batch is a row for each query, so no pairs are made.
    """
    base, spark = vectors.select("vec_id", "label", "embedding"), vectors.sparkSession
    out = spark.createDataFrame([], "query long, place long")
    for ids, labels, q in _blocks(queries):
        best = {r["query"]: (r["score"], r["vec_id"]) for r in base.mapInArrow(_best(ids, labels, q, quantised), "query long, score double, vec_id long").groupBy("query").agg(F.max(F.struct("score", (-F.col("vec_id")).alias("n"))).alias("m")).select("query", "m.score", (-F.col("m.n")).alias("vec_id")).collect()}  # a row for each query of the block
        ahead = base.mapInArrow(_ahead(ids, q, best, quantised), "query long, n long").groupBy("query").agg((F.sum("n") + 1).alias("place"))
        every = spark.createDataFrame([(int(i), int(i) in best) for i in ids], "query long, found boolean")
        part = every.join(ahead, "query", "left").select("query", F.when(F.col("found"), F.col("place")).alias("place"))
        out = out.unionByName(scratch(part))  # so that no plan keeps a block
    return out


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The queries in blocks of QUERY_BLOCK; the driver holds one at a time."""
    block: list = []
    for r in queries.select("vec_id", "label", "embedding").toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            yield _pack(block)
            block = []
    if block:
        yield _pack(block)


def _pack(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array([r["vec_id"] for r in rows]), np.array([r["label"] for r in rows]), np.array([r["embedding"] for r in rows], float)


def _matrix(batch: pa.RecordBatch, quantised: bool) -> np.ndarray:
    column = batch.column(2)
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)
    return np.clip(np.floor(x * 127 + 0.5), -127, 127) / 127 if quantised else x


def _parts(batch: pa.RecordBatch, n_queries: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose products with the queries are PRODUCTS numbers."""
    rows = max(PRODUCTS // max(n_queries, 1), 1)
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _best(ids, labels, q, quantised):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, least = np.full(len(ids), -np.inf), np.full(len(ids), np.iinfo(np.int64).max)
        for batch in batches:
            for part in _parts(batch, len(ids)):
                vec, label = part.column(0).to_numpy(), part.column(1).to_numpy()
                s = np.round(_matrix(part, quantised) @ q.T, 6)
                s[(label[:, None] != labels[None]) | (vec[:, None] == ids[None])] = -np.inf
                top = s.max(0)
                first = np.where(s == top, vec[:, None], np.iinfo(np.int64).max).min(0)
                least = np.where(top > most, first, np.where(top == most, np.minimum(first, least), least))
                most = np.maximum(most, top)
        some = np.isfinite(most)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(most[some]), pa.array(least[some])], names=["query", "score", "vec_id"])

    return run


def _ahead(ids, q, best, quantised):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = np.array([best.get(int(i), (np.inf, 0))[0] for i in ids])
        first = np.array([best.get(int(i), (np.inf, 0))[1] for i in ids])
        n = np.zeros(len(ids), np.int64)
        for batch in batches:
            for part in _parts(batch, len(ids)):
                vec = part.column(0).to_numpy()
                s = np.round(_matrix(part, quantised) @ q.T, 6)
                n += (((s > score) | (s == score) & (vec[:, None] < first)) & (vec[:, None] != ids[None])).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["query", "n"])

    return run
