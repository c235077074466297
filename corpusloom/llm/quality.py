"""Quality scores: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

Statistics of each document are taken in one pass over its text. Standardised,
they go through a fixed random cosine map, whose inner products approximate a
Gaussian kernel. Ridge regression in that space needs only the sums X'X and
X'y, which every partition adds up for itself; then the sums are added. The raw
scores of the labelled documents are counted in fine bins, and isotonic
regression over the bins turns a raw score into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import kernels as K
from corpusloom.llm.common import materialise, tidy
from corpusloom.llm.toxicity import held_out

FOURIER, RIDGE, GAMMA, BINS = 192, 3.0, 0.06, 1024
#: Labelled rows whose normal equations one task sums.
ROWS_A_TASK = 50_000
STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digit", "mark", "odd_mark", "bar", "bang", "white", "line_words",
    "beyond_ascii", "distinct_words", "commonest_word", "repeated_runs", "marked_words", "long_words", "sentence_ends", "distinct_lines",
)

_CLASSES = np.zeros((8, 256), bool)
_CLASSES[0, 65:91] = True
_CLASSES[1, 48:58] = True
_CLASSES[2] = [i < 128 and chr(i).isprintable() and not chr(i).isalnum() and i != 32 for i in range(256)]
_CLASSES[3, [ord(c) for c in "#$%&*@^~<>{}[]=+_\\"]] = True
_CLASSES[4, ord("|")] = True
_CLASSES[5, ord("!")] = True
_CLASSES[6] = K.WHITE
_CLASSES[7, 128:] = True
_CODE = np.array([sum(1 << k for k in range(8) if _CLASSES[k, i]) for i in range(256)], np.uint8)


def statistics(column: pa.Array) -> np.ndarray:
    """The STATISTICS of each text; all 0 for a null or empty one."""
    out = np.zeros((len(column), len(STATISTICS)), np.float32)
    for at, n, data, offsets in K.text_blocks(column):
        size = np.diff(offsets)
        some = np.flatnonzero(size > 0)
        if not len(some):
            continue
        code = _CODE[data]
        add = lambda mask: np.add.reduceat(mask.astype(np.int64), offsets[some])
        shares = [add(code & (1 << k) != 0) / size[some] for k in range(8)]
        lines = add(data == 10) + 1
        stops = add((data == 46) | (data == 63))
        starts, ends, places = K.word_spans(data, offsets)
        words = np.diff(places)[some]
        n_words = np.maximum(words, 1)
        length = (ends - starts).astype(float)
        cum = lambda x: np.concatenate([[0.0], np.cumsum(x)])
        part = lambda x: (lambda c: c[places[some + 1]] - c[places[some]])(cum(x))
        mean = part(length) / n_words
        spread = np.sqrt(np.maximum(part(length**2) / n_words - mean**2, 0))
        last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
        marked = part(_CLASSES[3][last] | (last == 33))
        long = part(length > 20)
        hashes = K.span_hashes(data, starts, ends)
        distinct, most, runs, line_share = (np.zeros(len(some)) for _ in range(4))
        shingles, so = K.shingle_hashes(hashes, places, 3)
        breaks = np.flatnonzero(data == 10)
        line_start = np.union1d(breaks + 1, offsets[some])
        line_start = line_start[line_start < len(data)]
        line_end = np.append(line_start[1:], len(data))
        line_hash = K.span_hashes(data, line_start, line_end)
        line_at = np.searchsorted(line_start, offsets)
        for i, d in enumerate(some.tolist()):
            w = hashes[places[d] : places[d + 1]]
            if len(w):
                _, c = np.unique(w, return_counts=True)
                distinct[i], most[i] = len(c) / len(w), c.max() / len(w)
                s = shingles[so[d] : so[d + 1]]
                runs[i] = 1 - len(np.unique(s)) / len(s)
            here = line_hash[line_at[d] : line_at[d + 1]]
            line_share[i] = len(np.unique(here)) / max(len(here), 1)
        out[at + some] = np.stack([np.log1p(size[some]), np.log1p(words), np.minimum(mean, 40), np.minimum(spread, 40), *shares[:7], np.log1p(words / lines), shares[7], distinct, most, runs, marked / n_words, long / n_words, stops / n_words, line_share], 1)
    return out


def _map(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed normal directions and phases."""
    raw = (K.splitmix(71, 2 * FOURIER * width + FOURIER) >> K.U64(11)).astype(float) / (1 << 53)
    u, v, phase = raw[: FOURIER * width], raw[FOURIER * width : 2 * FOURIER * width], raw[2 * FOURIER * width :]
    normal = np.sqrt(-2 * np.log(u + 1e-300)) * np.cos(2 * np.pi * v)
    return normal.reshape(FOURIER, width) * np.sqrt(2 * GAMMA), 2 * np.pi * phase


def fourier(stats: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    w, phase = _map(len(mean))
    z = np.clip((stats - mean) / spread, -6, 6)
    return np.concatenate([np.sqrt(2 / FOURIER) * np.cos(z @ w.T + phase), z * 0.1, np.ones((len(z), 1))], 1)


def _floats(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Nondecreasing means of the sums y over n by merging neighbours that fall; x is sorted."""
    blocks: list[list[float]] = []
    for a, b in zip(y.tolist(), n.tolist()):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a2, b2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a2, blocks[-1][1] + b2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), a / b) for a, b, k in blocks]) if blocks else np.zeros(0)


def fit(features: DataFrame) -> dict:
    """Learn from (stats, label) rows; every row counts, and only sums leave a partition."""
    width = len(STATISTICS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * width + 2)
        for batch in batches:
            s = _floats(batch, "stats")
            sums += np.concatenate([[len(s), batch.column(1).to_numpy(zero_copy_only=False).sum()], s.sum(0), (s**2).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["at", "v"])

    few = features.select("stats", "label")
    # 2 * width + 2 rows, whatever the input
    got = few.mapInArrow(tidy(moments), "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    n, y, *squares = [r["v"] for r in got] or [0.0, 0.0]
    if not n or y in (0, n):
        return {"constant": float(y / n) if n else 0.5}
    v = np.array(squares) / n
    # a task's sums are a square matrix, so a task has rows enough to be worth it; tasks grow with the rows
    few = few.coalesce(max(1, math.ceil(n / ROWS_A_TASK)))
    mean = v[:width]
    spread = np.sqrt(np.maximum(v[width:] - mean**2, 0)) + 1e-6
    size = FOURIER + width + 1

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xx, xy = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            x, t = fourier(_floats(batch, "stats"), mean, spread), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            xx, xy = xx + x.T @ x, xy + x.T @ t
        sums = np.concatenate([xx, xy[None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(list(sums), pa.list_(pa.float64()))], names=["row", "v"])

    def added(group: pa.Table) -> pa.Table:
        total = group["v"].combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1).sum(0)
        return pa.table({"row": [group["row"][0].as_py()], "v": [total.tolist()]})

    # `size` + 1 rows of `size` numbers, whatever the input
    rows = few.mapInArrow(tidy(normal), "row long, v array<double>").groupBy("row").applyInArrow(added, "row long, v array<double>").orderBy("row").collect()
    sums = np.array([r["v"] for r in rows])
    shrink = np.full(size, RIDGE)
    shrink[-1] = 1e-6
    weights = np.linalg.solve(sums[:-1] + np.diag(shrink), sums[-1])
    model = {"mean": mean, "spread": spread, "weights": weights}

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros((2, BINS), np.int64)
        for batch in batches:
            b, t = bin_of(raw_score(_floats(batch, "stats"), model)), batch.column(1).to_numpy(zero_copy_only=False)
            c[0] += np.bincount(b, t, BINS).astype(np.int64)
            c[1] += np.bincount(b, minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(c[0]), pa.array(c[1])], names=["bin", "y", "n"])

    # at most BINS rows
    bins = pd.DataFrame([r.asDict() for r in few.mapInArrow(tidy(binned), "bin long, y long, n long").groupBy("bin").agg(F.sum("y").alias("y"), F.sum("n").alias("n")).where("n > 0").orderBy("bin").collect()])
    # one pseudo-document of the overall rate keeps scores off 0 and 1
    level = isotonic(bins["bin"].to_numpy(), bins["y"].to_numpy() + y / n, bins["n"].to_numpy() + 1.0)
    return model | {"at": bins["bin"].to_numpy(float), "level": level}


def bin_of(raw: np.ndarray) -> np.ndarray:
    """Bins over -0.5 to 1.5, which ridge scores of 0 and 1 labels keep to."""
    return np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)


def raw_score(stats: np.ndarray, model: dict) -> np.ndarray:
    return fourier(stats, model["mean"], model["spread"]) @ model["weights"]


def predict(stats: np.ndarray, model: dict) -> np.ndarray:
    """Probabilities; between the bins of the labelled rows they are interpolated."""
    if "constant" in model:
        return np.full(len(stats), model["constant"])
    place = np.clip((raw_score(stats, model) + 0.5) / 2 * BINS - 0.5, 0, BINS - 1)
    return np.clip(np.interp(place, model["at"], model["level"]), 0, 1)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, remainder: int = 1, divisor: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; learns from rows that are not held out.

    All labelled rows count. A document with several labels counts with the highest; null labels and
    null ids are no labels. Null and empty texts have statistics of 0 and get a score from them. Rows
    that repeat a doc_id are scored each by its own text. A null doc_id is not held out. Without labels
    of both kinds the score is constant. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = statistics(batch.column(1))
            ends = pa.array(np.arange(0, (len(s) + 1) * s.shape[1], s.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(s.reshape(-1)))], names=["doc_id", "stats"])

    bare = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    stats = materialise(bare.mapInArrow(tidy(run), "doc_id long, stats array<float>"), "statistics")
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(remainder, divisor)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    model = fit(materialise(stats.join(known, "doc_id").select("stats", "label"), "labelled"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(predict(_floats(batch, "stats"), model) if batch.num_rows else np.zeros(0))], names=["doc_id", "score"])

    out = stats.mapInArrow(tidy(scored), "doc_id long, score double")
    return out.select("doc_id", held_out(remainder, divisor).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
