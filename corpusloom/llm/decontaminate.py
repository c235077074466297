"""Benchmark decontamination: SimHash of item-sized windows, Hamming block index, exact weighted similarity.

Every document is read through sliding windows of the sizes of the benchmark
items (rounded down to a ladder of sizes) and of half of those sizes, so that
an edit in one half of a passage leaves the other half intact. A window's
64-bit SimHash is the majority of the hashes of its shingles, bit by bit;
window sums come from sums over runs of 1, 2, 4 ... shingles. The fingerprints
of the items' own windows are indexed by RADIUS + 1 blocks of bits: one within
RADIUS of a document's window equals it in at least one block, so none is
missed. Besides, each item has anchors: shingles that together weigh more than a
passage may lack. A passage near enough has one of them unchanged, wherever its
edits are. A candidate is confirmed by the exact similarity of the item's
shingles and those of the best run of the document's words at that place,
weighted by their letters.

The benchmark is worked through in blocks of bounded size, each against all
documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import kernels as K
from corpusloom.llm.common import tidy

SIZE, RADIUS = 5, 3
#: Words of the benchmark that one pass over the documents carries.
PASS_WORDS = 1_000_000
_STEP = 16_384
TILE = 20
#: Window sizes grow by about a cube root of two.
LADDER = sorted({*range(1, 9), *(int(round(8 * 2 ** (k / 3))) for k in range(1, 60))})


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and letters of the words (runs of ASCII letters and digits and of what is beyond ASCII), and offsets by text."""
    starts, ends, places = K.word_spans(data, offsets, K.NOT_ALNUM)
    return K.span_hashes(data, starts, ends), ends - starts, places


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words, without regard to texts."""
    n = max(len(words) - size + 1, 0)
    out = np.full(n, K.U64(size), K.U64)
    for t in range(size):
        out += words[t : t + n] * K._Q[t]
    return K.mix(out)


def simhashes(shingles: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each k of lengths the fingerprints of all runs of k shingles; a bit is set if most have it."""
    m = len(shingles)
    bits = np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(m, 8), axis=1)
    sums = {1: bits.view(np.int8) if max(lengths) <= 127 else bits.astype(np.int16)}
    p = 1
    while 2 * p <= max(lengths):
        sums[2 * p] = sums[p][: m - 2 * p + 1] + sums[p][p : m - p + 1]
        p *= 2
    out = {}
    for k in lengths:
        n, total, at = m - k + 1, None, 0
        for p in sorted(sums, reverse=True):
            if k & p:
                part = sums[p][at : at + n]
                total, at = part if total is None else total + part, at + p
        out[k] = np.packbits(total > k // 2, axis=1).view(np.uint64).reshape(-1)
    return out


def pieces(n: int) -> list[tuple[int, int]]:
    """(window size, offset) of the windows of an item of n words: its own size, at both ends; half of it, there
    and in the middle; for longer items also tiles of at most TILE words.

    At a similarity of 0.8 no more than a ninth of the shingles differ. So a passage has about one changed
    word in 45 and changes near its ends, and these leave one half, the middle or a tile intact.
    """
    own = max(x for x in LADDER if x <= n)
    out = {(own, 0), (own, n - own)}
    if n >= 16:
        half = max(x for x in LADDER if x <= n // 2)
        out |= {(half, 0), (half, (n - half) // 2), (half, n - half)}
    if n >= 3 * TILE:
        tile = max(x for x in LADDER if x <= min(n // 4, TILE))
        out |= {(tile, i * (n - tile) // (n // tile - 1)) for i in range(n // tile)}
    return sorted(out)


class Items:
    """A block of the benchmark, indexed."""

    def __init__(self, ids: list[int], texts: list[str], least: float = 0.8):
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        words, letters, places = _words(np.frombuffer(b"".join(raw), np.uint8), offsets)
        self.ids = ids
        self.sizes = np.diff(places)
        self.sets: list[tuple[np.ndarray, np.ndarray]] = []
        groups: dict[tuple[int, int], list[tuple[int, int]]] = {}
        anchors: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for i, n in enumerate(self.sizes.tolist()):
            w, length = words[places[i] : places[i + 1]], letters[places[i] : places[i + 1]]
            s = min(SIZE, n)
            self.sets.append(weighted(w, length, s) if n else (np.zeros(0, K.U64), np.zeros(0, np.int64)))
            if n:
                mine = self._anchors(*self.sets[i], least)
                anchors.setdefault(s, []).append((mine, np.full(len(mine), i)))
            for window, at in pieces(n) if n else []:
                k = window - s + 1
                print_ = int(simhashes(_runs(w[at : at + window], s), [k])[k][0])
                groups.setdefault((s, window), []).append((print_, i))
        self.groups = {}
        for key, rows in groups.items():
            prints = np.array([r[0] for r in rows], K.U64)
            self.groups[key] = (prints, np.array([r[1] for r in rows], np.int64), self._index(prints))
        self.anchors = {}
        for s, parts in anchors.items():
            shingles, i = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(shingles, kind="stable")
            occurs = np.zeros(1 << 20, bool)
            occurs[shingles & K.U64((1 << 20) - 1)] = True
            self.anchors[s] = (occurs, shingles[order], i[order])

    @staticmethod
    def _anchors(shingles: np.ndarray, weights: np.ndarray, least: float) -> np.ndarray:
        """The fewest of the shingles that weigh more than 1 - least of all: what shares none of them is less similar than `least`."""
        order = np.argsort(-weights, kind="stable")
        enough = int(np.searchsorted(np.cumsum(weights[order]), (1 - least + 1e-9) * weights.sum(), side="right")) + 1
        return shingles[order[:enough]]

    def anchored(self, runs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) of the runs of `size` words that are an anchor."""
        occurs, mine, of = self.anchors[size]
        hit = np.flatnonzero(occurs[runs & K.U64((1 << 20) - 1)])
        lo, hi = np.searchsorted(mine, runs[hit], "left"), np.searchsorted(mine, runs[hit], "right")
        n = hi - lo
        return np.repeat(hit, n), of[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]

    @staticmethod
    def _index(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each block of bits: which values occur, and the fingerprints by value."""
        width, out = 64 // (RADIUS + 1), []
        for b in range(RADIUS + 1):
            values = (prints >> K.U64(b * width)) & K.U64((1 << width) - 1)
            occurs = np.zeros(1 << width, bool)
            occurs[values] = True
            order = np.argsort(values)
            out.append((occurs, values[order], order))
        return out

    def candidates(self, prints: np.ndarray, key: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """(place, row of the group) of all within RADIUS."""
        mine, _, index = self.groups[key]
        width = 64 // (RADIUS + 1)
        places, rows = [], []
        blocks = prints.view(np.uint16).reshape(-1, 4)  # width is 16 on a little-endian machine
        for b, (occurs, values, order) in enumerate(index):
            part = blocks[:, b] if width == 16 else (prints >> K.U64(b * width)) & K.U64((1 << width) - 1)
            hit = np.flatnonzero(occurs[part])
            if len(hit):
                lo, hi = np.searchsorted(values, part[hit], "left"), np.searchsorted(values, part[hit], "right")
                n = hi - lo
                at = np.repeat(hit, n)
                row = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
                near = np.bitwise_count(prints[at] ^ mine[row]) <= RADIUS
                places.append(at[near])
                rows.append(row[near])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.stack([np.concatenate(places), np.concatenate(rows)], 1), axis=0)
        return both[:, 0], both[:, 1]


def weighted(words: np.ndarray, letters: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles in order, and for each its weight: its letters."""
    runs = _runs(words, size)
    total = np.concatenate([[0], np.cumsum(letters)])
    shingles, first = np.unique(runs, return_index=True)
    return shingles, (total[size:] - total[:-size])[first]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weight of the shared shingles over that of all."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    shared = int(a[1][same].sum())
    return shared / (int(a[1].sum()) + int(b[1].sum()) - shared)


def best_run(item: tuple[np.ndarray, np.ndarray], words: np.ndarray, letters: np.ndarray, size: int, least: float) -> tuple[float, int]:
    """The highest similarity of the item and any run of these words, and where that run begins; 0.0 if none has `least`.

    The best run begins and ends with a shingle of the item. A shingle counts once in a run: where the one
    before of its kind is left of the run.
    """
    runs = _runs(words, size)
    if not len(runs):
        return 0.0, 0
    at = np.minimum(np.searchsorted(item[0], runs), len(item[0]) - 1)
    shared = item[0][at] == runs
    weight = np.convolve(letters, np.ones(size, np.int64), "valid")
    mine, whole = weight * shared, int(item[1].sum())
    order = np.argsort(runs, kind="stable")
    before = np.full(len(runs), -1)
    again = runs[order[1:]] == runs[order[:-1]]
    before[order[1:][again]] = order[:-1][again]
    # what begins here has at most so much of the item
    starts = np.flatnonzero(shared & (np.cumsum(mine[::-1])[::-1] >= least * whole))
    best, begin = 0.0, 0
    for a in starts.tolist():
        first = before[a:] < a
        both = np.cumsum(mine[a:] * first)
        sims = both / (whole + np.cumsum(weight[a:] * first) - both)
        top = float(sims.max())
        if top > best:
            best, begin = top, a
    return (best, begin) if best >= least else (0.0, 0)


def scan(items: Items, least: float):
    """A mapInArrow function from (doc_id, text) to confirmed passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[int, list[int]] = {}
        for s, window in items.groups:
            sizes.setdefault(s, []).append(window)
        for batch in batches:
            found: dict[tuple[int, int], tuple[float, int]] = {}
            for at, n, data, offsets in K.text_blocks(batch.column(1)):
                words, letters, places = _words(data, offsets)
                ends = np.repeat(places[1:], np.diff(places))
                tried = set()
                for s, windows in sizes.items():
                    runs, ks = _runs(words, s), [w - s + 1 for w in windows]
                    start, i = items.anchored(runs, s)
                    whole = start + s <= ends[start]  # within one text
                    tried.update(zip(start[whole].tolist(), i[whole].tolist()))
                    for lo in range(0, len(runs), _STEP):
                        part = runs[lo : lo + _STEP + max(ks) - 1]
                        fit = [k for k in ks if k <= len(part)]
                        for k, prints in (simhashes(part, fit) if fit else {}).items():
                            key = (s, k + s - 1)
                            where, rows = items.candidates(prints[:_STEP], key)
                            if not len(where):
                                continue
                            start = where + lo
                            whole = start + key[1] <= ends[start]  # within one text
                            tried.update(zip(start[whole].tolist(), items.groups[key][1][rows[whole]].tolist()))
                # the window's own text, in stretches of the item's size and twice that on either side
                stretches = set()
                for p, i in tried:
                    doc = int(np.searchsorted(places, p, side="right")) - 1
                    stretches.add((doc, i, (p - int(places[doc])) // int(items.sizes[i])))
                for doc, i, k in sorted(stretches):
                    size, first, last = int(items.sizes[i]), int(places[doc]), int(places[doc + 1])
                    a, b = first + max((k - 2) * size, 0), min(first + (k + 3) * size, last)
                    best, begin = best_run(items.sets[i], words[a:b], letters[a:b], min(SIZE, size), least)
                    begin += a - first
                    if best >= least:
                        key = (at + doc, i)
                        if best > found.get(key, (0.0, 0))[0] or best == found[key][0] and begin < found[key][1]:
                            found[key] = (best, begin)
            rows = sorted(found)
            docs = batch.column(0).take(pa.array([r for r, _ in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([docs, pa.array([items.ids[i] for _, i in rows], pa.int64()), pa.array([found[r][0] for r in rows], pa.float64()), pa.array([found[r][1] for r in rows], pa.int64())], names=["doc_id", "item_id", "similarity", "first_word"])

    return run


def _blocks(benchmark: DataFrame, item_id: str, text: str, least: float) -> Iterator[Items]:
    """The benchmark a block of about PASS_WORDS words at a time; the driver holds one block."""
    ids, texts, words = [], [], 0
    for r in benchmark.where(F.col(text).isNotNull()).select(F.col(item_id).cast("long"), F.col(text).cast("string")).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        words += r[1].count(" ") + 1
        if words >= PASS_WORDS:
            yield Items(ids, texts, least)
            ids, texts, words = [], [], 0
    if ids:
        yield Items(ids, texts, least)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document row and benchmark item whose passage it holds: doc_id, item_id, similarity,
    first_word (where the best match begins, among the words of the document).

    Words are runs of letters and digits, A-Z lower-cased, so marks and line breaks within a passage
    make no difference. A passage counts at a weighted similarity of five-word shingles of `least` or
    more (an item of fewer words is one shingle). Null, empty and wordless texts and items match nothing.
    Rows that repeat a doc_id or item_id are matched each by itself. Empty tables give no rows.
    """
    spark = docs.sparkSession
    bare = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for items in _blocks(benchmark, item_id, item_text, least):
        part = bare.mapInArrow(tidy(scan(items, least)), "doc_id long, item_id long, similarity double, first_word long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        kinds = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType())])
        return spark.createDataFrame([], kinds)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of docs that hold no benchmark passage, with all their columns; a null doc_id is decided by its own text.

    Decisions are made row by row in one pass, without a join.
    """
    out = docs
    names = docs.columns
    for items in _blocks(benchmark, "item_id", "text", least):
        found = scan(items, least)

        def keep(batches: Iterator[pa.RecordBatch], found=found) -> Iterator[pa.RecordBatch]:
            at = names.index("text")
            for batch in batches:
                rows = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], names=["row", "text"])
                hit = np.zeros(batch.num_rows, bool)
                for got in found(iter([rows])):
                    hit[got.column(0).to_numpy()] = True
                yield batch.filter(pa.array(~hit))

        out = out.mapInArrow(tidy(keep), docs.schema)
    return out
