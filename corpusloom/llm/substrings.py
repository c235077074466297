"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 8 bytes is computed at every byte; a chunk
ends where the hash is the least within RADIUS bytes on either side. Cuts so
depend on nothing but the bytes around them: after an insertion they fall into
step again within a few dozen bytes. Chunks have RADIUS + 1 bytes at least and
about twice that on average, and at most LONGEST.

Chunks are told apart by their length and a 64-bit digest (XXH3), which no
structure of the text makes collide; a chance collision of one short chunk is no
span. A chunk that occurs more than once belongs to the smallest doc_id (there
to the first place). A run of chunks that belong elsewhere is a duplicate span
if it has LEAST bytes; shorter ones are taken for chance or phrases and stay.
The bytes of a passage before its first and after its last cut stay too, some
25 bytes at either end, so passages of 200 bytes or more are found nearly always
and those under 150 seldom.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import kernels as K
from corpusloom.llm.common import map_groups, materialise, tidy, unused

RADIUS, LONGEST, LEAST = 16, 2048, 100
_GEAR = (K.splitmix(31, 256) >> K.U64(32)).astype(np.uint32)
_REACH, _SHIFT = 8, 4


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours: out[i] = min(x[i : i + n])."""
    p, m = 1, x
    while 2 * p <= n:
        m = np.minimum(m[:-p], m[p:])
        p *= 2
    rest = n - p
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of all chunks of all texts, ascending; each text's end is one."""
    if not len(data):
        return np.zeros(0, np.int64)
    h = _GEAR[data]
    n = 1
    while n < _REACH:  # of the last n bytes to the last 2 n
        h[n:] += h[:-n] << np.uint32(_SHIFT * n)
        n *= 2
    top = np.uint32(0xFFFFFFFF)
    # no cut so near a text's start that the hash or its neighbours reach into the text before
    starts = offsets[:-1]
    near = (starts[:, None] + np.arange(_REACH + RADIUS)).reshape(-1)
    h[near[near < np.repeat(offsets[1:], _REACH + RADIUS)]] = top
    pad = np.full(RADIUS, top, np.uint32)
    wide = _least(np.concatenate([pad, h, pad]), RADIUS)
    left, right = wide[: len(h)], wide[RADIUS + 1 : RADIUS + 1 + len(h)]
    ends = np.flatnonzero((h < left) & (h <= right) & (h < top)) + 1
    ends = np.union1d(ends, offsets[1:][np.diff(offsets) > 0])
    sizes = np.diff(np.concatenate([[0], ends]))
    long = np.flatnonzero(sizes > LONGEST)
    if len(long):
        more = [np.arange(e - s + LONGEST, e, LONGEST) for e, s in zip(ends[long].tolist(), sizes[long].tolist())]
        ends = np.union1d(ends, np.concatenate(more))
    return ends


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done = 0
    for batch in batches:
        for at, n, data, offsets in K.text_blocks(batch.column(1)):
            ends = cuts(data, offsets)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
            raw = data.tobytes()
            digests = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), K.U64, len(starts))
            digests ^= (ends - starts).astype(K.U64) * K.U64(0x9E3779B97F4A7C15)
            bounds = np.searchsorted(starts, offsets)
            doc = np.repeat(np.arange(n), np.diff(bounds))
            packed = ((starts - offsets[doc]) << 12) | (ends - starts)
            ids = batch.column(0).slice(at, n)
            # the table is written before anything reads it, so a place in the input is a lasting name; equal ids and texts meet later
            row = np.arange(done, done + n) + (TaskContext.get().partitionId() << 34)
            done += n
            of = pa.array(bounds.astype(np.int32))
            yield pa.RecordBatch.from_arrays([ids, batch.column(2).slice(at, n), pa.array(row), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(of, pa.array(K.as_long(digests))), pa.ListArray.from_arrays(of, pa.array(packed))], names=["doc_id", "print", "row", "n_bytes", "digests", "places"])


_SPANS = "row long, shared_bytes long, removed_bytes long, starts array<long>, ends array<long>, owners array<long>"
#: Shared chunks that are worked through together.
_AT_ONCE = 50_000


def _lists(values: np.ndarray, of: np.ndarray, n: int) -> pa.Array:
    """Lists of the values by the index `of` (ascending, below n)."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def _spans(least: int):
    def run(table: pa.Table) -> list[pa.RecordBatch]:
        row, place, digest, owner, doc = (table[c].to_numpy() for c in ("row", "place", "digest", "owner", "doc_id"))
        order = np.lexsort((place, row))
        row, place, digest, owner, doc = (x[order] for x in (row, place, digest, owner, doc))
        start, size = place >> 12, place & 0xFFF
        # a document keeps the first of the chunks that it owns
        by_digest = np.lexsort((place, digest, row))
        first = np.ones(len(row), bool)
        first[1:] = (row[by_digest][1:] != row[by_digest][:-1]) | (digest[by_digest][1:] != digest[by_digest][:-1])
        own = np.zeros(len(row), bool)
        own[by_digest[first]] = True
        other = ~(own & (owner == doc))
        new_row = np.ones(len(row), bool)
        new_row[1:] = row[1:] != row[:-1]
        new = new_row.copy()
        new[1:] |= ~other[1:] | ~other[:-1] | (start[1:] != start[:-1] + size[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(row)) - 1
        length = start[end] + size[end] - start[begin]
        good = other[begin] & (length >= least)
        at, heads = np.cumsum(new_row) - 1, np.flatnonzero(new_row)
        span, n = begin[good], len(heads)
        removed = np.bincount(at[span], length[good], n).astype(np.int64)
        kept = np.flatnonzero(good[np.cumsum(new) - 1])
        owners = np.unique(np.stack([at[kept], owner[kept]], 1), axis=0)
        columns = [pa.array(row[heads]), pa.array(np.add.reduceat(size, heads)), pa.array(removed), _lists(start[span], at[span], n), _lists(start[span] + length[good], at[span], n), _lists(owners[:, 1], owners[:, 0], n)]
        return [pa.RecordBatch.from_arrays(columns, names=["row", "shared_bytes", "removed_bytes", "starts", "ends", "owners"])]

    return run


def repeated_spans(docs: DataFrame, least: int = LEAST, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_chunks, shared_bytes, removed_bytes, starts, ends, owners.

    Sizes and places are bytes of the text in UTF-8. shared_bytes: of all chunks that occur elsewhere or
    again; removed_bytes: of the duplicate spans, which are [starts[i], ends[i]); owners: the documents
    that keep what these hold, ascending. Null and empty texts have no chunks. A row with a null doc_id
    owns nothing and loses nothing. Rows that repeat a doc_id are no duplicates of one another. An empty
    table gives an empty result. Other columns are ignored.
    """
    out = _by_row(docs, least, text, doc_id)
    return out.drop("print")


def _by_row(docs: DataFrame, least: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of repeated_spans, each with `print`, a hash of its text."""
    bare = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("print"))
    chunked = materialise(bare.mapInArrow(tidy(_chunked), "doc_id long, print long, row long, n_bytes long, digests array<long>, places array<long>"), "chunks")
    known = chunked.where("doc_id is not null")
    # partial sums before the shuffle, so a frequent chunk is no burden
    again = known.select("doc_id", F.explode("digests").alias("digest")).groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner")).where("n > 1").select("digest", "owner")
    chunks = known.select("doc_id", "row", F.explode(F.arrays_zip("digests", "places")).alias("c")).select("doc_id", "row", F.col("c.digests").alias("digest"), F.col("c.places").alias("place"))
    shared = chunks.join(again, "digest").select("row", "doc_id", "digest", "place", "owner")
    spans = materialise(map_groups(shared, "row", _spans(least), _SPANS, at_once=_AT_ONCE), "spans")
    out = chunked.select("doc_id", "print", "row", "n_bytes", F.size("digests").cast("long").alias("n_chunks")).join(spans, "row", "left")
    none = F.array().cast("array<long>")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "print", "n_bytes", "n_chunks", zero("shared_bytes"), zero("removed_bytes"), *(F.coalesce(c, none).alias(c) for c in ("starts", "ends", "owners")))


def cut_text(raw: bytes, starts: list[int], ends: list[int]) -> str:
    """The text without the spans; a span gives way where it would split a character."""
    out, at = [], 0
    for a, b in zip(starts, ends):
        while a < len(raw) and raw[a] & 0xC0 == 0x80:
            a += 1
        while b < len(raw) and b > a and raw[b] & 0xC0 == 0x80:
            b -= 1
        out.append(raw[at:a])
        at = max(at, b)
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def deduplicate(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of docs with their duplicate spans cut out of `text`: as many rows, with all their columns.

    A null text stays null, a row of a null doc_id stays as it is, an empty table stays empty. Rows that
    repeat a doc_id are no duplicates of one another and each is cut by its own text. Columns may have
    any names.
    """
    key, print_, starts_, ends_ = (unused(docs, x) for x in ("of", "print", "starts", "ends"))
    # rows of equal doc_id and text have equal spans
    spans = _by_row(docs, least).where("removed_bytes > 0").select(F.col("doc_id").alias(key), F.col("print").alias(print_), F.col("starts").alias(starts_), F.col("ends").alias(ends_)).dropDuplicates([key, print_])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            starts, ends = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()
            text = [t if s is None or t is None else cut_text(t.encode(), s, e) for t, s, e in zip(batch.column(at).to_pylist(), starts, ends)]
            columns = [pa.array(text, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    joined = docs.join(spans, (docs["doc_id"].cast("long") == spans[key]) & (F.xxhash64(docs["text"].cast("string")) == spans[print_]), "left").drop(key, print_)
    return joined.mapInArrow(tidy(run), docs.schema)
