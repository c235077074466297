"""Token ids of a corpus in a binary format of plane-shuffled blocks.

A shard file holds, in this order: a magic string, the blocks, an index and a
fixed-size tail. A block has up to BLOCK_IDS ids; they are transposed into byte
planes (or bit planes), and each plane is compressed with zstandard by itself,
so that slowly varying high planes cost next to nothing. Planes that are all
zero are not stored. The index lists the blocks (file offset, ids, size of each
plane) and the documents (doc_id, number of ids), so any document can be read
with one ranged read.

Documents are dealt to shards by ranges of doc_id and written in ascending
order; the order over all shards is that of (shard, place).
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm import kernels as K
from corpusloom.llm.common import materialise, new_path, resident, shuffle_partitions, tidy

MAGIC = b"PLANEIDS"
BLOCK_IDS = 1 << 18
#: Pieces whose ids a worker remembers.
REMEMBER = 600_000


# ---------------------------------------------------------------- the format


def pack_planes(ids: np.ndarray, planes: str = "byte") -> list[bytes]:
    """Planes of a block of unsigned 32-bit ids, lowest first, each compressed; an all-zero plane is b''."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        rows = [np.ascontiguousarray(raw[:, k]) for k in range(4)]
    else:
        top = int(ids.max()).bit_length() if len(ids) else 0
        rows = [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1) for k in range(top)] + [np.zeros(0, np.uint8)] * (32 - top)
    press = zstandard.ZstdCompressor(level=1)
    return [press.compress(r.tobytes()) if r.any() else b"" for r in rows]


def unpack_planes(parts: list[bytes], n: int, planes: str = "byte") -> np.ndarray:
    press = zstandard.ZstdDecompressor()
    if planes == "byte":
        raw = np.zeros((n, 4), np.uint8)
        for k, part in enumerate(parts):
            if part:
                raw[:, k] = np.frombuffer(press.decompress(part, n), np.uint8)
        return raw.reshape(-1).view("<u4")
    out = np.zeros(n, np.uint32)
    for k, part in enumerate(parts):
        if part:
            out |= np.unpackbits(np.frombuffer(press.decompress(part, (n + 7) // 8), np.uint8), count=n).astype(np.uint32) << np.uint32(k)
    return out


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


class ShardWriter:
    """Writes one shard; memory holds one block and the index."""

    def __init__(self, uri: str, planes: str = "byte"):
        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out, self.planes = self.fs.open_output_stream(self.path), planes
        self.out.write(MAGIC)
        self.at, self.held, self.n_held = len(MAGIC), [], 0
        self.blocks: list[tuple] = []
        self.doc_ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.counts.append(counts)
        self.held.append(ids)
        self.n_held += len(ids)
        while self.n_held >= BLOCK_IDS:
            joined = np.concatenate(self.held)
            for i in range(0, len(joined) - BLOCK_IDS + 1, BLOCK_IDS):
                self._block(joined[i : i + BLOCK_IDS])
            rest = len(joined) % BLOCK_IDS
            self.held, self.n_held = [joined[len(joined) - rest :]], rest

    def _block(self, ids: np.ndarray) -> None:
        parts = pack_planes(ids, self.planes)
        self.blocks.append((self.at, len(ids), [len(p) for p in parts]))
        for p in parts:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        press = zstandard.ZstdCompressor(level=1)
        join = lambda x: np.concatenate(x).astype("<i8") if x else np.zeros(0, "<i8")
        parts = [press.compress(json.dumps({"planes": self.planes, "blocks": self.blocks}).encode()), press.compress(join(self.doc_ids).tobytes()), press.compress(join(self.counts).tobytes())]
        for p in parts:
            self.out.write(p)
        self.out.write(struct.pack("<4q8s", self.at, *map(len, parts), MAGIC))
        self.out.close()


class Shard:
    """Reads a shard: its documents, and the ids of any of them."""

    def __init__(self, uri: str):
        self.fs, path = open_fs(uri)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        at, a, b, c, magic = struct.unpack("<4q8s", self._read(size - 40, 40))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        press = zstandard.ZstdDecompressor()
        raw = self._read(at, a + b + c)
        head = json.loads(press.decompress(raw[:a]))
        self.planes, self.blocks = head["planes"], head["blocks"]
        self.doc_ids = np.frombuffer(press.decompress(raw[a : a + b]), "<i8")
        self.counts = np.frombuffer(press.decompress(raw[a + b :]), "<i8")
        self.starts = np.concatenate([[0], np.cumsum([n for _, n, _ in self.blocks])]).astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def block(self, i: int) -> np.ndarray:
        at, n, sizes = self.blocks[i]
        raw, parts = self._read(at, sum(sizes)), []
        for s in sizes:
            parts.append(raw[:s])
            raw = raw[s:]
        return unpack_planes(parts, n, self.planes)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from the place `start` of the shard; reads only the blocks that hold them."""
        first, last = int(np.searchsorted(self.starts, start, side="right")) - 1, int(np.searchsorted(self.starts, start + n, side="left"))
        got = [self.block(i) for i in range(max(first, 0), min(last, len(self.blocks)))]
        skip = start - int(self.starts[max(first, 0)])
        return np.concatenate(got or [np.zeros(0, np.uint32)])[skip : skip + n]

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document in order; holds one document and one block."""
        i, held = 0, np.zeros(0, np.uint32)
        for n in self.counts.tolist():
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.block(i))
                have += len(parts[-1])
                i += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield held[:n]
            held = held[n:]

    def close(self) -> None:
        self.file.close()


# ---------------------------------------------------------------- encoding

_LETTER = np.array([chr(i).isalpha() and i < 128 for i in range(256)])
_MARK = np.array([i < 128 and not _LETTER[i] and i != 39 and not K.WHITE[i] for i in range(256)])


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that the tokenizer treats alike wherever they stand: words, cut further between
    a letter and an ASCII mark other than the apostrophe (which starts contractions)."""
    inside = ~K.WHITE[data]
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    letter, mark = _LETTER[data], _MARK[data]
    any_letter = letter.copy()  # and U+00C0 to U+00FF but the signs for times and division
    any_letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    cut = (any_letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | cut
    ends[:-1] &= ~inside[1:] | cut
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    starts[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets)


class Encoder:
    """Ids of whole texts, the same as the tokenizer's own, with the ids of pieces remembered.

    The vocabulary's pre-tokenizer never joins across white space or between a letter and such a
    mark, and its normaliser works within these pieces, so a text's ids are those of its pieces in
    turn. Texts that may hold one of the added tokens go through the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t["content"].encode() for t in json.loads(open(path, encoding="utf-8").read()).get("added_tokens", [])]
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.bounds = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _slots(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each distinct hash the slot of its ids; starts and ends are of one piece that has it."""
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == hashes if len(self.keys) else np.zeros(len(hashes), bool)
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.keys) > REMEMBER:
                self._forget()
                return self._slots(hashes, data, starts, ends)
            raw = data.tobytes()
            got: list[int] = []
            lens = np.empty(len(new), np.int64)
            for i in range(0, len(new), 20_000):
                part = new[i : i + 20_000]
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[part].tolist(), ends[part].tolist())]
                for k, e in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                    ids = e.ids
                    got += ids
                    lens[i + k] = len(ids)
            keys = np.concatenate([self.keys, hashes[new]])
            slots = np.concatenate([self.slots, np.arange(len(self.bounds) - 1, len(self.bounds) - 1 + len(new))])
            order = np.argsort(keys)
            self.keys, self.slots = keys[order], slots[order]
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(lens)])
            self.flat = np.concatenate([self.flat, np.array(got, np.uint32)])
            at = np.searchsorted(self.keys, hashes)
        return self.slots[at]

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each text); end_id follows each text if given."""
        n = len(offsets) - 1
        whole: dict[int, list[int]] = {}
        raw = data.tobytes()
        if any(t in raw for t in self.added):
            for i in range(n):
                text = raw[offsets[i] : offsets[i + 1]]
                if any(t in text for t in self.added):
                    whole[i] = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        starts, ends, places = _pieces(data, offsets)
        if len(starts):
            codes, distinct = pd.factorize(K.span_hashes(data, starts, ends))
            one = np.empty(len(distinct), np.int64)
            one[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            slots = self._slots(distinct, data, starts[one], ends[one])
            lens = np.diff(self.bounds)[slots]
            each = lens[codes]
            before = np.concatenate([[0], np.cumsum(each)])
            ids = self.flat[np.arange(before[-1]) - np.repeat(before[:-1] - self.bounds[slots][codes], each)]
            counts = np.diff(before[places])
        else:
            ids, counts = np.zeros(0, np.uint32), np.zeros(n, np.int64)
        if whole:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i, w in whole.items():
                parts[i] = np.array(w, np.uint32)
                counts[i] = len(w)
            ids = np.concatenate(parts).astype(np.uint32)
        if end_id is None:
            return ids, counts
        out = np.full(len(ids) + n, end_id, np.uint32)
        body = np.ones(len(out), bool)
        body[np.cumsum(counts + 1) - 1] = False
        out[body] = ids
        return out, counts + 1


def encoder(path: str) -> Encoder:
    return resident(("encoder", path), lambda: Encoder(path))


# ---------------------------------------------------------------- the operator

NULL_ID = -(1 << 63)


def write_token_ids(docs: DataFrame, vocabulary: str, end_id: int = 1, planes: str = "byte", text: str = "text", doc_id: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """Encode whole texts and write them in ascending doc_id order; returns the shards.

    One row for each shard: shard (their order), path, n_docs, n_tokens, start (ids in all shards
    before it). A null or empty text has only the end id. A null doc_id comes first and reads back as
    null. Rows that repeat a doc_id are each written, in no fixed order among themselves. An empty table
    gives no shards.

    `vocabulary` is the path of a tokenizers file, present on every executor. A task writes a file of its
    own name; only the files of tasks that succeeded are listed, so retried and lost tasks do no harm.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "shards")
    n = partitions or shuffle_partitions(spark)
    dealt = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, n_docs, n_tokens = TaskContext.get(), None, 0, 0
        uri = f"{folder}/shard-{task.partitionId():05d}-{task.taskAttemptId()}.ids"
        for batch in batches:
            ids_of = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            for at, k, data, offsets in K.text_blocks(batch.column(1)):
                ids, counts = encoder(vocabulary).encode(data, offsets, end_id)
                out = out or ShardWriter(uri, planes)
                out.add(ids_of[at : at + k], counts, ids)
                n_docs, n_tokens = n_docs + k, n_tokens + len(ids)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "path": [uri], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    shards = materialise(dealt.mapInArrow(tidy(run), "shard int, path string, n_docs long, n_tokens long"), "shard-list")
    # as many rows as shards
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(shards: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(path)
                crc = np.fromiter((zlib.crc32(x) for x in shard.documents()), np.int64, len(shard.counts))
                starts = start + np.concatenate([[0], np.cumsum(shard.counts)[:-1]]) if len(shard.counts) else np.zeros(0, np.int64)
                ids = pa.array(shard.doc_ids.astype(np.int64), mask=shard.doc_ids == NULL_ID)
                shard.close()
                yield pa.RecordBatch.from_arrays([ids, pa.array(starts.astype(np.int64)), pa.array(shard.counts.astype(np.int64)), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = shards.select("path", "start")
    return rows.repartition(max(1, shuffle_partitions(rows.sparkSession)), "path").mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Write and read back: one row for each document, from the files."""
    return read_documents(write_token_ids(docs, vocabulary, **options))
