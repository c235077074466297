"""Alignment of two tokenizers over the same texts, and how often their ids stand over each other.

Texts are taken in blocks of some megabytes. A block's texts are one run of bytes with the
offsets of its documents; the ends of the tokens of either side are counted by byte once
(bincount), a group ends where both have an end, and running sums, read at the documents'
offsets, give each document's tokens, groups and links. Every stretch between two ends of
any side lies in exactly one token of either side, so the stretches are the links.

Ids are found for stretches that start at a single space between two other characters: neither
vocabulary has a token across such a place, so both sides end there, and a stretch always has
the same tokens. A worker remembers those of frequent stretches.

Counts of id pairs are of the whole corpus. A block keeps its distinct pairs with the number of
its documents that have them; these are summed by pair, and the sums go back to the blocks
that asked, so a pair that all documents hold is one row for each block, never for each document.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import kernels as K
from corpusloom.llm.common import map_groups, materialise, resident, tidy

#: Bytes of text that one block holds, if no single text is longer.
BLOCK_BYTES = 2 << 20
#: Stretches whose tokens a worker remembers.
REMEMBER = 400_000
_A_BITS = 32  # an id pair is a number: A's id above, B's below

# U+0085, U+00A0, U+1680, U+2000 to U+200B, U+2028, U+2029, U+202F, U+205F, U+3000, U+FEFF in UTF-8.
_WIDE_WHITE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8b\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xef\xbb\xbf")
_LOW = np.arange(256) <= 32
_EMPTY_IDS = np.zeros(0, np.int64)


def byte_level() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """The two tokenizers. encode(texts) gives for each text, to which a space is put in front, the ids and ends of both sides."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_level()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        size = self.b.get_piece_size()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.b.id_to_piece(list(range(size))))]
        # texts may be cut at single spaces if nothing is normalised and no token goes on over a space after other characters
        made = json.loads(self.a.to_str())
        special = {t["id"] for t in made["added_tokens"]}
        plain = made["normalizer"] is None and (made["pre_tokenizer"] or {}).get("type") == "ByteLevel" and not made["pre_tokenizer"]["add_prefix_space"]
        tokens = [x for i, x in enumerate(self.a_bytes) if i not in special] + self.b_bytes
        self.cuts = plain and not any(re.search(rb"[^\x00-\x20] ", _WIDE_WHITE.sub(b"\n", x)) for x in tokens)
        self.tables = [(np.array([len(x) for x in t], np.int32), t.__getitem__, list(map(str, range(len(t)))).__getitem__) for t in (self.a_bytes, self.b_bytes)]
        self.slots: dict[bytes, int] = {}
        self.side = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int64)) for _ in "ab"]
        self.good, self.uses = np.zeros(0, bool), np.zeros(0, np.int64)
        self.shown: list[bytes] = []

    def _forget(self) -> None:
        """Keep the half that is met most often."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: REMEMBER // 2])
        self.side = [(flat, width, np.concatenate([[0], np.cumsum(each)])) for flat, width, each in (gather(kept, s) for s in self.side)]
        self.good, self.uses = self.good[kept], self.uses[kept] // 2
        names = list(self.slots)
        self.slots = {names[k]: i for i, k in enumerate(kept.tolist())}
        self.shown = [self.shown[k] for k in kept.tolist()]

    def learn(self, pieces: list[bytes]) -> None:
        """Remember the tokens of stretches, which begin with a space."""
        texts = [p.decode("utf-8", "replace") for p in pieces]
        ids = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1)
        for s, (widths, _, _) in enumerate(self.tables):
            flat = np.fromiter(chain.from_iterable(ids[s]), np.int32)
            bounds = np.cumsum(np.fromiter(map(len, ids[s]), np.int64, len(pieces)))
            old = self.side[s]
            self.side[s] = (np.concatenate([old[0], flat]), np.concatenate([old[1], widths[flat]]), np.concatenate([old[2], old[2][-1] + bounds]))
        (_, bytes_a, name_a), (_, bytes_b, name_b) = self.tables
        good = np.zeros(len(pieces), bool)
        for k, (piece, x, y) in enumerate(zip(pieces, *ids)):
            xs, ys = list(map(bytes_a, x)), list(map(bytes_b, y))
            if b"".join(xs) == piece == b"".join(ys):
                good[k] = True
                self.shown.append(show(list(map(name_a, x)), list(map(name_b, y)), xs, ys).encode())
            else:
                self.shown.append(b"")
            self.slots[piece] = len(self.slots)
        self.good, self.uses = np.concatenate([self.good, good]), np.concatenate([self.uses, np.zeros(len(pieces), np.int64)])

    def lookup(self, pieces: list[bytes]) -> np.ndarray:
        """The slots of stretches."""
        if len(self.slots) > REMEMBER:
            self._forget()
        new = [p for p in dict.fromkeys(pieces) if p not in self.slots]
        for i in range(0, len(new), 20_000):
            self.learn(new[i : i + 20_000])
        at = np.fromiter(map(self.slots.__getitem__, pieces), np.int64, len(pieces))
        self.uses += np.bincount(at, minlength=len(self.uses))
        return at


def show(names_a: list[str], names_b: list[str], bytes_a: list[bytes], bytes_b: list[bytes]) -> str:
    """The groups of one stretch as text: a1,a2|b1;a3|b2,b3."""
    if len(names_a) == 1 or len(names_b) == 1:
        return f"{','.join(names_a)}|{','.join(names_b)}"
    out, j, at, to, from_i, from_j = [], 0, 0, 0, 0, 0
    for i, x in enumerate(bytes_a, 1):
        at += len(x)
        while to < at:
            to += len(bytes_b[j])
            j += 1
        if at == to:
            out.append(f"{','.join(names_a[from_i:i])}|{','.join(names_b[from_j:j])}")
            from_i, from_j = i, j
    return ";".join(out)


def gather(slots: np.ndarray, side: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, widths in bytes) of stretches in turn, and how many each has."""
    flat, width, bounds = side
    each = np.diff(bounds)[slots]
    before = np.cumsum(each) - each
    at = np.arange(int(each.sum())) - np.repeat(before - bounds[slots], each)
    return flat[at], width[at], each


def align(size: int, ends_a: np.ndarray, ends_b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two ways to cut `size` bytes into tokens, aligned.

    ends_*: byte ends of the tokens, ascending; offsets: where documents begin, and the size. Returns for each
    document its groups and its links, and for each link the token of either side and where it ends.
    """
    a, b = np.bincount(ends_a, minlength=size + 1), np.bincount(ends_b, minlength=size + 1)
    groups = np.cumsum((a > 0) & (b > 0))
    either = (a + b) > 0
    links = np.cumsum(either)
    stops = np.flatnonzero(either)
    # the token over a stretch is the first one that ends at or after its end
    of_a = np.cumsum(a)[stops] - a[stops]
    of_b = np.cumsum(b)[stops] - b[stops]
    return np.diff(groups[offsets]), np.diff(links[offsets]), of_a, of_b, stops


def stretches(data: np.ndarray, offsets: np.ndarray, cuts: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the stretches of texts that each begin with a space, and the number of stretches before each text."""
    starts = np.zeros(len(data) + 1, bool)
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    if cuts and len(data) > 2:
        white = _LOW[data]
        for m in _WIDE_WHITE.finditer(data.tobytes()):
            white[m.start() : m.end()] = True
        starts[1 : len(data) - 1] |= (data[1:-1] == 32) & ~white[:-2] & ~white[2:]
    at = np.flatnonzero(starts[:-1])
    return at, np.searchsorted(at, offsets)


def spaced(column: pa.Array) -> pa.Array:
    """A space in front of each text; null and empty texts stay without anything."""
    column = pc.fill_null(pc.cast(column, pa.large_string()), "")
    return pc.if_else(pc.equal(pc.binary_length(column), 0), pa.scalar("", pa.large_string()), pc.binary_join_element_wise(pa.scalar("", pa.large_string()), column, pa.scalar(" ", pa.large_string())))


def align_block(pair: Pair, data: np.ndarray, offsets: np.ndarray) -> dict[str, object]:
    """Everything of one block: per document n_a, n_b, n_groups, n_links, digest; pairs, their document counts,
    and per document the places of its distinct pairs in `pairs` with the number of links each has."""
    n = len(offsets) - 1
    starts, first = stretches(data, offsets, pair.cuts)
    raw = data.tobytes()
    pieces = [raw[i:j] for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(raw)])]
    slots = pair.lookup(pieces)
    bad = np.concatenate([[0], np.cumsum(~pair.good[slots])])
    good = (np.diff(first) > 0) & (np.diff(bad[first]) == 0)
    keep = np.repeat(good, np.diff(first))
    # only documents whose bytes both sides give back; the others have no bytes from here on
    shown = pair.shown
    texts = np.split(slots, first[1:-1]) if n else []
    digests = [hashlib.sha256(b";".join([shown[s] for s in t.tolist()])).hexdigest() if ok else "" for t, ok in zip(texts, good.tolist())]
    sizes = np.where(good, np.diff(offsets), 0)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    (ids_a, width_a, each_a), (ids_b, width_b, each_b) = (gather(slots[keep], side) for side in pair.side)
    n_groups, n_links, of_a, of_b, stops = align(int(offsets[-1]), np.cumsum(width_a), np.cumsum(width_b), offsets)
    at = np.concatenate([[0], np.cumsum(keep)])[first]
    per_doc = lambda each: np.diff(np.concatenate([[0], np.cumsum(each)])[at])
    linked = (ids_a[of_a].astype(np.int64) << _A_BITS) | ids_b[of_b]
    pairs, place = np.unique(linked, return_inverse=True)
    doc = np.searchsorted(offsets, stops, side="left") - 1  # the last document that begins before the end
    held, links = np.unique(doc * max(len(pairs), 1) + place, return_counts=True)
    held_doc, held_place = (held // len(pairs), held % len(pairs)) if len(pairs) else (_EMPTY_IDS, _EMPTY_IDS)
    return {
        "n_a": per_doc(each_a), "n_b": per_doc(each_b), "n_groups": n_groups, "n_links": n_links, "digests": digests,
        "pairs": pairs, "docs": np.bincount(held_place, minlength=len(pairs)), "places": held_place, "links": links,
        "bounds": np.searchsorted(held_doc, np.arange(n + 1)),
    }


_ALIGNED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places array<int>, links array<int>, pair long, docs long"


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))


def _align_batches(a_path: str, b_path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pair = resident(("pair", a_path, b_path), lambda: Pair(a_path, b_path))
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        for row, n, data, offsets in K.text_blocks(spaced(batch.column(1)), BLOCK_BYTES):
            x = align_block(pair, data, offsets)
            none = lambda k, kind: pa.nulls(k, kind)
            names = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "links", "pair", "docs"]
            whole = lambda k: pa.array(np.full(k, block), pa.int64())
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [whole(n), batch.column(0).slice(row, n).cast(pa.int64()), *(pa.array(x[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                 pa.array(x["digests"], pa.string()), _lists(x["places"], x["bounds"]).cast(ints), _lists(x["links"], x["bounds"]).cast(ints), none(n, pa.int64()), none(n, pa.int64())], names=names)
            m = len(x["pairs"])
            if m:
                yield pa.RecordBatch.from_arrays(
                    [whole(m), *(none(m, pa.int64()) for _ in range(5)), none(m, pa.string()), none(m, ints), none(m, ints), pa.array(x["pairs"], pa.int64()), pa.array(x["docs"], pa.int64())], names=names)
            block += 1


def aligned(docs: DataFrame, a_path: str, b_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows of two sorts, told apart by `pair`: those of documents (pair is null) and those of the distinct id pairs of each block."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(tidy(partial(_align_batches, a_path, b_path)), _ALIGNED)


def pair_counts(table: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, count, best): in how many documents two ids are linked, and whether no other id of B is linked with a_id in more."""
    counts = table.where("pair is not null").groupBy("pair").agg(F.sum("docs").alias("count"))
    counts = counts.withColumn("a_id", F.shiftright("pair", _A_BITS))
    most = counts.groupBy("a_id").agg(F.max("count").alias("most"))
    out = counts.join(most, "a_id")
    return out.select("pair", "a_id", F.col("pair").bitwiseAND(F.lit((1 << _A_BITS) - 1)).alias("b_id"), "count", (F.col("count") == F.col("most")).alias("best"))


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _score(group: pa.Table) -> list[pa.RecordBatch]:
    """One block: its documents with the counts of its pairs."""
    is_doc = group.column("pair").is_null()
    docs, held = group.filter(is_doc), group.filter(pc.invert(is_doc))
    order = np.argsort(held.column("pair").to_numpy())  # a block's places are those of its sorted pairs
    count = held.column("count").to_numpy()[order]
    best = held.column("best").to_numpy(zero_copy_only=False).astype(bool)[order]
    flat = pc.list_flatten(docs.column("places")).to_numpy()
    links = pc.list_flatten(docs.column("links")).to_numpy().astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(docs.column("places")).to_numpy())]).astype(np.int64)
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])
    n_best, count_sum = total(links * best[flat]), total(links * count[flat])
    cols = [docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    made = pa.Table.from_arrays([*cols, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), docs.column("groups_sha256")], names=[c.split()[0] for c in _OUT.split(", ")])
    return made.combine_chunks().to_batches()


def alignment(docs: DataFrame, a_path: str, b_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and those whose bytes one side does not give back, have no tokens: zeros, and
    '' for the digest. Rows that repeat a text or a doc_id count as documents of their own; a null doc_id
    stays null. An empty table gives no rows. Other columns of docs are not read.
    """
    table = materialise(aligned(docs, a_path, b_path, text, doc_id), "aligned")
    counts = pair_counts(table)
    asked = table.where("pair is not null").select("block", "pair").join(counts.select("pair", "count", "best"), "pair")
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    rows = table.where("pair is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "links", "pair", none("count", "long"), none("best", "boolean"))
    asked = asked.select("block", *(none(c, "long") for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), none("groups_sha256", "string"), none("places", "array<int>"), none("links", "array<int>"), "pair", "count", "best")
    return map_groups(rows.unionByName(asked), "block", _score, _OUT)
