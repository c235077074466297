"""Vectorised byte kernels shared by the text operators.

They read Arrow string buffers in place and work on blocks of a bounded number
of bytes, so memory does not depend on the number of rows in a batch; only a
single text longer than the block makes a block longer. All hashes are fixed
64-bit functions: the same text gives the same number in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one block holds, if no single text is longer.
BLOCK_BYTES = 1 << 20
#: The white space of the word contract: space and U+0009 to U+000D.
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
#: Separators of the looser words: all of ASCII but letters and digits.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)

U64 = np.uint64
_MASK = (1 << 64) - 1


def splitmix(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) + U64(seed * 0xD1342543DE82EF95 & _MASK)
        return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = splitmix(11, 256)
_BYTE_LOWER = _BYTE[LOWER]
_R = 0x9FB21C651E98DF25
_R_INV = pow(_R, -1, 1 << 64)
_POW: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.empty(size, U64)
        have[0], done = 1, 1
        while done < size:  # by doubling
            step = min(done, size - done)
            np.multiply(have[:step], U64(pow(base, done, 1 << 64)), out=have[done : done + step])
            done += step
        if size <= BLOCK_BYTES + 1:  # those of a longer text go with it
            _POW[base] = have
    return have[:n]


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of consecutive rows of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, to - at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of words before it (one entry more than texts)."""
    inside = ~separator[data]
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    starts[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; A-Z count as a-z if lower."""
    if not len(starts):
        return np.zeros(0, U64)
    sums = np.zeros(len(data) + 1, U64)
    values = (_BYTE_LOWER if lower else _BYTE)[data]
    values *= _powers(_R, len(data))
    np.cumsum(values, out=sums[1:])
    out = sums[ends]
    out -= sums[starts]
    out *= _powers(_R_INV, len(data) + 1)[starts]
    return mix(out)


_Q = splitmix(23, 8) | U64(1)


def shingle_hashes(words: np.ndarray, word_offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words of each text, with repeats, and their offsets by text.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    n = np.diff(word_offsets)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    total = len(words)
    if not total:
        return np.zeros(0, U64), offsets
    full = max(total - size + 1, 0)
    rolled = np.zeros(full, U64)
    for t in range(size):
        rolled += words[t : t + full] * _Q[t]
    # the places where a run of full length starts within its text
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts) + np.repeat(word_offsets[:-1], counts)
    out = np.zeros(len(place), U64)
    long = np.repeat(n >= size, counts)
    out[long] = rolled[place[long]]
    for k in range(1, size):
        at = np.repeat(n == k, counts)
        if at.any():
            part = np.full(int(at.sum()), k * int(_Q[7]) & _MASK, U64)
            for t in range(k):
                part += words[place[at] + t] * _Q[t]
            out[at] = part
    return mix(out), offsets


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def normals(seed: int, n: int) -> np.ndarray:
    """n fixed standard normal numbers."""
    raw = (splitmix(seed, 2 * n) >> U64(11)).astype(float) / (1 << 53)
    return np.sqrt(-2 * np.log(raw[:n] + 1e-300)) * np.cos(2 * np.pi * raw[n:])


def hashed(text: str) -> bytes:
    """Eight bytes of a digest of a short text."""
    import hashlib

    return hashlib.blake2b(text.encode(), digest_size=8).digest()
