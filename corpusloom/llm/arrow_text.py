"""Shared numpy views of Arrow text columns.

Every Python-side operator reads whole texts as Arrow buffers and works on
blocks of a few megabytes, so the memory of a task depends on the block size
(or on the longest single text), never on the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 4 << 20


class Block:
    """Consecutive rows with the UTF-8 bytes of their texts; a null text is empty."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        self.rows, self.data, self.offsets = rows, data, offsets
        self.n = len(offsets) - 1

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text_bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1


def blocks(batches, column: str, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts Arrow batches into blocks of about ``limit`` bytes of text, never inside a text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        array = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        if array.null_count:
            array = array.fill_null("")
        offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
        raw = array.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(array):
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), len(array))
            own = offsets[at : to + 1]
            yield Block(batch.slice(at, to - at), data[own[0] : own[-1]], own - own[0])
            at = to


def is_space(data: np.ndarray) -> np.ndarray:
    """The bytes of ``[\\x20\\x09-\\x0D]``; they never occur inside a longer UTF-8 sequence."""
    return (data == 32) | ((data - np.uint8(9)) < 5)


def word_spans(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word ``[^\\x20\\x09-\\x0D]+``, in order."""
    data, n = block.data, len(block.data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~is_space(data)
    first = np.zeros(n + 1, bool)
    first[block.offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, block.row_of(starts)


def encode_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(code of each byte span, the distinct spans); equal codes are equal bytes, no hash decides."""
    widths = ends - starts
    offsets = np.concatenate(([0], np.cumsum(widths)))
    own = data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], widths)]
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(own)])
    encoded = spans.dictionary_encode()
    return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary


def xxh64(values, seed: int = 0) -> np.ndarray:
    """XXH64 of each of some byte strings."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(v, seed) for v in (values.to_pylist() if isinstance(values, pa.Array) else values)], np.uint64)


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** i modulo 2**64 for i < n; grown by doubling and kept per process."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        out = np.ones(max(n, 1 << 16), np.uint64)
        size = 1
        while size < len(out):
            step = min(size, len(out) - size)
            out[size : size + step] = out[:step] * (out[size - 1 : size] * base)
            size += step
        _POWERS[int(base)] = have = out
    return have[:n]


class SpanHash:
    """64-bit hashes of any byte spans of one block, each in constant time, to choose places and features by.

    Different spans can be made to collide, so equal hashes are never taken for equal
    bytes.  A polynomial over ``Z/2**64`` with an odd base; prefix sums give a span's
    value up to a power of the base, which the inverse powers take out.  The
    span's length is mixed in.
    """

    def __init__(self, data: np.ndarray, salt: int = 0):
        base = np.uint64((0xD6E8FEB86659FD93 + 2 * salt * 0x1000193) & 0xFFFFFFFFFFFFFFFF)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        n = len(data)
        self.inverse = _powers(inverse, n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        table = mix64(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
        np.cumsum(table[data] * _powers(base, n), out=self.prefix[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.prefix[ends] - self.prefix[starts]) * self.inverse[starts]
        return mix64(value + (ends - starts).astype(np.uint64) * _MULTIPLIER)


def per_row_sum(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)
