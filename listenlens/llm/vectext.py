"""Vectorised word, line and shingle hashing over Arrow string columns.

A batch of texts is one byte buffer plus row offsets; every step works on whole
buffers with numpy, so no Python string is made per word.  Hashes are 64 bits
and do not depend on the process.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACES = bytes([0x20, 9, 10, 11, 12, 13])
# bytes of text handled at once; longer single texts are handled alone
SLICE_BYTES = 2 << 20
_LONG_WORD = 512

_C1 = np.uint64(0x9E3779B97F4A7C15)
_C2 = np.uint64(0xBF58476D1CE4E5B9)
_C3 = np.uint64(0x94D049BB133111EB)
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def byte_table(word_bytes) -> np.ndarray:
    """Boolean table: is this byte part of a word?"""
    t = np.zeros(256, dtype=bool)
    t[list(word_bytes)] = True
    return t


# anything but the six ASCII white-space characters
NON_SPACE = byte_table(b for b in range(256) if b not in SPACES)
# digits, ASCII letters and every byte of a non-ASCII character
ALNUM = byte_table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def buffers(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off_buf, data_buf = arr.buffers()
    off = np.frombuffer(off_buf, dtype=np.int64 if wide else np.int32)[arr.offset:arr.offset + n + 1]
    off = off.astype(np.int64)
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str,
           target: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches so that each holds about ``target`` bytes of ``column``."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = buffers(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = int(np.searchsorted(off, off[i] + target, side="right")) - 1
            j = min(max(j, i + 1), n)
            yield batch.slice(i, j - i)
            i = j


def spans(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes in ``table``: (starts, ends, row offsets into them)."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = table[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of every byte span."""
    n = len(starts)
    length = ends - starts
    h = np.full(n, np.uint64(seed) + _C1, dtype=np.uint64) + length.astype(np.uint64)
    if n == 0:
        return h
    padded = np.empty(len(data) + 8, dtype=np.uint8)
    padded[:len(data)] = data
    padded[len(data):] = 0
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    short = length <= _LONG_WORD
    todo = np.arange(n) if short.all() else np.flatnonzero(short)
    at = 0
    while len(todo):
        rest = length[todo] - at
        live = rest > 0
        if not live.all():
            todo, rest = todo[live], rest[live]
            if not len(todo):
                break
        chunk = eight[starts[todo] + at] & _LOW[np.minimum(rest, 8)]
        v = (h[todo] ^ chunk) * _C2
        h[todo] = (v ^ (v >> np.uint64(29))) * _C3
        at += 8
    for i in np.flatnonzero(~short):
        h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(data[starts[i]:ends[i]].tobytes(), seed))
    return mix(h)


def words(arr, table: np.ndarray = NON_SPACE, lower: bool = True):
    """(hashes, row offsets, starts, ends, bytes) of the words of a string column."""
    data, off = buffers(arr)
    starts, ends, word_off = spans(data, off, table)
    norm = LOWER[data] if lower else data
    return hash_spans(norm, starts, ends), word_off, starts, ends, data, off


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """Row number of every element, from row offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def shingles(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, with row offsets.

    A row of fewer than k words, but not none, gives one shingle of all its words.
    """
    count = np.diff(off)
    n_sh = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    sh_off = np.concatenate([[0], np.cumsum(n_sh)])
    row = np.repeat(np.arange(len(count)), n_sh)
    pos = off[row] + (np.arange(sh_off[-1]) - sh_off[row])
    out = np.zeros(len(pos), dtype=np.uint64)
    size = np.minimum(count, k)[row]
    for j in range(k):
        on = size > j
        if on.all():
            out = mix(out * _C1 + h[pos + j])
        elif on.any():
            out[on] = mix(out[on] * _C1 + h[pos[on] + j])
    return out, sh_off


def segment_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``values`` per row; rows may be empty."""
    c = np.concatenate([[0], np.cumsum(values)])
    return c[off[1:]] - c[off[:-1]]


def sequence_hash(h: np.ndarray, off: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of each row's word sequence (0 words: a constant)."""
    pos = np.arange(len(h), dtype=np.uint64) - np.repeat(off[:-1], np.diff(off)).astype(np.uint64)
    v = mix(h ^ mix((pos + np.uint64(seed)) * _C1))
    c = np.concatenate([[np.uint64(0)], np.cumsum(v, dtype=np.uint64)])
    n = np.diff(off).astype(np.uint64)
    return mix((c[off[1:]] - c[off[:-1]]) ^ (n * _C2))
