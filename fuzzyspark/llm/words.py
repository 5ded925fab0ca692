"""Words of whole texts as NumPy arrays, a batch of texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: characters [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z: every byte of a UTF-8
#: character beyond ASCII is 0x80 or more, so bytes decide; 0 ends a word
ALNUM = np.zeros(256, np.uint8)
ALNUM[48:58] = np.arange(48, 58)
ALNUM[97:123] = np.arange(97, 123)
ALNUM[65:91] = np.arange(97, 123)
ALNUM[128:] = np.arange(128, 256)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64))
_BASE = np.uint64(0x5851F42D4C957F2D)


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p) if n else p


_POW = _powers(4096)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a batch of texts and their n + 1 offsets; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = ALNUM):
    """(folded bytes, starts, ends, first word of each text); words never cross texts."""
    w = table[data]
    on = w != 0
    first, last = on.copy(), on.copy()
    first[1:] &= ~on[:-1]
    last[:-1] &= ~on[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(on))]
    first[cut] = on[cut]
    last[cut - 1] = on[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return w, starts, ends, np.searchsorted(starts, offsets)


def word_array(w: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words' folded bytes as strings."""
    to = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(to), pa.py_buffer(np.ascontiguousarray(w[w != 0]))])


def word_hashes(w: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's folded bytes."""
    global _POW
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    if lens.max() > len(_POW):
        _POW = _powers(int(lens.max()))
    at = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(at, lens)
    return _mix(np.add.reduceat(_BYTE[w[w != 0]] * _POW[place], at) + lens.astype(np.uint64))
