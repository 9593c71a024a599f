"""Words of Arrow text columns as arrays of hashes, without a Python object for each word.

A word is ``[^\\x20\\x09-\\x0D]+``. Everything here is plain numpy over the UTF-8 bytes of a whole batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Keys of the two hashes of a word. Words over LONG bytes go through a keyed cryptographic hash, one by one.
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
LONG = 64
_JOIN = np.uint64(0xD6E8FEB86659FD93)
_HEAD = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a text column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    _, off, data = texts.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, dtype=np.int64, count=n + 1 + texts.offset)[texts.offset :]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document where its words start in them."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEEDS[0]) -> np.ndarray:
    """A 64-bit hash of each word: its length and then eight bytes at a time go through a keyed mixing chain.

    Every step is one-to-one in the bytes it takes, so words of one length up to eight bytes never collide. Words of
    more than LONG bytes are hashed whole.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) ^ np.uint64(seed))
    if len(out) == 0:
        return out
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    out = mix(out ^ (eight[starts] & _HEAD[np.minimum(size, 8)]))
    rows, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(rows):
        out[rows] = mix(out[rows] ^ (eight[starts[rows] + at] & _HEAD[np.minimum(size[rows] - at, 8)]))
        at += 8
        rows = rows[size[rows] > at]
    key = seed.to_bytes(8, "little")
    for k in np.flatnonzero(size > LONG):
        whole = hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8, key=key).digest()
        out[k] = int.from_bytes(whole, "little")
    return out


def window_hashes(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of ``width`` words that start at ``at``.

    Hashes of 1, 2, 4, ... words are joined in pairs, each join mixed, so that no sum of products lets structured
    texts cancel out as a polynomial would.
    """
    if len(at) == 0:
        return np.zeros(0, np.uint64)
    level, size, done, out = words, 1, 0, None
    while True:
        if width & size:
            part = level[at + done]
            out = part if out is None else mix(out * _JOIN + part)
            done += size
        if size * 2 > width:
            return mix(out + np.uint64(width))
        level = mix(level[:-size] * _JOIN + level[size:])
        size *= 2


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """The words at which a window of ``width`` words of one document starts. ``first``: as from word_spans."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    skip = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total, dtype=np.int64) + skip
