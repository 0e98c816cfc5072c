"""Vectorised word hashing over Arrow string columns (helpers for tasks).

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D. All of these are
ASCII, so the split is the same on UTF-8 bytes and on code points.
"""

from __future__ import annotations

import hashlib

import numpy as np

_BLOCK = 1 << 20
#: Longer words are hashed one by one.
_LONG = 256


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += np.uint8(32)
    space = np.zeros(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
    return fold, space, masks


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of an Arrow string array; nulls are empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def blocks(offsets: np.ndarray, size: int = _BLOCK):
    """Consecutive row ranges of about ``size`` bytes, one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def _hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes at a time, each mixed before the next: equal lengths of up to eight bytes never clash."""
    n = ends - starts
    eights = np.lib.stride_tricks.as_strided(np.concatenate([b, np.zeros(8, np.uint8)]), (len(b) + 1, 8), (1, 1))
    h = mix(eights[starts].view(np.uint64)[:, 0] & masks[np.minimum(n, 8)]) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rest = np.flatnonzero((n > 8) & (n <= _LONG))
    for done in range(8, _LONG, 8):
        if not len(rest):
            break
        x = eights[starts[rest] + done].view(np.uint64)[:, 0] & masks[np.minimum(n[rest] - done, 8)]
        h[rest] = mix(h[rest] * np.uint64(0xD6E8FEB86659FD93) + mix(x + np.uint64(done)))
        rest = rest[n[rest] > done + 8]
    for i in np.flatnonzero(n > _LONG):
        h[i] = int.from_bytes(hashlib.blake2b(b[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(h)


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows offsets[0]..offsets[-1]: 64-bit hashes of the words (A-Z folded unless told otherwise), word bounds of each row (n+1), starts and ends in bytes."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    b = data[lo:hi]
    at = offsets - lo
    if not len(b):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), np.zeros(len(offsets), np.int64), none, none
    folded, space, masks = _tables()
    word = ~space[b]
    edge = np.zeros(len(b) + 1, dtype=bool)
    edge[at[:-1]] = True
    edge[-1] = True
    before = np.empty(len(b), dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(len(b), dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    h = _hashes(folded[b] if fold else b, starts, ends, masks)
    return h, np.searchsorted(starts, at), starts + lo, ends + lo


def shingles(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row, and their bounds; a row of fewer words has its whole sequence as one."""
    counts = np.diff(bounds)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    first = bounds[:-1][row] + (np.arange(out_bounds[-1]) - out_bounds[:-1][row])
    stop = bounds[1:][row]
    acc = np.zeros(len(first), dtype=np.uint64)
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    for j in range(k):
        inside = first + j < stop
        acc = np.where(inside, mix(acc * np.uint64(0xD6E8FEB86659FD93) + padded[first + j]), acc)
    return acc, out_bounds


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row and their bounds."""
    out, sizes = [], np.zeros(len(bounds) - 1, np.int64)
    for i in range(len(sizes)):
        part = values[bounds[i] : bounds[i + 1]]
        if len(part):
            part = np.sort(part)
            part = part[np.concatenate([[True], part[1:] != part[:-1]])]
            out.append(part)
            sizes[i] = len(part)
    return (np.concatenate(out) if out else values[:0]), np.concatenate([[0], np.cumsum(sizes)])


def min_hashes(values: np.ndarray, bounds: np.ndarray, n_hashes: int, seed: int) -> np.ndarray:
    """MinHash signatures, a row of ``n_hashes`` uint32 for each row; rows without values have the maximum."""
    rng = np.random.Generator(np.random.PCG64(seed))
    factor = rng.integers(0, 1 << 31, n_hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    flip = rng.integers(0, 1 << 32, n_hashes, dtype=np.uint32)
    out = np.full((n_hashes, len(bounds) - 1), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if not len(full):
        return out.T
    step = max(1, int(len(full) * 65536 / max(1, len(values))))
    for a in range(0, len(full), step):
        part = full[a : a + step]
        lo, hi = bounds[part[0]], bounds[part[-1] + 1]
        v = (values[lo:hi] >> np.uint64(32)).astype(np.uint32)
        starts = bounds[part] - lo
        t = np.empty_like(v)
        for k in range(n_hashes):
            np.bitwise_xor(v, flip[k], out=t)
            np.multiply(t, factor[k], out=t)
            out[k, part] = np.minimum.reduceat(t, starts)
    return out.T
