"""XXH64 of many slices of one byte buffer at once, in numpy.

Same values as the public XXH64 definition (and as Spark's ``xxhash64`` of a
string, whose seed is 42).  Slices are handled lane by lane over the subset
that still has a lane, so the cost is a few numpy passes per 8 bytes.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the public XXH64 definition.
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)
BLOCK = 16384


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rot(acc + lane * P2, 31) * P1


def _block(u64, u32, u8, start, length, seed) -> np.ndarray:
    n = len(start)
    pos = start.copy()
    left = length.copy()
    acc = np.full(n, seed + P5, np.uint64)
    big = np.flatnonzero(length >= 32)
    if len(big):
        p, rest = pos[big], left[big]
        v = [np.full(len(big), s, np.uint64) for s in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        live = np.arange(len(big))
        while len(live):
            for k in range(4):
                v[k][live] = _round(v[k][live], u64[p[live] + 8 * k])
            p[live] += 32
            rest[live] -= 32
            live = live[rest[live] >= 32]
        h = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
        for x in v:
            h = (h ^ _round(np.uint64(0), x)) * P1 + P4
        acc[big], pos[big], left[big] = h, p, rest
    acc += length.astype(np.uint64)
    for _ in range(3):
        i = np.flatnonzero(left >= 8)
        if not len(i):
            break
        acc[i] = _rot(acc[i] ^ _round(np.uint64(0), u64[pos[i]]), 27) * P1 + P4
        pos[i] += 8
        left[i] -= 8
    i = np.flatnonzero(left >= 4)
    acc[i] = _rot(acc[i] ^ (u32[pos[i]].astype(np.uint64) * P1), 23) * P2 + P3
    pos[i] += 4
    left[i] -= 4
    for _ in range(3):
        i = np.flatnonzero(left > 0)
        if not len(i):
            break
        acc[i] = _rot(acc[i] ^ (u8[pos[i]].astype(np.uint64) * P5), 11) * P1
        pos[i] += 1
        left[i] -= 1
    acc ^= acc >> np.uint64(33)
    acc *= P2
    acc ^= acc >> np.uint64(29)
    acc *= P3
    return acc ^ (acc >> np.uint64(32))


def xxh64_slices(data: bytes, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of ``data[start[i]:end[i]]`` for every i, as unsigned 64-bit integers."""
    buf = data + b"\0" * 8
    n = len(buf)
    u8 = np.frombuffer(buf, np.uint8)
    u32 = np.ndarray((n - 3,), "<u4", buf, strides=(1,))
    u64 = np.ndarray((n - 7,), "<u8", buf, strides=(1,))
    out = np.empty(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(start), BLOCK):
            s = start[a:a + BLOCK].astype(np.int64)
            out[a:a + BLOCK] = _block(u64, u32, u8, s, end[a:a + BLOCK].astype(np.int64) - s, np.uint64(seed))
    return out
