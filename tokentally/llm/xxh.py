"""XXH64 of many byte ranges of one buffer, vectorised over equal lengths."""

from __future__ import annotations

import numpy as np
import xxhash

# Fixed values of the XXH64 specification.
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)

_VECTOR_MAX = 512  # longer ranges are rare and hashed one by one


def _rotl(x, r):
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def xxh64_ranges(buf: bytes, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """Unsigned XXH64 of ``buf[start:start+length]`` for each range."""
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    padded = buf + b"\0" * 8
    n = len(padded) - 7
    u64 = np.ndarray((n,), "<u8", padded, strides=(1,))
    u32 = np.ndarray((n,), "<u4", padded, strides=(1,))
    u8 = np.frombuffer(padded, np.uint8)
    order = np.argsort(length, kind="stable")
    lens = length[order]
    cuts = np.flatnonzero(np.r_[True, lens[1:] != lens[:-1]])
    with np.errstate(over="ignore"):
        for i, lo in enumerate(cuts):
            rows = order[lo:cuts[i + 1] if i + 1 < len(cuts) else len(order)]
            size = int(lens[lo])
            if size > _VECTOR_MAX or len(rows) < 8:
                for r in rows:
                    s = int(start[r])
                    out[r] = xxhash.xxh64_intdigest(buf[s:s + size], seed)
                continue
            out[rows] = _same_length(u64, u32, u8, start[rows], size, np.uint64(seed))
    return out


def _same_length(u64, u32, u8, pos, size, seed):
    at = 0
    if size >= 32:
        v = [seed + P1 + P2, seed + P2, seed, seed - P1]
        while size - at >= 32:
            v = [_round(x, u64[pos + (at + 8 * k)]) for k, x in enumerate(v)]
            at += 32
        h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for x in v:
            h = (h ^ _round(np.uint64(0), x)) * P1 + P4
    else:
        h = np.full(len(pos), seed + P5, np.uint64)
    h = h + np.uint64(size)
    while size - at >= 8:
        h = _rotl(h ^ _round(np.uint64(0), u64[pos + at]), 27) * P1 + P4
        at += 8
    if size - at >= 4:
        h = _rotl(h ^ (u32[pos + at].astype(np.uint64) * P1), 23) * P2 + P3
        at += 4
    while at < size:
        h = _rotl(h ^ (u8[pos + at].astype(np.uint64) * P5), 11) * P1
        at += 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))
