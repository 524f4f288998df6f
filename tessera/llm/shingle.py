"""Vectorised hashes of words and of runs of words or bytes.

A run is hashed as a polynomial modulo 2^64 with an odd base: with running sums of
``x[j] * base^j`` the hash of every window comes from one subtraction and one product by
the inverse power, and is then mixed.  Two bases give 128 bits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASES = (0x9E3779B97F4A7C15 | 5, 0xD1342543DE82EF95)
CHUNK = 1 << 15  # values worked on at a time: the intermediate arrays then stay in the cache

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(8)
def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    base = BASES[which]
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << 12
    while size < n:
        size *= 2
    p, q = _powers(which, size)
    return p[:n], q[:n]


def _sums(x: np.ndarray, which: int) -> np.ndarray:
    s = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x * powers(which, len(x))[0], out=s[1:])
    return s


def windows(x: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` consecutive values (uint64); empty if there are fewer."""
    if len(x) < k:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(len(x) - k + 1, dtype=np.uint64)
    for at in range(0, len(out), CHUNK):
        part = x[at:at + CHUNK + k - 1]
        s = _sums(part, which)
        out[at:at + CHUNK] = mix((s[k:] - s[:-k]) * powers(which, len(part) - k + 1)[1])
    return out


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SEPARATOR[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(text: bytes, both: bool = False, bounds=None) -> tuple[np.ndarray, ...]:
    """Hashes of the words of a text (one array for each base that is wanted)."""
    data = np.frombuffer(text, dtype=np.uint8)
    starts, ends = word_bounds(data) if bounds is None else bounds
    out = [np.empty(len(starts), dtype=np.uint64) for _ in range(2 if both else 1)]
    first = 0
    while first < len(starts):  # whole words of about a chunk of bytes at a time
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + CHUNK, side="right")))
        at, a, b = starts[first], starts[first:last], ends[first:last]
        values = data[at:b[-1]].astype(np.uint64) + np.uint64(1)
        for which, hashes in enumerate(out):
            s = _sums(values, which)
            hashes[first:last] = mix((s[b - at] - s[a - at]) * powers(which, len(values))[1][a - at]
                                     + (b - a).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        first = last
    return tuple(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchors(x: np.ndarray, k: int, s: int) -> np.ndarray:
    """Start of every run of ``k`` values whose least hashed run of ``s`` values stands
    first or last in it (a closed syncmer).  Whether a run is chosen depends on its content
    alone, and each run of ``2k - s - 1`` values or more holds a chosen one."""
    small = windows(x, s)
    if len(x) < k:
        return np.zeros(0, dtype=np.int64)
    low = sliding_min(small, k - s + 1)
    return np.flatnonzero((small[:len(low)] == low) | (small[k - s:] == low))


def lower(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
