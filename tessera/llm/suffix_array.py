"""Two-stage suffix sorting and adjacent common prefixes, vectorised in numpy.

Suffixes are of two kinds: smaller than their successor (the suffix one place on), or
larger.  Only the smaller ones are sorted directly.  The larger ones are induced: buckets of first characters are scanned in
order, and each suffix found puts its predecessor, if that is of the larger kind, next in
the bucket of the predecessor's first character.
"""

from __future__ import annotations

import numpy as np


def eight_bytes(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number (zeros beyond the end)."""
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    out = np.zeros(len(text), dtype=np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i:i + len(text)].astype(np.uint64)
    return out


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than the one that begins a place later."""
    n = len(text)
    after = np.concatenate([text[1:], np.zeros(1, dtype=text.dtype)]).astype(np.int16)
    less, more = text < after, text > after
    # in a run of equal characters all suffixes are of the kind of the run's last one
    place = np.where(less | more, np.arange(n), n - 1)
    decides = np.minimum.accumulate(place[::-1])[::-1]
    return less[decides]


def _sort_directly(idx: np.ndarray, text: np.ndarray, depth: int) -> np.ndarray:
    """``idx`` by the ``depth`` bytes that begin there (zeros beyond the end); ties stay in order."""
    if not len(idx):
        return idx
    padded = np.concatenate([text, np.zeros(depth, dtype=np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[idx]
    return idx[np.argsort(rows.view(f"S{depth}").ravel(), kind="stable")]


def two_stage_sort(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Places of all suffixes in the order of their first ``depth`` bytes; or of the
    ``wanted`` ones and those that induce them: what follows a larger suffix up to the
    next smaller one."""
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64)
    small = smaller_than_successor(text)
    need = np.ones(n, dtype=bool)
    if wanted is not None:
        place = np.where(small, np.arange(n), n - 1)
        end = np.minimum.accumulate(place[::-1])[::-1] + 1  # of the chain that begins here
        step = np.zeros(n + 1, dtype=np.int64)
        step[:-1] += wanted
        step -= np.bincount(end[wanted], minlength=n + 1)
        need = np.cumsum(step)[:n] > 0
    direct = _sort_directly(np.flatnonzero(small & need), text, depth + 8)
    larger = ~small & need
    heads = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if larger[n - 1]:
        induced[text[n - 1]].append(np.array([n - 1]))  # its successor is the empty suffix, before all
    out = []
    for c in range(256):
        waves, wave = [], np.concatenate(induced[c]) if induced[c] else np.zeros(0, dtype=np.int64)
        while len(wave):  # predecessors in the same bucket come after what induced them
            waves.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(text[before] == c) & larger[before]]
        bucket = np.concatenate([*waves, direct[heads[c]:heads[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[larger[before] & (text[before] > c)]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.diff(first)) + 1
        for part in np.split(before, cuts):
            if len(part):
                induced[text[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, places: np.ndarray, most: int) -> np.ndarray:
    """Length, up to ``most``, of the prefix that each place shares with the next in ``places``."""
    keys = eight_bytes(text)
    out = np.zeros(max(0, len(places) - 1), dtype=np.int64)
    alive = np.arange(len(out))
    for at in range(0, most, 8):
        a, b = places[alive] + at, places[alive + 1] + at
        inside = (a < len(text)) & (b < len(text))
        alive, a, b = alive[inside], a[inside], b[inside]
        x = keys[a] ^ keys[b]
        equal = x == 0
        lead = np.zeros(len(x), dtype=np.int64)
        for bits in (8, 16, 24, 32, 40, 48, 56):
            lead += (x >> np.uint64(64 - bits)) == 0
        out[alive] += np.where(equal, 8, lead)
        alive = alive[equal]
    return np.minimum(np.minimum(out, most), len(text) - np.maximum(places[1:], places[:-1]) if len(out) else out)
