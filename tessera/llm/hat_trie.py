"""Phrase counts in a HAT-trie: word ids lead through a few levels of nodes to hash
containers of phrase rests; a container that grows too large bursts into a node.

Ids are positive and below 2^32; the rest of a phrase is packed into one integer, 32 bits a
word, so rests of different lengths never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORD = 32


def pack(ids: list[np.ndarray]) -> list[int]:
    """Packed ids of each place."""
    out = ids[0].tolist()
    for col in ids[1:]:
        out = [x << WORD | y for x, y in zip(out, col.tolist())]
    return out


class Node:
    __slots__ = ("ends", "children")

    def __init__(self):
        self.ends, self.children = 0, {}  # the phrase that ends here; by the next word


class HatTrie:
    """Counts of phrases of two or more words; with ``levels`` 1 no container bursts."""

    def __init__(self, burst: int = 4096, levels: int = 3):
        self.burst, self.levels = burst, levels
        self.root: dict[int, Node | dict[int, int]] = {}
        self.sizes: dict[int, int] = {}  # phrases below each first word

    @property
    def size(self) -> int:
        return sum(self.sizes.values())

    def add(self, first: int, rests: list[int], counts: list[int]) -> int:
        """Counts phrases that begin with ``first``; how many of them are new."""
        new = self._put(self.root, first, rests, counts, 1)
        self.sizes[first] = self.sizes.get(first, 0) + new
        return new

    def _put(self, children: dict, word: int, rests: list[int], counts: list[int], level: int) -> int:
        below = children.get(word)
        if below is None:
            below = children[word] = {}
        if type(below) is Node:
            return self._put_below(below, rests, counts, level)
        old, get = len(below), below.get
        for rest, n in zip(rests, counts):
            below[rest] = get(rest, 0) + n
        new = len(below) - old
        if len(below) > self.burst and level < self.levels:
            node = children[word] = Node()
            self._put_below(node, list(below), list(below.values()), level)
        return new

    def _put_below(self, node: Node, rests: list[int], counts: list[int], level: int) -> int:
        new = 0
        for rest, n in zip(rests, counts):
            if not rest:
                new += node.ends == 0
                node.ends += n
                continue
            shift = (rest.bit_length() - 1) // WORD * WORD
            new += self._put(node.children, rest >> shift, [rest & (1 << shift) - 1], [n], level + 1)
        return new

    def _phrases(self, path: int, below, paths: list[int], rests: list[int], counts: list[int]) -> None:
        if type(below) is dict:
            paths += [path] * len(below)
            rests += below
            counts += below.values()
            return
        if below.ends:
            paths.append(path)
            rests.append(0)
            counts.append(below.ends)
        for word, child in below.children.items():
            self._phrases(path << WORD | word, child, paths, rests, counts)

    def take(self, leave: int = 0) -> tuple[list[int], list[int], list[int]]:
        """Removes whole subtrees of first words, the largest first, until ``leave`` phrases
        are left at most; their packed paths, packed rests and counts."""
        have, out = self.size, ([], [], [])
        for first in sorted(self.sizes, key=lambda w: (-self.sizes[w], w)):
            if have <= leave:
                break
            have -= self.sizes.pop(first)
            self._phrases(first, self.root.pop(first), *out)
        return out


def columns(paths: list[int], rests: list[int]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Phrases by their number of words: which they are, and the ids of each place."""
    if max(paths) >> WORD == max(rests) >> WORD == 0 and min(rests):
        yield np.arange(len(rests)), [np.array(paths, dtype=np.int64), np.array(rests, dtype=np.int64)]  # pairs
        return
    whole = [p << (r.bit_length() + WORD - 1) // WORD * WORD | r for p, r in zip(paths, rests)]
    length = np.fromiter(((x.bit_length() + WORD - 1) // WORD for x in whole), np.int64, len(whole))
    for k in np.unique(length).tolist():
        at = np.flatnonzero(length == k)
        raw = b"".join([whole[i].to_bytes(WORD // 8 * k) for i in at.tolist()])
        ids = np.frombuffer(raw, dtype=">u4").reshape(-1, k).astype(np.int64)
        yield at, [ids[:, i] for i in range(k)]


def phrase_numbers(ids: np.ndarray, ok: np.ndarray, longest: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The ids of each place, and the count, of every distinct phrase of 2 words, of 3 and so on
    to ``longest``, in the order of the first ids; ``ok[i]``: places i and i+1 may stand in
    one phrase."""
    number, place = ids.astype(np.int64), np.flatnonzero(ok)
    for length in range(2, longest + 1):
        if not len(place):
            return
        # a phrase is the number of its first part and its last word: exact, not a hash
        key = number[place] << np.int64(WORD) | ids[place + length - 1]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        at = place[order[first]]
        yield [ids[at + k] for k in range(length)], np.diff(np.append(first, len(key)))
        if length == longest:
            return
        number = np.zeros(len(ids), dtype=np.int64)
        which = np.empty(len(key), dtype=np.int64)
        which[order] = np.repeat(np.arange(1, len(first) + 1), np.diff(np.append(first, len(key))))
        number[place] = which
        place = place[place + length < len(ids)]
        place = place[ok[place + length - 1]]
