"""A document FP-tree over restricted term vectors, searched depth first with bounds.

A vector holds the query terms of a document in order of falling corpus frequency, so
documents with the same frequent terms share a path.  A node knows, for each term below
it, the largest weight that term can have there (from the subtree's largest tf and its
smallest m); the sum over an item's terms bounds the score of every document below.
"""

from __future__ import annotations

import heapq

import numpy as np

#: documents that a leaf holds; chains and small brothers are one node
LEAF = 32


def weight(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Share of a term's weight that a document earns, in millionths."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Tree:
    """Documents in the order of their paths, and nodes over ranges of them."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray, w: np.ndarray):
        """``terms``: numbers by falling frequency, rising inside each document of ``sizes``
        terms; ``w``: weight of each number."""
        begins = np.concatenate([[0], np.cumsum(sizes)])
        raw = terms.astype(">u4").tobytes()
        paths = [raw[4 * a:4 * b] for a, b in zip(begins[:-1].tolist(), begins[1:].tolist())]
        order = sorted(range(len(paths)), key=paths.__getitem__)
        self.paths = [paths[i] for i in order]
        order = np.array(order, dtype=np.int64)
        sizes = sizes[order]
        place = np.repeat(begins[:-1][order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        self.ids, self.m = ids[order], m[order]
        self.terms, tf = terms[place], tf[place].astype(np.int64)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.begins = np.concatenate([[0], np.cumsum(sizes)])
        self.gain = w[self.terms] * weight(tf, self.m[self.doc])
        self._grow()
        self._bounds(tf, w)

    def _grow(self) -> None:
        """Nodes: range of documents, parent; children come after their parents."""
        self.start, self.end, self.children, parent = [], [], [], []
        todo = [(0, len(self.paths), 0, -1)]
        while todo:
            a, b, depth, above = todo.pop()
            me = len(self.start)
            self.start.append(a)
            self.end.append(b)
            self.children.append([])
            parent.append(above)
            if above >= 0:
                self.children[above].append(me)
            if b - a <= LEAF or self.paths[a] == self.paths[b - 1]:
                continue
            first, last = self.paths[a], self.paths[b - 1]
            while first[4 * depth:4 * depth + 4] == last[4 * depth:4 * depth + 4]:
                depth += 1  # all documents go on alike
            step = [p[4 * depth:4 * depth + 4] for p in self.paths[a:b]]
            bounds = [a, *(a + i for i in range(1, b - a) if step[i] != step[i - 1]), b]
            cuts = [a]  # a large child is a node; small ones share one
            for c, d in zip(bounds[1:], bounds[2:]):
                if d - c >= LEAF or c - cuts[-1] >= LEAF:
                    cuts.append(c)
            if len(cuts) > 1:
                todo += [(c, d, depth, me) for c, d in zip(cuts, [*cuts[1:], b])]
        self.parent = np.array(parent, dtype=np.int64)

    def _bounds(self, tf: np.ndarray, w: np.ndarray) -> None:
        """For each node and term below it: the most that the term can add there."""
        n = len(self.start)
        start, end = np.array(self.start), np.array(self.end)
        least_m = np.array([self.m[a:b].min() for a, b in zip(self.start, self.end)]) if len(self.m) else np.zeros(n, np.int64)
        leaves = np.flatnonzero([not c for c in self.children])
        leaf_of = np.zeros(len(self.paths), dtype=np.int64)
        for k in leaves.tolist():
            leaf_of[start[k]:end[k]] = k
        node, term, most = leaf_of[self.doc], self.terms.astype(np.int64), tf
        parts = []
        while len(node):
            key = term * n + node
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            most = np.maximum.reduceat(most[order], first)
            node, term = node[order][first], term[order][first]
            parts.append((term, node, most))
            up = self.parent[node]
            node, term, most = up[up >= 0], term[up >= 0], most[up >= 0]
        term, node, most = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
        # a node may have come up at several heights: the largest of them counts
        order = np.lexsort((-most, node, term))
        term, node, most = term[order], node[order], most[order]
        new = np.ones(len(term), dtype=bool)
        new[1:] = (term[1:] != term[:-1]) | (node[1:] != node[:-1])
        term, self.bound_node, most = term[new], node[new], most[new]
        self.bound_gain = w[term] * weight(most, least_m[self.bound_node])
        self.bound_begins = np.searchsorted(term, np.arange(len(w) + 1))

    def search(self, wanted: np.ndarray, mask: np.ndarray, heap: list, top: int) -> None:
        """Puts the best documents for the term numbers ``wanted`` (``mask``: the same as
        truth values) into ``heap``, of (score, -doc_id), which holds ``top`` at most."""
        if not len(self.paths) or not len(wanted):
            return
        a, b = self.bound_begins[wanted], self.bound_begins[wanted + 1]
        at = np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange(int((b - a).sum()))
        # sums of integers below 2^53: exact in doubles
        bound = np.bincount(self.bound_node[at], weights=self.bound_gain[at], minlength=len(self.start))
        todo = [0]
        while todo:
            k = todo.pop()
            if bound[k] <= 0 or len(heap) == top and bound[k] < heap[0][0]:
                continue
            if below := self.children[k]:
                todo += sorted(below, key=bound.__getitem__)  # the most promising child first
                continue
            a, b = self.start[k], self.end[k]
            rows = slice(self.begins[a], self.begins[b])
            score = np.bincount(self.doc[rows] - a, weights=self.gain[rows] * mask[self.terms[rows]], minlength=b - a)
            some = np.flatnonzero((score > 0) if len(heap) < top else (score >= heap[0][0]))
            for s, i in zip(score[some].astype(np.int64).tolist(), self.ids[a:b][some].tolist()):
                if len(heap) < top:
                    heapq.heappush(heap, (s, -i))
                elif (s, -i) > heap[0]:
                    heapq.heapreplace(heap, (s, -i))
