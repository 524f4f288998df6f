"""Removal of long repeated word passages by de Bruijn compaction.

Of every window of ``window`` consecutive words that also starts in a document with a
smaller doc_id, all words go.  Windows are judged on the input.

Token k-mers are the edges of a de Bruijn graph.  Only content-chosen k-mers are kept
(``shingle.anchors``: whether a k-mer is chosen depends on its words alone, and every
window holds one), so the graph has about a twelfth of the tokens' edges.

1. A map over whole texts emits each kept k-mer with its document and place and what
   precedes and follows it.  One aggregation per k-mer gives its smallest and largest
   document and whether it always has the same successor and predecessor.
2. Joining these back to the occurrences of repeated k-mers compacts them: consecutive
   k-mers that only ever follow each other are one path.  All occurrences of one k-mer of
   a path lie in occurrences of the whole path, so a window inside a path starts in just
   the documents of the path, and its fate is known from the path's smallest document.
3. Windows that leave their path but hold repeated k-mers only are verified at their
   source coordinates: their own 128-bit hashes are aggregated to the smallest document
   and joined back.

Texts are shuffled once, and those with windows to verify a second time.  Keys with very
many rows are pre-aggregated; the joins back are plain ones that AQE splits.  Nulls: a null
text has no words; documents with a null doc_id neither lose words nor are a source.  Rows
that repeat a doc_id are one document.  Texts are taken whole, hashes a chunk at a time; of
windows that start in several documents the smallest doc_id keeps its own.  Other columns,
whatever their names, are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

from . import shingle
from .arrow import map_rows
from .common import keyed, same_document, spread

SMALL = 5


def kmer_size(window: int) -> int:
    return (window + SMALL + 1) // 2


def kept_kmers(text: str, window: int) -> tuple[np.ndarray, ...]:
    """Places and both hashes of the kept k-mers; none if no window fits."""
    a, b = shingle.word_hashes(text.encode(), both=True)
    if len(a) < window:
        at = np.zeros(0, dtype=np.int64)
        return at, at, at
    k = kmer_size(window)
    at = shingle.anchors(a, k, SMALL)
    return at, shingle.signed(shingle.windows(a, k, 0)[at]), shingle.signed(shingle.windows(b, k, 1)[at])


def _context(h: np.ndarray, gap: np.ndarray) -> np.ndarray:
    return shingle.signed(shingle.mix(h.view(np.uint64) ^ shingle.mix(gap.astype(np.uint64))))


def kmers(docs: DataFrame, window: int) -> DataFrame:
    """h1, h2, doc, text_key, i (number in the document), at (word), before, after."""
    def run(ids, keys, texts):
        out = {n: [] for n in ("h1", "h2", "doc", "text_key", "i", "at", "before", "after")}
        for doc, key, text in zip(ids, keys, texts):
            at, h1, h2 = kept_kmers(text, window)
            if not len(at):
                continue
            gap, none = np.diff(at), np.zeros(1, dtype=np.int64)
            cols = (h1, h2, np.full(len(at), doc), np.full(len(at), key), np.arange(len(at)), at,
                    np.concatenate([none, _context(h1[:-1], gap)]), np.concatenate([_context(h1[1:], gap), none]))
            for name, col in zip(out, cols):
                out[name].append(col)
        return {n: np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for n, v in out.items()}

    return map_rows(docs, run, ["doc_id", "text_key", "text"],
                    "h1 long, h2 long, doc long, text_key long, i int, at int, before long, after long")


def paths(docs: DataFrame, window: int) -> DataFrame:
    """doc, text_key and ``paths``: array of (first word, end word, smallest document)."""
    found = kmers(docs, window)
    edges = (found.groupBy("h1", "h2")
             .agg(F.min("doc").alias("least"), F.max("doc").alias("most"),
                  (F.min("before") == F.max("before")).alias("one_before"),
                  (F.min("after") == F.max("after")).alias("one_after"))
             .filter("least < most").drop("most"))
    edges = materialize(edges, "substring-edges")  # both sides of the join are then exchanges that AQE can split
    repeated = materialize(found.select("h1", "h2", "doc", "text_key", "i", "at").join(edges, ["h1", "h2"])
                           .drop("h1", "h2"), "substring-occurrences")
    along = Window.partitionBy("doc", "text_key").orderBy("i")  # the k-mers of one document
    joined = F.coalesce((F.lag("i").over(along) == F.col("i") - 1) & F.lag("one_after").over(along)
                        & F.col("one_before"), F.lit(False))
    runs = (repeated.distinct().withColumn("new", (~joined).cast("int"))
            .withColumn("path", F.sum("new").over(along)))
    return (runs.groupBy("doc", "text_key", "path")
            .agg(F.min("at").alias("first"), (F.max("at") + kmer_size(window)).alias("end"), F.min("least").alias("least"))
            .groupBy("doc", "text_key").agg(F.sort_array(F.collect_list(F.struct("first", "end", "least"))).alias("paths")))


def _digest(text: str, gone: np.ndarray | None) -> tuple[int, int, str]:
    words = text.encode().split()
    kept = words if gone is None else [w for w, g in zip(words, gone) if not g]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def cover(n: int, intervals) -> np.ndarray:
    """True at the places of ``n`` that one of the (first, end) intervals covers."""
    step = np.zeros(n + 1, dtype=np.int64)
    for a, b in intervals:
        step[a] += 1
        step[b] -= 1
    return np.cumsum(step[:n]) > 0


def open_windows(text: str, spans: list[tuple[int, int]], window: int) -> tuple[np.ndarray, ...]:
    """Places and hashes of the windows that hold repeated k-mers only and lie in no path."""
    a, b = shingle.word_hashes(text.encode(), both=True)
    k, n = kmer_size(window), len(a) - window + 1
    at = shingle.anchors(a, k, SMALL)
    inside = np.zeros(len(at), dtype=bool)
    for first, end in spans:
        inside[np.searchsorted(at, first):np.searchsorted(at, end - k, side="right")] = True
    closed = [(max(0, x + k - window), min(n, x + 1)) for x in at[~inside]]
    closed += [(first, end - window + 1) for first, end in spans if end - first >= window]
    p = np.flatnonzero(~cover(n, ((x, y) for x, y in closed if x < y)))
    return p, *(shingle.signed(shingle.windows(h, window, i)[p]) for i, h in enumerate((a, b)))


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: a row for each row of ``docs``."""
    whole = keyed(spread(docs))
    known = whole.filter("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long"))
    found = paths(known, window).withColumnRenamed("doc", "doc_id")
    with_paths = whole.join(found, same_document(whole, found), "left").select(whole["*"], "paths")

    def first_pass(ids, texts, lists):
        out = []
        for doc, text, spans in zip(ids, texts, lists):
            if not spans:
                out.append((*_digest(text, None), [], None, []))
                continue
            gone = [(s["first"], s["end"]) for s in spans if s["least"] < doc and s["end"] - s["first"] >= window]
            at, h1, h2 = open_windows(text, [(s["first"], s["end"]) for s in spans], window)
            if len(at):
                n = len(text.encode().split())
                out.append((n, None, None, gone, text, [{"at": x, "h1": y, "h2": z} for x, y, z in
                                                        zip(at.tolist(), h1.tolist(), h2.tolist())]))
            else:
                n = len(text.encode().split())
                out.append((*_digest(text, cover(n, gone)), gone, None, []))
        names = ("n_words", "n_removed", "kept_sha256", "gone", "pending", "open")
        cols = {n: [r[i] for r in out] for i, n in enumerate(names)}
        cols["gone"] = [[{"first": a, "end": b} for a, b in g] for g in cols["gone"]]
        return cols

    kind = dict(whole.dtypes)["doc_id"]
    state = materialize(map_rows(
        with_paths.select("doc_id", "text_key", "text", "paths"), first_pass, ["doc_id", "text", "paths"],
        f"doc_id {kind}, text_key long, n_words long, n_removed long, kept_sha256 string, "
        "gone array<struct<first: long, end: long>>, pending string, "
        "open array<struct<at: int, h1: long, h2: long>>"), "substring-state")

    opened = state.select("doc_id", "text_key", F.explode("open").alias("w")).select("doc_id", "text_key", "w.*")
    least = (opened.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
             .filter("least < most").drop("most"))
    least = materialize(least, "substring-least")
    hits = materialize(opened.join(least, ["h1", "h2"]).filter("least < doc_id").select("doc_id", "text_key", "at"),
                       "substring-hits")
    hits = hits.groupBy("doc_id", "text_key").agg(F.collect_list("at").alias("hits"))
    wait = state.filter("pending IS NOT NULL").select("doc_id", "text_key", "n_words", "gone", "pending")
    wait = wait.join(hits, same_document(wait, hits), "left").select(wait["*"], "hits")

    def second_pass(texts, sure, lists):
        out = [_digest(t, cover(len(t.encode().split()), [(g["first"], g["end"]) for g in s]
                                + [(x, x + window) for x in h or []])) for t, s, h in zip(texts, sure, lists)]
        return {n: [r[i] for r in out] for i, n in enumerate(("n_words", "n_removed", "kept_sha256"))}

    late = map_rows(wait, second_pass, ["pending", "gone", "hits"],
                    f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
    done = state.filter("pending IS NULL").select("doc_id", "n_words", "n_removed", "kept_sha256")
    return done.unionByName(late)
