"""Ranked lexical search of a query set over all documents, by document FP-trees.

Terms are runs of letters, digits and characters above 0x7F, A-Z lower-cased.  Scores are
integers: a term's weight ``floor(1000 * ln((2N + 2) / (2df + 1)))`` times a share of a
million that grows with its tf and falls with the document's length.

1. One map over the whole texts leaves each document's length and its restricted vector:
   the query terms in it and how often.  Their df comes from one aggregation.
2. Each task builds FP-trees over batches of ``tree_docs`` vectors and searches them for
   every item, depth first with bounds; what an item has found so far prunes later trees.
   A task gives ``top`` documents an item at most (the report's length), and one window
   an item merges them.

Items come in blocks of ``block_words`` words, so what tasks are given has a bound whatever
the query set's size; each block is one pass.

Texts are taken whole, at any length; batches are bounded by bytes and by vector entries.
A null text has no terms and is no document of N; an item without terms finds nothing.
Repeated items are answered each, repeated documents are ranked each.  Equal scores go by
doc_id, a null doc_id last.  Other columns, whatever their names, are ignored.  An empty
table on either side gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

from .arrow import arrow_schema, record_batch, small_batches
from .common import spread
from .fp_tree import Tree
from .word_lists import LOWER, UPPER, folded, numbered

ROWS = 1024
NO_ID = (1 << 63) - 1  # stands for a null doc_id

# Characters below 0x80 that no term holds.
_GAPS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes.maketrans(UPPER + _GAPS, LOWER + b" " * len(_GAPS))


def terms_of(texts: pa.StringArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    return numbered(folded(texts, _FOLD))


def _blocks(items: DataFrame, block_words: int):
    """(item_id, text) of the query set, a bounded number of words at a time."""
    block, size = [], 0
    for r in items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"] or "") // 4 + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


class Items:
    """Items of a block and the numbers of their distinct terms."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        numbers, distinct, owner = terms_of(pa.array([r[1] for r in rows], pa.string()))
        self.names = distinct.to_pylist()
        self.terms = [np.unique(numbers[owner == i]) for i in range(len(rows))]


def vectors(docs: DataFrame, names: list[str]) -> DataFrame:
    """doc_id, n (terms of the whole text), terms (numbers into ``names``) and tf."""
    known = {w: i for i, w in enumerate(names) if w}
    schema = "doc_id long, n long, terms array<int>, tf array<int>"
    kind = arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                numbers, distinct, owner = terms_of(batch.column("text"))
                local = np.fromiter((known.get(w, -1) for w in distinct.to_pylist()), np.int64, len(distinct))
                n = np.bincount(owner, minlength=batch.num_rows)
                term = local[numbers]
                key, tf = np.unique((owner << 32 | term)[term >= 0], return_counts=True)
                cuts = pa.array(np.searchsorted(key >> 32, np.arange(batch.num_rows + 1)), pa.int32())
                yield record_batch(kind, {
                    "doc_id": batch.column("doc_id"), "n": n,
                    "terms": pa.ListArray.from_arrays(cuts, pa.array((key & 0xFFFFFFFF).astype(np.int32))),
                    "tf": pa.ListArray.from_arrays(cuts, pa.array(tf.astype(np.int32)))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return small_batches(rows, ROWS).mapInArrow(run, schema)


def _search(found: DataFrame, items: Items, w: np.ndarray, rank: np.ndarray, top: int, tree_docs: int,
            tree_terms: int) -> DataFrame:
    """item, doc_id, score: the best of every task.  ``rank``: place of each term by falling df."""
    schema = "item int, doc_id long, score long"
    kind, wanted = arrow_schema(schema), [np.sort(rank[t]) for t in items.terms]

    def run(batches):
        heaps = [[] for _ in wanted]
        mask = np.zeros(len(w), dtype=bool)

        def search(parts):
            tree = Tree(*(np.concatenate(x) for x in zip(*parts)), w)
            for terms, heap in zip(wanted, heaps):
                mask[terms] = True
                tree.search(terms, mask, heap, top)
                mask[terms] = False

        parts, docs, entries = [], 0, 0
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            terms, tf = batch.column("terms"), batch.column("tf")
            sizes = np.diff(terms.offsets.to_numpy())
            number, times = rank[terms.flatten().to_numpy()], tf.flatten().to_numpy()
            doc = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((number, doc))
            parts.append((ids, batch.column("m").to_numpy(), sizes, number[order], times[order]))
            docs, entries = docs + len(ids), entries + len(number)
            if docs >= tree_docs or entries >= tree_terms:
                search(parts)
                parts, docs, entries = [], 0, 0
        if parts:
            search(parts)
        best = [(i, -d, s) for i, heap in enumerate(heaps) for s, d in heap]
        if best:
            item, doc, score = (np.array(x, dtype=np.int64) for x in zip(*best))
            yield record_batch(kind, {"item": item.astype(np.int32), "score": score,
                                      "doc_id": pa.array(doc, pa.int64(), mask=doc == NO_ID)})

    return small_batches(found, ROWS).mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, top: int = 50, block_words: int = 200_000, tree_docs: int = 8192,
           tree_terms: int = 1 << 21) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of every item, if as many score above 0."""
    spark, item_kind = docs.sparkSession, dict(items.dtypes)["item_id"]
    docs, out = spread(docs), None
    for rows in _blocks(items, block_words):
        block = Items(rows)
        found = materialize(vectors(docs, block.names), "search-vectors")
        total = found.filter("n > 0").agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        if not total["n"]:
            continue
        df = np.zeros(len(block.names), dtype=np.int64)
        counts = found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()
        df[counts["t"].to_numpy()] = counts["df"].to_numpy()  # as many rows as the block has terms
        order = np.argsort(-df, kind="stable")
        rank = np.empty(len(df), dtype=np.int64)
        rank[order] = np.arange(len(df))
        w = np.array([math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * int(x) + 1))) for x in df[order]], dtype=np.int64)
        m = F.expr(f"CAST(50 + (CAST(50 AS decimal(20, 0)) * n * {total['n']}) div {total['l']} AS long)")
        some = found.filter(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "tf")
        best = materialize(_search(some, block, w, rank, top, tree_docs, tree_terms), "search-best")
        each = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(each)).filter(F.col("rank") <= top)
        named = spark.createDataFrame([(i, x) for i, x in enumerate(block.ids)], f"item int, item_id {item_kind}")
        part = ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id long, score long")
    return out
