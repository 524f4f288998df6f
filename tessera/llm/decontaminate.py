"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The seeds of a benchmark item are its lower-cased runs of ``seed_words`` words.

1. One pass over all texts counts the documents that hold each seed.  Copies of an item
   raise all its seeds alike, so a seed's background is its count less the lower quartile of
   the item's own counts; seeds with a background of ``rare_share`` of the documents at most
   (``rare_least`` documents at least) are rare.  Common runs of function words fall out.
2. A second pass keeps the documents that hold a rare seed, with the places; they are joined
   with the items by seed.  Which runs are seeds comes to both passes as a bit filter of
   ``FILTER_BITS`` at most.
3. Around the places, where enough words of the item stand for the least score, item and
   passage are aligned locally on words (match +2, mismatch and gap -1).  The score is the
   alignment's share of the item's best possible one; substitutions, insertions and
   deletions lower it only a little.

Items of which fewer than ``rare_enough`` of the seeds are rare, and those shorter than
``seed_words`` words, are searched by all their seeds instead: the exact way, a map over
the documents for each block of ``block_words`` words of such items.

Nulls: documents or items without text have no seeds; a null doc_id or item_id passes
through.  Texts are taken whole, at any length.  Items shorter than ``seed_words`` words are
searched by all their words.  A document that holds several items has a row for each; of
passages that tie the first counts.  A document given twice gives its rows twice, an item
given twice is one.  Other columns, whatever their names, are ignored; an empty table on
either side gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

from . import shingle
from .arrow import arrow_schema, map_rows, record_batch, small_batches
from .common import spread

MATCH, MISMATCH, GAP = 2, -1, -1
FILTER_BITS = 1 << 28


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and where in the passage it ends."""
    best, end = 0, 0
    row = np.zeros(len(passage) + 1, dtype=np.int64)
    slope = np.arange(len(passage) + 1, dtype=np.int64) * GAP
    for word in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), row[1:] + GAP)
        # a gap in the item: the best cell to the left, less its distance
        row = np.maximum(np.maximum.accumulate(np.maximum(new, 0) - slope) + slope, 0)
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def may_reach(item: np.ndarray, known: np.ndarray, passage: np.ndarray, least: float) -> bool:
    """Whether enough words of the item (``known``: its distinct ones) stand close enough for
    the least score: at a match for +2 it takes ``least`` of the item's length, and the
    errors that the score allows bound how far apart they stand."""
    length = len(item)
    same = known[np.minimum(np.searchsorted(known, passage), len(known) - 1)] == passage
    if same.sum() < least * length:
        return False
    total = np.concatenate([[0], np.cumsum(same)])
    span = min(len(passage), int(np.ceil((3 - 2 * least) * length)))
    if (total[span:] - total[:len(total) - span]).max() < least * length:
        return False
    return bool(np.isin(item, passage[same]).sum() >= least * length)


def best_match(item: np.ndarray, known: np.ndarray, words: np.ndarray, places: np.ndarray, least: float) -> tuple | None:
    """(score, first word, end word) of the item's best alignment around the places of its
    seeds, if that reaches ``least``."""
    length, best = len(item), (0, 0, 0)
    # runs of hits no further apart than the item is long share one passage
    for run in np.split(places, np.flatnonzero(np.diff(places) > length) + 1):
        a, b = max(0, run[0] - length), min(len(words), run[-1] + 2 * length)
        for c in range(a, b, 8 * length):  # long runs in overlapping parts
            passage = words[c:min(b, c + 10 * length)]
            if may_reach(item, known, passage, least):
                score, end = align(item, passage)
                best = max(best, (score, -(c + end), -a))
    score = best[0] / (MATCH * length)
    return (round(score, 6), max(0, -int(best[1]) - length), -int(best[1])) if score >= least else None


class Items:
    """Benchmark items of one block and their seeds."""

    def __init__(self, rows: list[tuple], seed_words: int):
        self.ids = [r[0] for r in rows]
        self.words = [shingle.word_hashes(shingle.lower(r[1] or ""))[0] for r in rows]
        self.sizes = sorted({min(seed_words, len(w)) for w in self.words if len(w)})
        seeds = [shingle.windows(w, min(seed_words, len(w))) for w in self.words if len(w)]
        owners = [np.full(len(s), i) for s, i in zip(seeds, (i for i, w in enumerate(self.words) if len(w)))]
        self.seeds = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        self.owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(self.seeds, kind="stable")
        self.seeds, self.owners = self.seeds[order], self.owners[order]
        self.vocabulary = [np.unique(w) for w in self.words]
        self.seen = np.zeros(1 << 16, dtype=bool)  # by the upper bits: most windows stop here
        self.seen[(self.seeds >> np.uint64(48)).astype(np.int64)] = True

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the text and item of every seed that stands there."""
        at, what = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size in self.sizes:
            h = shingle.windows(words, size)
            some = np.flatnonzero(self.seen[(h >> np.uint64(48)).astype(np.int64)])
            a, b = (np.searchsorted(self.seeds, h[some], side=s) for s in ("left", "right"))
            n = b - a  # owners of each
            at.append(np.repeat(some, n))
            what.append(np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n))
        return np.concatenate(at), self.owners[np.concatenate(what)]

    def matches(self, text: str, least: float) -> list[tuple]:
        """(item id, score, first word, end word) of the items found in a text."""
        words = shingle.word_hashes(shingle.lower(text))[0]
        at, what = self.hits(words)
        order = np.lexsort((at, what))
        at, what = at[order], what[order]
        out = []
        for places in np.split(np.arange(len(what)), np.flatnonzero(np.diff(what)) + 1) if len(what) else []:
            i = int(what[places[0]])
            if found := best_match(self.words[i], self.vocabulary[i], words, at[places], least):
                out.append((self.ids[i], *found))
        return out


def _blocks(benchmark: DataFrame, block_words: int):
    """Items in the driver, a bounded number of words at a time."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len((r["text"] or "").split()) + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def _exact(docs: DataFrame, items: DataFrame, least: float, seed_words: int, block_words: int, schema: str) -> DataFrame | None:
    """Items searched by all their seeds: one map a block."""
    found = None
    for rows in _blocks(items, block_words):
        block = Items(rows, seed_words)

        def match(ids, texts, items=block):
            out = [(d, *m) for d, t in zip(ids, texts) if t for m in items.matches(t, least)]
            names = ("doc_id", "item_id", "score", "first_word", "end_word")
            return {n: [r[i] for r in out] for i, n in enumerate(names)}

        part = map_rows(docs, match, ["doc_id", "text"], schema)
        found = part if found is None else found.unionByName(part)
    return found


def _seeds(items: DataFrame, seed_words: int) -> DataFrame:
    """item_no, h: every distinct seed of the items of ``seed_words`` words or more."""
    def run(numbers, texts):
        out = [np.unique(shingle.windows(shingle.word_hashes(shingle.lower(t or ""))[0], seed_words)) for t in texts]
        return {"item_no": np.repeat(np.array(numbers, dtype=np.int64), [len(x) for x in out]),
                "h": shingle.signed(np.concatenate([np.zeros(0, np.uint64), *out]))}

    return map_rows(items, run, ["item_no", "text"], "item_no long, h long")


class _Filter:
    """Bits of seeds, by the upper bits of their hashes; none of them is missed."""

    def __init__(self, seeds: DataFrame):
        self.shift = np.uint64(64 - min(FILTER_BITS.bit_length() - 1, max(16, (64 * seeds.count()).bit_length())))
        slot = f"shiftrightunsigned(h, {int(self.shift)})"
        found = seeds.groupBy(F.expr(f"shiftright({slot}, 6)").alias("at")).agg(
            F.bit_or(F.expr(f"shiftleft(1L, CAST({slot} % 64 AS INT))")).alias("bits")).toArrow()
        self.data = np.zeros(1 << (64 - int(self.shift) - 6), dtype=np.int64)
        self.data[found["at"].to_numpy()] = found["bits"].to_numpy()

    def places(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> self.shift).astype(np.int64)
        return np.flatnonzero(self.data[slot >> 6] >> (slot & 63) & 1)


def _seed_counts(docs: DataFrame, seeds: DataFrame, seed_words: int) -> DataFrame:
    """h, df: documents that hold each seed."""
    known = _Filter(seeds.select("h").distinct())

    def run(texts):
        found = []
        for t in texts:
            h = shingle.windows(shingle.word_hashes(shingle.lower(t or ""))[0], seed_words)
            found.append(np.unique(h[known.places(h)]))
        h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
        return {"h": shingle.signed(h), "df": n}

    return map_rows(docs, run, ["text"], "h long, df long").groupBy("h").agg(F.sum("df").alias("df"))


def _holders(docs: DataFrame, rare: DataFrame, seed_words: int) -> DataFrame:
    """doc_id, text, and ``hits`` (h, places) of the documents that may hold a rare seed."""
    known = _Filter(rare.select("h").distinct())
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, text string, hits array<struct<h: long, places: array<int>>>"
    kind = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            keep, hits = [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                h = shingle.windows(shingle.word_hashes(shingle.lower(t or ""))[0], seed_words)
                at = known.places(h)
                if len(at):
                    order = np.argsort(h[at], kind="stable")
                    at, own = at[order], h[at[order]]
                    cuts = np.flatnonzero(np.diff(own)) + 1
                    keep.append(i)
                    hits.append([{"h": int(shingle.signed(own[c[:1]])[0]), "places": at[c].tolist()}
                                 for c in np.split(np.arange(len(at)), cuts)])
            some = pa.array(keep, pa.int64())
            yield record_batch(kind, {"doc_id": batch.column("doc_id").take(some), "text": batch.column("text").take(some), "hits": hits})

    return small_batches(docs).mapInArrow(run, schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, seed_words: int = 3,
               block_words: int = 200_000, rare_share: float = 0.0005, rare_least: int = 5,
               rare_enough: float = 0.6) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word: every document and item that align."""
    docs = spread(docs.select("doc_id", "text"))
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kind}, item_id {item_kind}, score double, first_word long, end_word long"
    items = materialize(benchmark.select("item_id", "text").distinct().withColumn("item_no", F.monotonically_increasing_id()),
                        "leak-items")
    seeds = materialize(_seeds(items, seed_words), "leak-seeds")
    counts = _seed_counts(docs, seeds, seed_words)
    own = materialize(seeds.join(counts, "h", "left").select("item_no", "h", F.coalesce("df", F.lit(0)).alias("df")), "leak-counts")
    usual = own.groupBy("item_no").agg(F.expr("approx_percentile(df, 0.25, 1000)").alias("copies"))
    most = max(rare_least, int(rare_share * docs.count()))
    rated = materialize(own.join(usual, "item_no").withColumn("rare", F.col("df") - F.col("copies") <= most), "leak-rated")
    easy = (rated.groupBy("item_no").agg(F.avg(F.col("rare").cast("int")).alias("share"))
            .filter(F.col("share") >= rare_enough).select("item_no"))
    rare = materialize(rated.filter("rare").join(easy, "item_no", "left_semi").select("item_no", "h"), "leak-rare")
    hard = items.join(easy, "item_no", "left_anti").filter("text IS NOT NULL")

    held = materialize(_holders(docs, rare, seed_words).withColumn("row", F.monotonically_increasing_id()), "leak-holders")
    hits = held.select("row", F.explode("hits").alias("x")).select("row", "x.h", "x.places")
    pairs = materialize(hits.join(rare, "h").groupBy("row", "item_no").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places")), "leak-pairs")
    texts = held.select("row", "doc_id", "text")
    both = (pairs.join(items.select("item_no", "item_id", F.col("text").alias("item")), "item_no").join(texts, "row"))

    def match(ids, texts, item_ids, item_texts, places):
        out, last, words = [], None, None
        for d, text, i, item, at in zip(ids, texts, item_ids, item_texts, places):
            if text is not last:
                last, words = text, shingle.word_hashes(shingle.lower(text))[0]
            own = shingle.word_hashes(shingle.lower(item))[0]
            if found := best_match(own, np.unique(own), words, np.array(at), least):
                out.append((d, i, *found))
        names = ("doc_id", "item_id", "score", "first_word", "end_word")
        return {n: [r[k] for r in out] for k, n in enumerate(names)}

    found = map_rows(both, match, ["doc_id", "text", "item_id", "item", "places"], schema, rows=64)
    more = _exact(docs, hard, least, seed_words, block_words, schema)
    return materialize(found if more is None else found.unionByName(more), "leaks")
