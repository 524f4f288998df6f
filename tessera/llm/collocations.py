"""Phrase collocations by HAT-trie counting.

Texts, with A-Z lower-cased, are cut at ``.,;:!?`` and line ends into pieces, and these at
blanks and tabs into words.  In each language (null: ``und``) phrases of 2 to
``longest`` words that stand ``least`` times or more are scored by the cut that explains
them best, ``floor(1000 * a * n / (l * r))``, in decimals.

1. Word counts, by one aggregation.
2. Pairs of words that are frequent themselves, then 3.: longer phrases whose pairs are all
   frequent (a phrase is never more frequent than its parts).  Which words or pairs are
   frequent comes to the tasks as a bit filter of ``filter_bits`` bits at most, whatever
   the corpus; it lets some infrequent ones through, which are counted and then dropped.
   Each task counts in a HAT-trie for each language, under word ids of its own.  When the
   tries hold ``trie_phrases`` phrases, their largest subtrees are spilled whole as
   sorted runs, cut by prefix partition (the first word, in eight parts by the second); the
   runs of a partition are merged by Spark.
4. Frequent phrases meet their parts through joins by language and phrase.

A phrase is dropped if a longer frequent phrase that contains it has ``within`` % of its
count or more.  The result is each language's best ``top`` (a report), with rank.

Texts are taken whole, at any length; a batch of texts is bounded by bytes.  A null text is
empty.  Each repeated row counts again.  Ties: score, a, then phrase in UTF-8 order; of
cuts with one score the first.  Other columns, whatever their names, are ignored.  An
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

from . import shingle
from .arrow import arrow_schema, record_batch, small_batches
from .common import spread
from .hat_trie import HatTrie, columns, pack, phrase_numbers
from .word_lists import LOWER, UPPER, folded, numbered

ROWS = 1024  # texts of a batch

# The characters that end a piece; blank and tab separate words.
CUTS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(UPPER + b"\t" + CUTS, LOWER + b" " + b"\n" * len(CUTS))


# -- words --------------------------------------------------------------------

def words_of(texts: pa.StringArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word numbers, the distinct words, and the piece of each word."""
    return numbered(pc.split_pattern(folded(texts, _FOLD), "\n").flatten())


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.StringArray]]:
    langs = batch.column("lang").dictionary_encode()
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, batch.column("text").filter(pc.equal(langs.indices, k))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n."""
    schema = "lang string, word string, n long"
    kind = arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                for lang, texts in by_language(whole.slice(at, ROWS)):
                    numbers, distinct, _ = words_of(texts)
                    n = np.bincount(numbers, minlength=len(distinct))
                    some = np.flatnonzero(n)
                    yield record_batch(kind, {"lang": pa.array([lang] * len(some), pa.string()),
                                              "word": distinct.take(pa.array(some)), "n": n[some]})

    return (small_batches(docs, ROWS).mapInArrow(run, schema)
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


# -- filters ------------------------------------------------------------------

def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))


def _slots(lang: str, first: np.ndarray, second: np.ndarray | int, bits: int) -> np.ndarray:
    """Place in a filter of a word or pair, from the hashes of the words."""
    own = np.uint64(zlib.crc32(lang.encode()) * 2 + 1)
    return (shingle.mix(shingle.mix(first + own) + np.uint64(second) if np.isscalar(second)
                        else shingle.mix(first + own) + second * np.uint64(0x9E3779B97F4A7C15))
            & np.uint64(bits - 1)).astype(np.int64)


class Filter:
    """Bits of the frequent words or pairs: none of those is ever missed."""

    def __init__(self, frequent: DataFrame, filter_bits: int):
        """``frequent``: lang, phrase (one word, or two with a blank between)."""
        self.bits = min(filter_bits, 1 << max(16, (16 * frequent.count()).bit_length()))
        bits, schema = self.bits, "at long, bits long"
        kind = arrow_schema(schema)

        def run(batches):
            for batch in batches:
                for lang in batch.column("lang").unique().to_pylist():
                    own = batch.filter(pc.equal(batch.column("lang"), lang)).column("phrase").to_pylist()
                    pairs = [p.split(" ") for p in own]
                    second = _hashes([p[1] for p in pairs]) if pairs and len(pairs[0]) == 2 else 0
                    slot = _slots(lang, _hashes([p[0] for p in pairs]), second, bits)
                    yield record_batch(kind, {"at": slot >> 6, "bits": np.left_shift(np.int64(1), slot & 63)})

        found = (frequent.select("lang", "phrase").mapInArrow(run, schema)
                 .groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow())
        self.data = np.zeros(bits >> 6, dtype=np.int64)
        self.data[found["at"].to_numpy()] = found["bits"].to_numpy()

    def has(self, lang: str, first: np.ndarray, second=0) -> np.ndarray:
        slot = _slots(lang, first, second, self.bits)
        return (self.data[slot >> 6] >> (slot & 63) & 1).astype(bool)


# -- counting -----------------------------------------------------------------

RUN = "lang string, prefix int, phrases array<string>, counts array<long>"


class PhraseCounter:
    """A task's tries, one for each language, and the words of its ids."""

    def __init__(self, words: Filter, pairs: Filter | None, longest: int, prefixes: int, trie_phrases: int,
                 kind: pa.Schema):
        self.filters, self.longest, self.prefixes, self.most = (words, pairs), longest, prefixes, trie_phrases
        self.kind = kind
        self.ids: dict[str, int] = {}
        self.names = [""]
        self.tries: dict[str, HatTrie] = {}

    def learn(self, lang: str, texts: pa.StringArray) -> int:
        """Phrases that are new in the tries."""
        words, pairs = self.filters
        numbers, distinct, piece = words_of(texts)
        names = distinct.to_pylist()
        hashes = _hashes(names)
        local = np.zeros(len(names), dtype=np.int64)
        some = np.flatnonzero(words.has(lang, hashes))
        for i in some.tolist():
            local[i] = self.ids.setdefault(names[i], len(self.names))
            if local[i] == len(self.names):
                self.names.append(names[i])
        ids = local[numbers]
        ok = (piece[1:] == piece[:-1]) & (ids[1:] > 0) & (ids[:-1] > 0)
        if pairs is not None:
            at = np.flatnonzero(ok)
            ok[at] = pairs.has(lang, hashes[numbers[at]], hashes[numbers[at + 1]])
        trie, new = self.tries.setdefault(lang, HatTrie(levels=min(3, self.longest - 1))), 0
        for places, count in phrase_numbers(ids, ok, self.longest):
            if pairs is not None and len(places) == 2:
                continue
            first, rests, count = places[0], pack(places[1:]), count.tolist()
            cuts = [0, *(np.flatnonzero(np.diff(first)) + 1).tolist(), len(first)]
            for a, b, word in zip(cuts, cuts[1:], first[cuts[:-1]].tolist()):
                new += trie.add(word, rests[a:b], count[a:b])
        return new

    def spill(self, leave: int = 0) -> Iterator[pa.RecordBatch]:
        """Sorted runs, by prefix partition, of the largest subtrees of each language."""
        share, names, hashes = leave // max(1, len(self.tries)), pa.array(self.names, pa.string()), _hashes(self.names)
        for lang, trie in self.tries.items():
            paths, rests, counts = trie.take(share)
            if not counts:
                continue
            prefix, phrases = np.empty(len(counts), dtype=np.int32), []
            at = []
            for some, ids in columns(paths, rests):
                # subtrees of a first word in eight parts, by the second
                own = shingle.mix(hashes[ids[0]] + np.uint64(zlib.crc32(lang.encode()))) + (hashes[ids[1]] & np.uint64(7))
                prefix[some] = (shingle.mix(own) % np.uint64(self.prefixes)).astype(np.int32)
                phrases.append(pc.binary_join_element_wise(*[names.take(pa.array(x)) for x in ids], " "))
                at.append(some)
            at = np.concatenate(at)
            rows = pa.table({"prefix": prefix[at], "phrase": pa.concat_arrays(phrases),
                             "n": np.array(counts, dtype=np.int64)[at]})
            rows = rows.take(pc.sort_indices(rows, [("prefix", "ascending"), ("phrase", "ascending")])).combine_chunks()
            prefix = rows["prefix"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(prefix)) + 1, [len(prefix)]])
            phrases, counts = (pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.concat_arrays(rows[c].chunks))
                               for c in ("phrase", "n"))
            yield record_batch(self.kind, {"lang": [lang] * (len(cuts) - 1), "prefix": prefix[cuts[:-1]],
                                           "phrases": phrases, "counts": counts})
        if not leave:
            self.ids, self.names, self.tries = {}, [""], {}

    def count(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                for lang, texts in by_language(whole.slice(at, ROWS)):
                    have += self.learn(lang, texts)
                    if have > self.most or len(self.names) > self.most:
                        # ids go only with the phrases that use them
                        leave = self.most // 2 if len(self.names) <= self.most else 0
                        yield from self.spill(leave)
                        have = sum(t.size for t in self.tries.values())
        yield from self.spill()


def phrase_counts(docs: DataFrame, words: Filter, pairs: Filter | None, least: int, longest: int,
                  trie_phrases: int) -> DataFrame:
    """lang, phrase, n of the phrases of two words, or with ``pairs`` of three and more, that
    stand ``least`` times or more."""
    conf = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prefixes, kind = 4 * max(conf, docs.rdd.getNumPartitions()), arrow_schema(RUN)

    def run(batches):
        yield from PhraseCounter(words, pairs, longest, prefixes, trie_phrases, kind).count(batches)

    runs = small_batches(docs, ROWS).mapInArrow(run, RUN).repartition("lang", "prefix")
    # the runs of a prefix partition are in one task already: no further exchange
    each = runs.select("lang", "prefix", F.explode(F.arrays_zip("phrases", "counts")).alias("x"))
    return (each.groupBy("lang", "prefix", F.col("x.phrases").alias("phrase")).agg(F.sum("x.counts").alias("n"))
            .filter(F.col("n") >= least).select("lang", "phrase", "n"))


# -- operator -----------------------------------------------------------------

def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, trie_phrases: int = 800_000,
                     filter_bits: int = 1 << 28) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k words, f) of all phrases of 1 to ``longest`` words that stand ``least``
    times or more, and (lang, n) of all words."""
    docs = spread(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text"))
    words = materialize(word_counts(docs), "phrase-words")
    single = words.filter(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), "n")
    known = Filter(single, filter_bits)
    found = [single]
    if longest >= 2:
        found.append(materialize(phrase_counts(docs, known, None, least, 2, trie_phrases), "phrase-pairs"))
    if longest >= 3:
        more = phrase_counts(docs, known, Filter(found[1], filter_bits), least, longest, trie_phrases)
        found.append(materialize(more, "phrase-longer"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    out = out.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("k"), F.col("n").alias("f"))
    return materialize(out, "phrases"), words.groupBy("lang").agg(F.sum("n").alias("n"))


def _part(first: str, n: str) -> str:
    return f"array_join(slice(split(phrase, ' '), {first}, {n}), ' ')"


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, within: int = 100, top: int = 2000,
                 trie_phrases: int = 800_000, filter_bits: int = 1 << 28) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    phrases, totals = frequent_phrases(docs, least, longest, trie_phrases, filter_bits)
    candidates = phrases.filter("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"))
    part = phrases.select("lang", "phrase", "f")
    cuts = (candidates.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
            .select("lang", "phrase", "k", "a", "cut", F.expr(_part("1", "cut")).alias("left"),
                    F.expr(_part("cut + 1", "k - cut")).alias("right")))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(part.select(F.col("lang"), F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    wide = "CAST({} AS decimal(38, 0))"
    cuts = cuts.join(totals, "lang").withColumn("score", F.expr(
        f"{wide.format(wide.format('1000 * a') + ' * n')} div {wide.format('CAST(l AS decimal(19, 0)) * r')}"))
    scored = materialize(
        cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"),
                                           F.first("a").alias("a"), F.first("n").alias("n"))
        .select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score"), "phrase-scores")
    # what stands inside a longer candidate, with the count of the most frequent such one
    inside = (candidates.filter("k > 2").withColumn("at", F.explode(F.expr(
        "flatten(transform(sequence(2, k - 1), n -> transform(sequence(1, k - n + 1), i -> struct(i, n))))")))
        .select("lang", F.expr(_part("at.i", "at.n")).alias("phrase"), "a")
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = scored.join(inside, ["lang", "phrase"], "left").filter(
        f"longer IS NULL OR 100 * longer < {within} * a")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
