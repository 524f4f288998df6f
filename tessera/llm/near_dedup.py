"""Near-duplicate documents by banded MinHash, odd sketches and exact confirmation.

The set of a document is its distinct runs of ``words`` lower-cased words (one run of all
words if there are fewer; empty without words).  Documents are linked when the
intersection of their sets is ``percent`` % of the union or more; the result is the
connected components of the links.

1. One map over whole texts gives each document the size and a 128-bit fingerprint of its
   set, 128 MinHash samples, cut into 32 bands of 4, and an odd sketch: one-permutation
   MinHash samples (the least hash in each of 1024 ranges) folded into 2048 parities.
2. Equal sets are one class, found by one aggregation, with its smallest doc_id.  From here
   on only classes are compared, so copies by the thousand weigh as much as one document.
3. Classes that share a band are candidates (a pair at 0.8 is missed with probability
   5e-8).  A bucket is not expanded into pairs: each member meets the bucket's smallest
   and largest id.  The XOR of two odd sketches estimates a pair's similarity; pairs
   whose estimate lies six standard errors below the limit are dropped, and each class has its
   likeliest pair confirmed on full sets.
4. The confirmed links give components.  Where several still meet in a bucket, all members
   but those of the bucket's largest component meet the others, block by block in numpy: the
   sizes and the parities of the whole sets rule pairs out (two sets never differ in fewer
   shingles than their parities do in bits, so no link is lost, and few other pairs are
   left).  Each of these members has its nearest one of another component confirmed, and
   components are joined again.
5. The buckets that are still mixed then yield all pairs between members of different
   components that are left so, less those confirmed or refuted before.  Every candidate
   pair is thus inside one component or checked: nothing is capped.

Only texts of candidate documents are kept for confirmation.  Nulls: a null text is
empty; empty sets are linked with nothing; a null doc_id is linked with nothing and kept.
Rows that repeat a doc_id are one document: it has the links of each of them, so what they
are linked with is one component, and they are kept or dropped together.  Very long texts
are taken whole, a chunk of hashes at a time.  Ties go to the smaller id; other columns,
whatever their names, are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

from . import shingle
from .arrow import arrow_schema, map_rows, record_batch, small_batches
from .common import keyed, spread
from .components import connected

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
BINS, BITS = 1024, 2048
#: pairs whose estimate is so many standard errors below the limit are not confirmed
ERRORS = 6
#: least and most bits of the parities of a whole set
LEAST, MOST = 1 << 10, 1 << 17
#: members of a mixed bucket that one side of a block has (32 MB of parities at most)
SIDE_ROWS = 2048
#: rows of small blocks that are worked on together
TOGETHER = 128


@lru_cache(1)
def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    a = rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)[:, None]


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of the whole text."""
    w = shingle.word_hashes(shingle.lower(text))[0]
    x = np.sort(shingle.windows(w, words if len(w) >= words else len(w))) if len(w) else w
    return x[np.concatenate([x[:1] == x[:1], x[1:] != x[:-1]])]


def min_hashes(x: np.ndarray) -> np.ndarray:
    a, b = _factors()
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(x), 256):  # worked on in place, in the cache
        y = x[None, at:at + 256] * a
        y += b
        np.minimum(low, y.min(axis=1), out=low)
    return low


def odd_sketch(x: np.ndarray) -> np.ndarray:
    """One-permutation MinHash (the least hash of each of BINS equal ranges) folded into
    BITS parities, then which ranges have a hash; as integers of 64 bits."""
    bins = (x >> np.uint64(54)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))  # x is sorted
    place = (shingle.mix(x[first]) & np.uint64(BITS - 1)).astype(np.int64)
    some = np.zeros(BINS, dtype=np.int64)
    some[bins[first]] = 1
    return np.packbits(np.concatenate([np.bincount(place, minlength=BITS) & 1, some])).view(np.int64)


def parities(x: np.ndarray) -> bytes:
    """Odd sketch of a whole set, four to eight bits a value up to MOST: two differ in at most as
    many bits as their sets in values.  Halves folded by XOR give the sketch of half the bits."""
    bits = LEAST
    while bits < min(4 * len(x), MOST):
        bits *= 2
    place = (shingle.mix(x) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=bits) & 1).tobytes()


def _folded(marks: list[bytes], size: int) -> np.ndarray:
    """Parities of one length as rows of integers, folded to ``size`` bytes."""
    x = np.frombuffer(b"".join(marks), dtype=np.uint64).reshape(len(marks), -1)
    while x.shape[1] > size // 8:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def _differing(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """In how many bits each row of ``p`` differs from each column of ``q``."""
    out = np.zeros((len(p), q.shape[1]), dtype=np.int32)
    for i in range(len(q)):
        out += np.bitwise_count(p[:, i, None] ^ q[i])
    return out


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (fingerprint), bands, odd; the last four null for an empty set."""
    step, powers = np.arange(BANDS, dtype=np.uint64), shingle.powers(0, ROWS)[0]

    def run(texts):
        out, lows = [], []
        for text in texts:
            x = shingle_set(text, words)
            if not len(x):
                out.append((0, None, None, None))
                continue
            lows.append(min_hashes(x))
            out.append((len(x), int(shingle.signed(np.sum(shingle.mix(x), keepdims=True))[0]),
                        int(shingle.signed(np.sum(shingle.mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)), keepdims=True))[0]),
                        odd_sketch(x).tobytes()))
        names = ("n_shingles", "set_a", "set_b", "odd")
        cols = {n: [r[i] for r in out] for i, n in enumerate(names)}
        # the runs of ROWS samples hashed as windows are, of all texts at once
        low = np.array(lows, dtype=np.uint64).reshape(-1, BANDS, ROWS)
        bands = iter(shingle.signed(shingle.mix(shingle.mix((low * powers).sum(axis=2, dtype=np.uint64)) + step)))
        return cols | {"bands": [next(bands) if n else None for n in cols["n_shingles"]]}

    kind = dict(docs.dtypes)["doc_id"]
    return map_rows(spread(keyed(docs).select("doc_id", "text")), run, ["text"],
                    f"doc_id {kind}, n_shingles long, set_a long, set_b long, bands array<long>, odd binary")


def _bits(x: str, op: str, y: str, first: int, end: int) -> str:
    return "(" + " + ".join(f"bit_count({x}[{i}] {op} {y}[{i}])" for i in range(first // 64, end // 64)) + ")"


def counts(x: str, y: str) -> tuple[str, str, str]:
    """Of two odd sketches as arrays: parities that differ, ranges that either and that both fill."""
    return (_bits(x, "^", y, 0, BITS), *(_bits(x, op, y, BITS, BITS + BINS) for op in "|&"))


def like(differ: str, either: str, both: str) -> str:
    """Similarity by the counts: samples that agree, by the XOR of the parities, of the ranges
    that either set fills."""
    differ = f"(-{BITS / 2}D * ln(greatest(1e-9D, 1 - 2D * {differ} / {BITS})))"
    return f"(({either} + {both} - {differ}) / 2D / {either})"


def may(differ: str, either: str, both: str, size: str, percent: int) -> str:
    """Whether the estimate leaves the limit possible.  ``size`` is the sum of the set sizes:
    few ranges of a large set are a sample, nearly all of a small one are the set; and
    parities collide."""
    t = percent / 100
    expected = f"({2 * (1 - t)}D * {either})"
    variance = (f"({t * (1 - t)}D / {either} * greatest(0D, 1 - {either} * {1 + t}D / {size}) "
                f"+ pow({expected} / {either}, 2) / {2 * BITS}D)")
    return f"{like(differ, either, both)} >= {t}D - 0.01D - {ERRORS}D * sqrt({variance})"


def estimate(x: str, y: str) -> str:
    return like(*counts(x, y))


def may_reach(x: str, y: str, size: str, percent: int) -> str:
    return may(*counts(x, y), size, percent)


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) with the estimate, those that may reach the limit; sizes bound it too.
    The bits are counted in numpy: as an expression they are too long for the JVM to compile."""
    def run(xs, ys):
        x, y = (np.frombuffer(b"".join(z), dtype=np.int64).reshape(-1, (BITS + BINS) // 64) for z in (xs, ys))
        at = BITS // 64
        return {n: np.bitwise_count(z.view(np.uint64)).sum(axis=1, dtype=np.int64)
                for n, z in (("differ", x[:, :at] ^ y[:, :at]), ("either", x[:, at:] | y[:, at:]), ("both", x[:, at:] & y[:, at:]))}

    side = [classes.select(F.col("rep").alias(n), F.col("odd").alias(f"odd_{n}"), F.col("n_shingles").alias(f"n_{n}"))
            for n in "ab"]
    rows = (pairs.join(side[0], "a").join(side[1], "b")
            .filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
            .select("a", "b", (F.col("n_a") + F.col("n_b")).alias("size"), "odd_a", "odd_b"))
    rows = map_rows(rows, run, ["odd_a", "odd_b"], "a long, b long, size long, differ long, either long, both long", rows=4096)
    of = ("differ", "either", "both")
    return rows.filter(may(*of, "size", percent)).select("a", "b", F.expr(like(*of)).alias("like"))


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``pairs`` (a, b) and whether their full sets reach the limit."""
    schema = "a long, b long, linked boolean"
    kind = arrow_schema(schema)

    def run(batches):
        known = lru_cache(64)(lambda text: shingle_set(text, words))
        for batch in batches:
            linked = []
            for x, y in zip(*(batch.column(n).to_pylist() for n in ("text_a", "text_b"))):
                p, q = known(x), known(y)
                both = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(100 * both >= percent * (len(p) + len(q) - both))
            yield record_batch(kind, {"a": batch.column("a"), "b": batch.column("b"), "linked": pa.array(linked)})

    side = [texts.select(F.col("doc_id").alias(n), F.col("text").alias(f"text_{n}")) for n in "ab"]
    return small_batches(pairs.select("a", "b").join(side[0], "a").join(side[1], "b")).mapInArrow(run, schema)


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members (bucket, doc) with their components, of the buckets that hold several."""
    now = members.join(found, members["doc"] == found["node"], "left").select(
        *members.columns, F.coalesce("component", "doc").alias("component"))
    several = now.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
    return now.join(materialize(several.select("bucket"), "near-several"), "bucket", "left_semi")


def _by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of whole keys, of batches that are sorted by them, and the number of each row's key; small keys come together."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        key = np.stack([batch.column(n).to_numpy() for n in keys])
        number = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))])
        edges, start = [*(np.flatnonzero(np.diff(number)) + 1).tolist()], 0
        for a, b in zip(edges, [*edges[1:], batch.num_rows + TOGETHER]):
            if b - start > TOGETHER:
                yield batch.slice(start, a - start), number[start:a]
                start = a
        rest = batch.slice(start)
    if rest is not None:
        yield rest, number[start:]


def _marked(now: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """doc, size, marks: size and parities of the sets of the documents of ``now``."""
    def run(rows):
        sets = [shingle_set(t, words) for t in rows]
        return {"size": [len(x) for x in sets], "marks": [parities(x) for x in sets]}

    docs = now.select("doc").distinct()
    return map_rows(texts.join(docs, texts["doc_id"] == docs["doc"]).select("doc", "text"), run, ["text"],
                    "doc long, size long, marks binary", rows=64)


def _meet(rows: pa.RecordBatch, key: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Members (role, doc, component, size, marks) of one key and of different components that may be linked, those
    that meet others with those that are met: (place of the first, its doc, doc of the other, share of their
    shingles that differ at least)."""
    role = rows.column("role").to_numpy()

    def by_length(of):
        marks = rows.filter(pa.array(of)).column("marks").to_pylist()
        sizes = np.array([len(x) for x in marks], dtype=np.int64)
        cols = [c[of] for c in (key, *(rows.column(n).to_numpy() for n in ("doc", "component", "size")))]
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            yield int(n), at, [marks[i] for i in at], *(c[at] for c in cols)

    others = list(by_length(role != 1))
    for n, place, marks, own, doc, component, size in by_length(role > 0):
        for n2, _, marks2, own2, doc2, component2, size2 in others:
            if 100 * min(size.max(), size2.max()) < percent * max(size.min(), size2.min()):
                continue
            mine, theirs = _folded(marks, min(n, n2)), np.ascontiguousarray(_folded(marks2, min(n, n2)).T)
            step = max(1, (1 << 16) // len(doc2))  # worked on in the cache
            for at in range(0, len(doc), step):
                part = slice(at, at + step)
                differ = _differing(mine[part], theirs)
                # linked sets differ in that many shingles at most
                most = ((100 - percent) * (size[part, None] + size2) // (100 + percent)).astype(np.int32)
                i, j = np.nonzero(differ <= most)
                m = i + at
                ok = ((own[m] == own2[j]) & (component[m] != component2[j])
                      & (100 * np.minimum(size[m], size2[j]) >= percent * np.maximum(size[m], size2[j])))
                m, i, j = m[ok], i[ok], j[ok]
                yield place[m], doc[m], doc2[j], differ[i, j] / (size[m] + size2[j])


def _across(now: DataFrame, marks: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs (a, b) of ``now``'s members (bucket, doc, component) that share a bucket, stand in different components
    and may be linked; of a member outside its bucket's largest component only the nearest one, if that is asked.
    A large bucket is cut into blocks: the members outside the largest component by ``i``, all by ``j``."""
    main = (now.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket")
            .agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.ceil(F.sum("n") / SIDE_ROWS).alias("parts")))
    # in a block a member is met (0), meets the others (1), or both (2)
    places = """filter(if(parts = 1, array(named_struct('i', 0L, 'j', 0L, 'role', if(component <> main, 2, 0))), concat(
        transform(sequence(0L, parts - 1), x -> named_struct('i', x, 'j', own, 'role', 0)),
        transform(sequence(0L, parts - 1), x -> named_struct('i', own, 'j', x, 'role', 1)))),
        x -> x.role <> 1 OR component <> main)"""
    dealt = (now.join(main, "bucket").withColumn("own", F.expr("pmod(xxhash64(doc), parts)"))
             .select("bucket", "doc", "component", F.explode(F.expr(places)).alias("at")).select("bucket", "at.*", "doc", "component")
             .join(marks, "doc").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j"))
    schema = "me long, a long, b long, differ double"
    kind = arrow_schema(schema)

    def run(batches):
        for rows, key in _by_key(batches, ["bucket", "i", "j"]):
            for place, me, other, differ in _meet(rows, key, percent):
                if nearest and len(me):
                    order = np.lexsort((other, differ, place))
                    order = order[np.diff(place[order], prepend=-1) != 0]
                    me, other, differ = me[order], other[order], differ[order]
                if len(me):
                    yield record_batch(kind, {"me": me, "a": np.minimum(me, other), "b": np.maximum(me, other), "differ": differ})

    pairs = small_batches(dealt).mapInArrow(run, schema)
    if nearest:
        pairs = pairs.groupBy("me").agg(F.min(F.struct("differ", "a", "b")).alias("x")).select("x.*")
    return pairs.select("a", "b").distinct()


def _further(pairs: DataFrame, checked: DataFrame, links: DataFrame, found: DataFrame, texts: DataFrame, words: int,
             percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Confirms some more pairs and joins components."""
    new = pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")
    new = materialize(_confirm(new, texts, words, percent), "near-checked")
    more = new.filter("linked").select("a", "b")
    if more.isEmpty():
        return checked.unionByName(new), links, found
    return checked.unionByName(new), links.unionByName(more), connected(links.unionByName(more))


def _same_ids(full: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of the rows that repeat a doc_id with another set."""
    sets = F.struct("set_a", "set_b", "n_shingles")
    several = (full.groupBy("doc_id").agg(F.min(sets).alias("x"), F.max(sets).alias("y")).filter("x <> y").select("doc_id"))
    own = (full.join(several, "doc_id", "left_semi").select("doc_id", "set_a", "set_b", "n_shingles").distinct()
           .join(classes.select("set_a", "set_b", "n_shingles", "rep"), ["set_a", "set_b", "n_shingles"]))
    least = own.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return own.join(least, "doc_id").filter("a <> rep").select("a", F.col("rep").alias("b")).distinct()


def components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach), kept: a row a row."""
    made = materialize(sketches(docs, words), "near-sketches")
    full = made.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(
        full.groupBy("set_a", "set_b", "n_shingles")
        .agg(F.min("doc_id").cast("long").alias("rep"), F.first("bands").alias("bands"), F.first("odd").alias("odd")),
        "near-classes")
    members = classes.select(F.col("rep").alias("doc"), F.explode("bands").alias("bucket"))
    ends = materialize(members.groupBy("bucket").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
                       .filter("low < high"), "near-ends")
    members = materialize(members.join(ends, "bucket"), "near-buckets")

    def pairs(x, y):
        return members.filter(f"{x} <> {y}").select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    likely = materialize(_likely(pairs("doc", "low").union(pairs("doc", "high")).distinct(), classes, percent),
                         "near-likely")
    # both ends of a pair may choose it, so a star's hub does not decide for its members
    each = likely.select(F.col("a").alias("me"), "a", "b", "like").union(likely.select("b", "a", "b", "like"))
    best = (each.groupBy("me").agg(F.max(F.struct("like", "a", "b")).alias("x")).select("x.a", "x.b").distinct())
    wanted = members.select(F.col("doc").alias("doc_id")).distinct()
    texts = materialize(keyed(docs).select("doc_id", "text").join(wanted, "doc_id", "left_semi"), "near-texts")
    checked = materialize(_confirm(best, texts, words, percent), "near-checked")
    links = materialize(checked.filter("linked").select("a", "b").unionByName(_same_ids(full, classes)), "near-links")
    found = connected(links)

    now = materialize(_mixed(members.select("bucket", "doc"), found), "near-mixed")
    marks = materialize(_marked(now, texts, words), "near-marks")
    checked, links, found = _further(_across(now, marks, percent, True), checked, links, found, texts, words, percent)
    now = materialize(_mixed(now.drop("component"), found), "near-mixed")
    checked, links, found = _further(_across(now, marks, percent, False), checked, links, found, texts, words, percent)

    named = full.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").cast("long").alias("rep"))
    named = materialize(named.join(found, named["rep"] == found["node"], "left").select(
        "set_a", "set_b", F.coalesce("component", "rep").alias("component")), "near-named")
    out = made.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", F.col("doc_id").cast("long")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
