"""Removal of byte strings that stand twice, by two-stage suffix sorting.

Every byte covered by a ``length``-byte string that also starts anywhere else (in the same
document or in another one) goes; strings are judged on the input.

Suffixes that cannot share ``length`` bytes with another one are left out of the sorting,
and the others are dealt to tasks so that equal strings meet:

1. A map over whole texts chooses anchors by content (``shingle.anchors``): every string of
   ``length`` bytes holds one, and equal strings hold equal ones.  A string belongs to its
   first anchor; the strings of one anchor make a snippet of the text.  One aggregation
   per anchor counts it and compares the snippets' hashes.
2. A string that holds an anchor found once is not repeated.  Where an anchor always has
   the same snippet, all its strings are repeated.  What is left are anchors that stand
   in different surroundings: at the ends of copies.
3. Their distinct snippets are dealt by anchor.  Each task sorts the suffixes of its
   snippets by the two-stage method (``suffix_array``), a few megabytes at a time; where
   two neighbours share ``length`` bytes, both strings are repeated.  An anchor with more
   than ``most_snippets`` distinct surroundings (a line that half the corpus carries) would
   grow with the corpus; its strings are dealt each by their own 128-bit hash instead.
4. The spans go back to the documents.

Texts are shuffled once, those with something to sort a second time.  A null text is
empty, as is the result of an empty table.  A null doc_id is an ordinary one.  Repeated rows
are texts like any others, and so repeat each other.  Texts are taken whole, at any length;
equal strings all go, so there are no ties.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

from . import shingle
from .arrow import arrow_schema, map_rows, record_batch, small_batches
from .common import spread
from .substring_dedup import cover
from .suffix_array import common_prefixes, two_stage_sort

SMALL = 9  # bytes in the strings whose least hash makes an anchor
BLOCK = 2 << 20  # bytes of snippets that are sorted together


def anchor_size(length: int) -> int:
    return (length + SMALL + 1) // 2


def snippets(text: bytes, length: int) -> tuple[np.ndarray, ...]:
    """Anchor places and hashes, and where the snippet of each begins and ends (alike if empty)."""
    data = np.frombuffer(text, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    k = anchor_size(length)
    if len(data) < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    at = shingle.anchors(data, k, SMALL)
    first = np.maximum(at + k - length, 0)
    first[1:] = np.maximum(first[1:], at[:-1] + 1)
    last = np.minimum(at, len(data) - length)  # the last string that begins so
    return at, shingle.windows(data, k)[at], first, np.where(last >= first, last + length, first)


def _span_hashes(text: bytes, first: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """Hash of each span of a text; spans are short, so a part of the text at a time will do."""
    data = np.frombuffer(text, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    out = np.zeros(len(first), dtype=np.uint64)
    for a in range(0, len(first), 1 << 14):
        x, y = first[a:a + (1 << 14)], end[a:a + (1 << 14)]
        base = int(x.min())
        part = data[base:int(y.max())]
        s = np.zeros(len(part) + 1, dtype=np.uint64)
        up, down = shingle.powers(which, len(part) + 1)
        np.cumsum(part * up[:-1], out=s[1:])
        out[a:a + (1 << 14)] = shingle.mix((s[y - base] - s[x - base]) * down[x - base] + (y - x).astype(np.uint64))
    return out


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    """h (anchor), s (snippet hash), key, text_key, i (number in the text)."""
    def run(keys, text_keys, rows):
        out = {n: [np.zeros(0, dtype=np.int64)] for n in ("h", "s", "key", "text_key", "i")}
        for key, text_key, text in zip(keys, text_keys, rows):
            raw = text.encode()
            at, h, first, end = snippets(raw, length)
            if len(at):
                cols = (shingle.signed(h), shingle.signed(_span_hashes(raw, first, end, 1)), np.full(len(at), key),
                        np.full(len(at), text_key), np.arange(len(at)))
                for name, col in zip(out, cols):
                    out[name].append(col)
        return {n: np.concatenate(v) for n, v in out.items()}

    return map_rows(texts, run, ["key", "text_key", "text"], "h long, s long, key long, text_key long, i int")


def _digest(raw: bytes, spans) -> tuple[int, int, int, str]:
    if not spans:
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest()
    gone = cover(len(raw), spans)
    n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
    return len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest()


def repeated_in(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each of some distinct strings, where ``length`` bytes begin that another place has too."""
    text = np.frombuffer(b"".join(parts), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    whole = np.zeros(len(text), dtype=bool)  # a string of that length fits in its snippet
    for a, b in zip(starts, starts[1:]):
        whole[a:max(a, b - length + 1)] = True
    order = two_stage_sort(text, length, whole)
    order = order[whole[order]]
    equal = common_prefixes(text, order, length) >= length
    found = np.zeros(len(text), dtype=bool)
    found[order[:-1][equal]] = True
    found[order[1:][equal]] = True
    return [np.flatnonzero(found[a:b]) for a, b in zip(starts, starts[1:])]


def _ranges(at: np.ndarray, length: int) -> list[dict]:
    """Strings of ``length`` that begin at ``at``, as maximal ranges."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length) + 1
    return [{"first": int(p[0]), "end": int(p[-1]) + length} for p in np.split(at, cut)]


def _sorted_snippets(distinct: DataFrame, length: int) -> DataFrame:
    """Suffix sorting of the snippets of whole anchors, a block at a time."""
    schema = "h long, s1 long, s2 long, ranges array<struct<first: int, end: int>>"
    kind = arrow_schema(schema)

    def sort(rows):
        out = [(*r[:3], _ranges(at, length)) for r, at in zip(rows, repeated_in([r[3] for r in rows], length))]
        return record_batch(kind, {f.name: [r[i] for r in out] for i, f in enumerate(kind)})

    def run(batches):
        block, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("h", "s1", "s2", "snippet"))):
                if size >= BLOCK and row[0] != block[-1][0]:
                    yield sort(block)
                    block, size = [], 0
                block.append(row)
                size += len(row[3])
        if block:
            yield sort(block)

    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return small_batches(distinct.repartition(tasks, "h").sortWithinPartitions("h", "s1", "s2")).mapInArrow(run, schema)


def _hashed_strings(distinct: DataFrame, length: int) -> DataFrame:
    """Every string of the snippets by its own hash, and those that other snippets have too."""
    def run(h, s1, s2, parts):
        out = {n: [np.zeros(0, dtype=np.int64)] for n in ("h", "s1", "s2", "at", "w1", "w2")}
        for row, part in zip(zip(h, s1, s2), parts):
            data = np.frombuffer(part, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
            w1, w2 = shingle.windows(data, length, 0), shingle.windows(data, length, 1)
            for name, col in zip(out, (*(np.full(len(w1), v) for v in row), np.arange(len(w1)), w1, w2)):
                out[name].append(col.view(np.int64))
        return {n: np.concatenate(v) for n, v in out.items()}

    strings = map_rows(distinct.select("h", "s1", "s2", "snippet"), run, ["h", "s1", "s2", "snippet"],
                       "h long, s1 long, s2 long, at int, w1 long, w2 long")
    twice = materialize(strings.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2"),
                        "suffix-strings")
    return (strings.join(twice, ["w1", "w2"], "left_semi").groupBy("h", "s1", "s2")
            .agg(F.collect_list(F.struct(F.col("at").alias("first"), (F.col("at") + length).cast("int").alias("end")))
                 .alias("ranges")))


def remove_repeats(docs: DataFrame, length: int = 200, most_snippets: int = 4000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row for each row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = spread(docs.select("doc_id", text.alias("text"))).withColumns(
        {"key": F.xxhash64("doc_id", "text"), "text_key": F.xxhash64("text", F.lit("text"))})
    found = _anchors(whole.select("key", "text_key", "text"), length)
    twice = (found.groupBy("h").agg(F.count("*").alias("n"), (F.min("s") == F.max("s")).alias("alike"))
             .filter("n > 1").drop("n"))
    twice = materialize(twice, "suffix-anchors")  # both sides of the join are then exchanges that AQE can split
    lists = (found.select("h", "key", "text_key", "i").join(twice, "h")
             .groupBy("key", "text_key").agg(F.collect_set(F.struct("i", "alike")).alias("known")))
    state = whole.join(lists, ["key", "text_key"], "left").select("doc_id", "key", "text_key", "text", "known")

    def first_pass(texts, lists):
        out = []
        for text, known in zip(texts, lists):
            raw = text.encode()
            if not known:
                out.append((*_digest(raw, None), [], None, []))
                continue
            at, h, first, end = snippets(raw, length)
            alike, repeated = np.zeros(len(at), dtype=bool), np.zeros(len(at), dtype=bool)
            for x in known:
                repeated[x["i"]] = True
                alike[x["i"]] = x["alike"]
            # a string does not reach over the next anchor that stands once
            stop = np.where(repeated, len(raw), at + anchor_size(length) - 1)
            stop = np.minimum.accumulate(stop[::-1])[::-1]
            sure = [{"first": a, "end": b} for a, b in zip(first[alike].tolist(), end[alike].tolist()) if a < b]
            end = np.minimum(end, stop)
            mixed = np.flatnonzero(repeated & ~alike & (end - first >= length))
            s = [shingle.signed(_span_hashes(raw, first[mixed], end[mixed], w)).tolist() for w in (0, 1)]
            hard = [{"h": x, "s1": y, "s2": z, "first": a, "snippet": raw[a:b]} for x, y, z, a, b in
                    zip(shingle.signed(h[mixed]).tolist(), *s, first[mixed].tolist(), end[mixed].tolist())]
            if hard:
                out.append((len(raw), None, None, None, sure, text, hard))
            else:
                out.append((*_digest(raw, [(x["first"], x["end"]) for x in sure]), sure, None, []))
        names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "sure", "pending", "hard")
        return {n: [r[i] for r in out] for i, n in enumerate(names)}

    kind = dict(whole.dtypes)["doc_id"]
    state = materialize(map_rows(
        state, first_pass, ["text", "known"],
        f"doc_id {kind}, key long, text_key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "sure array<struct<first: long, end: long>>, pending string, "
        "hard array<struct<h: long, s1: long, s2: long, first: long, snippet: binary>>"), "suffix-state")

    hard = state.select("key", "text_key", F.explode("hard").alias("x")).select("key", "text_key", "x.*")
    distinct = materialize(hard.groupBy("h", "s1", "s2").agg(
        F.count("*").alias("n"), F.first("snippet").alias("snippet")), "suffix-snippets")
    crowded = (distinct.groupBy("h").agg(F.count("*").alias("n_snippets"))
               .filter(F.col("n_snippets") > most_snippets).select("h"))
    few = distinct.join(crowded, "h", "left_anti").select("h", "s1", "s2", "snippet")
    many = distinct.join(crowded, "h", "left_semi").select("h", "s1", "s2", "snippet")
    copies = distinct.filter("n > 1").select("h", "s1", "s2", F.array(F.struct(
        F.lit(0).alias("first"), F.length("snippet").alias("end"))).alias("ranges"))
    flagged = materialize(_sorted_snippets(few, length).unionByName(_hashed_strings(many, length))
                          .filter(F.size("ranges") > 0).unionByName(copies), "suffix-flagged")
    hits = (hard.select("key", "text_key", "h", "s1", "s2", F.col("first").alias("base")).distinct()
            .join(flagged, ["h", "s1", "s2"])
            .select("key", "text_key", F.expr("transform(ranges, r -> struct(r.first + base AS first, r.end + base AS end))")
                    .alias("ranges"))
            .groupBy("key", "text_key").agg(F.flatten(F.collect_list("ranges")).alias("hits")))
    wait = (state.filter("pending IS NOT NULL").select("doc_id", "key", "text_key", "sure", "pending")
            .join(hits, ["key", "text_key"], "left"))

    def second_pass(texts, sure, lists):
        out = [_digest(t.encode(), [(x["first"], x["end"]) for x in [*s, *(h or [])]])
               for t, s, h in zip(texts, sure, lists)]
        return {n: [r[i] for r in out] for i, n in enumerate(names)}

    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    late = map_rows(wait.select("doc_id", "pending", "sure", "hits"), second_pass, ["pending", "sure", "hits"],
                    f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return state.filter("pending IS NULL").select("doc_id", *names).unionByName(late)
