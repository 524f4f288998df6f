"""Packing of tokenized documents into sequences by bounded-space online best-fit.

A document is its token ids and one end id.  Only documents above ``size`` tokens are
cut: whole sequences from the end, so the first piece may be shorter.  Pieces arrive one
after the other; each goes into the open bin with the least free space that still holds
it.  At most ``open_bins`` bins are open, kept in a bitset keyed by free space; when a
new one is needed beyond that, the fullest closes first.

Tokenizing is a map over whole texts and is written once; only piece lengths are packed.
Pieces are dealt by a hash over tasks of about ``task_pieces`` pieces, in a fixed order,
so a task that runs again packs alike.  What each task leaves unfilled is packed a second
time, as one item a bin, by fewer tasks.

Texts are tokenized whole, at any length; pieces that tie in the deal go by length, and of
bins with equal free space the one opened last is filled.  Other columns, whatever their
names, are ignored.  Nulls: a null text is the end id alone; a null doc_id is packed like any other.  Empty
texts give a piece of one token.  Repeated rows are packed each.  An empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

from .arrow import map_rows
from .common import spread

END = 0
SPECIAL = "<|endoftext|>"


@lru_cache(4)
def _tokenizer(name: str):
    """Ids of a text by the vocabulary ``name`` (a path, or a file of public_tokenizers).
    The ranks file holds the same vocabulary and is several times faster; a text with the
    special token's string goes through the json file, which knows it."""
    import public_tokenizers
    import tiktoken

    def where(file):
        return file if "/" in file else public_tokenizers.path(file)
    with open(where(name.removesuffix(".json") + ".tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @lru_cache(1)
    def full():
        from tokenizers import Tokenizer
        return Tokenizer.from_file(where(name))
    return lambda text: (fast.encode_ordinary(text) if SPECIAL not in text
                         else full().encode(text, add_special_tokens=False).ids)


def pieces(docs: DataFrame, size: int = 2048, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every whole text."""
    def cut(docs, texts):
        encode, out = _tokenizer(tokenizer), []
        for doc, text in zip(docs, texts):
            ids = np.array(encode(text or "") + [END], dtype="<u4")
            first = (len(ids) - 1) % size + 1
            starts = [0, *range(first, len(ids), size)]
            for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                out.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
        names = ("doc_id", "piece", "start", "length", "ids_crc32")
        return {n: [r[i] for r in out] for i, n in enumerate(names)}

    kind = dict(docs.dtypes)["doc_id"]
    return map_rows(spread(docs.select("doc_id", "text")), cut, ["doc_id", "text"],
                    f"doc_id {kind}, piece int, start long, length long, ids_crc32 long", rows=64)


class Packer:
    """Bounded-space best-fit over integer lengths."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.free = 0  # bit f: an open bin has f free places
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]
        self.n_open = self.n_made = 0

    def put(self, length: int) -> tuple[int, int]:
        """Bin number and place in it."""
        fits = self.free >> length
        if fits:
            f = length + (fits & -fits).bit_length() - 1
            b = self._take(f)
        else:
            if self.n_open == self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            f, b = self.size, self.n_made
            self.n_made += 1
        if f > length:
            self.bins[f - length].append(b)
            self.free |= 1 << (f - length)
            self.n_open += 1
        return b, self.size - f

    def _take(self, f: int) -> int:
        b = self.bins[f].pop()
        if not self.bins[f]:
            self.free &= ~(1 << f)
        self.n_open -= 1
        return b


def _packed(items: DataFrame, tasks: int, size: int, open_bins: int, level: int, order: list[str]) -> DataFrame:
    """``items`` (with ``length``) and bin, offset.  Each task numbers its bins from its own base."""
    import pyarrow as pa

    fields = ", ".join(f"{n} {t}" for n, t in items.dtypes)

    def run(batches):
        from pyspark import TaskContext
        packer = Packer(size, open_bins)
        base = (level << 60) + (TaskContext.get().partitionId() << 36)
        for batch in batches:
            at = [packer.put(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + b for b, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())],
                names=[*batch.schema.names, "bin", "offset"])

    dealt = items.repartition(tasks, *order).sortWithinPartitions(F.xxhash64(*order), *order, "length")
    return dealt.mapInArrow(run, f"{fields}, bin long, offset long")


def pack(docs: DataFrame, size: int = 2048, open_bins: int = 1024, task_pieces: int = 50_000,
         tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = materialize(pieces(docs, size, tokenizer), "packing-pieces")
    tasks = max(1, -(-cut.count() // task_pieces))
    first = materialize(_packed(cut, tasks, size, open_bins, 0, ["doc_id", "piece", "ids_crc32"]), "packing-bins")
    if tasks == 1:
        return first.withColumnRenamed("bin", "sequence_id")
    fill = first.groupBy("bin").agg(F.sum("length").alias("length")).filter(F.col("length") < size - size // 64)
    again = _packed(fill.withColumnRenamed("bin", "part"), max(1, tasks // 32), size, open_bins, 1, ["part"])
    again = again.select("part", F.col("bin").alias("sequence"), F.col("offset").alias("base"))
    return first.join(again, first["bin"] == again["part"], "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))
