"""Token counts, vocabulary fitting and vocabulary encoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.arrays import UNK_ID, VOCAB_BASE
from tessera.operators.ranking import sort_with_position


def token_counts(df: DataFrame, tokens_col: str, out: str = "token") -> DataFrame:
    """Frequency of every token (map-side partial counts, then one shuffle)."""
    return df.select(F.explode(tokens_col).alias(out)).groupBy(out).agg(F.count(F.lit(1)).alias("cnt"))


def top_tokens(df: DataFrame, tokens_col: str, k: int = 2000, out: str = "token") -> DataFrame:
    """The ``k`` most frequent tokens, ties by token (a top-k report)."""
    return token_counts(df, tokens_col, out).orderBy(F.desc("cnt"), F.asc(out)).limit(k)


def build_vocab(*token_frames: DataFrame, token_col: str = "token", base: int = VOCAB_BASE) -> DataFrame:
    """Union of token sets, ids ``base + rank`` in token order (positions of a distributed
    sort: the vocabulary may be large, so no one-partition window)."""
    u = token_frames[0].select(token_col)
    for f in token_frames[1:]:
        u = u.unionByName(f.select(token_col))
    u = u.where(F.col(token_col).isNotNull()).distinct()
    r = sort_with_position(u, [token_col], "_r")
    return r.select(token_col, (F.lit(base) + F.col("_r")).cast("int").alias("id"))


#: words of a vocabulary that every task may hold
TASK_WORDS = 1 << 20


def encode(df: DataFrame, key: str, tokens_col: str, vocab: DataFrame, token_col: str = "token",
           out: str = "input_ids", unk: int = UNK_ID, specials: dict | None = None,
           task_words: int = TASK_WORDS) -> DataFrame:
    """Tokens -> ids, one row a key; a row without tokens gets an empty array, and rows of one
    key are merged by place.  ``specials`` maps marker tokens to their ids.

    A vocabulary of at most ``task_words`` words goes to the tasks, which look whole arrays up,
    so no token becomes a row; a larger one is joined (:func:`_encode_joined`)."""
    words = vocab.select(token_col, "id").limit(task_words + 1).toArrow()
    if words.num_rows > task_words:
        return _encode_joined(df, key, tokens_col, vocab, token_col, out, unk, specials)
    known, ids = words[token_col].to_pylist(), words["id"].to_pylist()
    more = {w: i for w, i in (specials or {}).items() if w not in set(known)}
    known, ids = pa.array(known + list(more), pa.string()), pa.array(ids + list(more.values()), pa.int32())

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()  # without the places of null lists
            found = pc.take(ids, pc.index_in(flat, value_set=known.cast(flat.type))).fill_null(unk)
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(), dtype=np.int32)
            offsets = pa.array(np.concatenate([np.zeros(1, np.int32), ends]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, found)], names=[key, out])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(out, T.ArrayType(T.IntegerType()))])
    rows = df.select(key, tokens_col).mapInArrow(run, schema).groupBy(key).agg(F.collect_list(out).alias("_r"))
    placed = F.flatten(F.transform("_r", lambda r: F.transform(r, lambda x, i: F.struct(i.alias("i"), x.alias("x")))))
    return rows.select(key, F.when(F.size("_r") == 1, F.get("_r", F.lit(0)))
                       .otherwise(F.transform(F.sort_array(placed), lambda s: s["x"])).alias(out))


def _encode_joined(df: DataFrame, key: str, tokens_col: str, vocab: DataFrame, token_col: str, out: str, unk: int,
                   specials: dict | None) -> DataFrame:
    """:func:`encode` by joining the vocabulary, for any size of it; the ids of a row are
    collected again in token order."""
    ex = df.select(key, F.posexplode_outer(tokens_col).alias("_pos", token_col))
    known = [F.col("id")]
    if specials:
        m = F.create_map(*[F.lit(x) for kv in specials.items() for x in kv])
        known.append(F.try_element_at(m, F.col(token_col)))
    j = ex.join(vocab, token_col, "left").select(key, "_pos", F.coalesce(*known, F.lit(unk)).alias("_id"))
    one = F.when(F.col("_pos").isNotNull(), F.struct("_pos", "_id"))  # nulls are not collected
    enc = j.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("_s"))
    return enc.select(key, F.transform("_s", lambda s: s["_id"]).alias(out))
