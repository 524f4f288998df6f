"""Token-array functions: encoding, truncation, padding, label suffixes, masking.

All run as Spark higher-order functions (``transform``/``slice``/``concat``)
inside whole-stage codegen; the only Python is the older n-gram masker, whose greedy
cover is sequential within a row (an Arrow-batched pandas UDF).
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Special token ids of the BERT-style vocabulary the reference uses.
PAD_ID = 0
UNK_ID = 100
CLS_ID = 101
SEP_ID = 102
MASK_ID = 103
SPECIAL_IDS = (PAD_ID, UNK_ID, CLS_ID, SEP_ID, MASK_ID)
IGNORE_LABEL = -100
# ids of fitted vocabulary entries start here (after the reserved range)
VOCAB_BASE = 1000


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_specials(ids, max_len: int | None = None) -> Column:
    """[CLS] + content + [SEP]; content cut to ``max_len - 2`` when a length is given."""
    body = _c(ids) if max_len is None else F.slice(_c(ids), 1, max_len - 2)
    return F.concat(F.array(F.lit(CLS_ID)), body, F.array(F.lit(SEP_ID)))


def pad_right(ids, length: int, pad: int = PAD_ID) -> Column:
    n = F.size(_c(ids))
    return F.concat(_c(ids), F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - n, F.lit(0))))


def ones_mask(ids, length: int | None = None) -> Column:
    m = F.transform(_c(ids), lambda x: F.lit(1))
    return m if length is None else pad_right(m, length, 0)


def truncate_pad(ids, max_len: int, pad: int = PAD_ID):
    """Head truncation with specials, right padding to ``max_len``; returns (ids, mask)."""
    core = with_specials(ids, max_len)
    return pad_right(core, max_len, pad), ones_mask(core, max_len)


def side_truncate_pad(ids, max_len: int, u: Column, u2: Column, pad: int = PAD_ID):
    """Truncate/pad by side chosen by ``u``: <=.33 head (pad right), >=.66 tail (pad
    left), otherwise a window starting at ``floor(u2 * (n - max + 1))`` (pad split at
    ``floor(u2 * (missing + 1))`` on the left).  Returns (ids, mask)."""
    return side_pad(side_cut(ids, max_len, u, u2), max_len, u, u2, pad)


def side_cut(ids, max_len: int, u: Column, u2: Column) -> Column:
    """The part of :func:`side_truncate_pad` that is kept (of ids, or of tokens before
    they are looked up)."""
    a = _c(ids)
    n = F.size(a)
    over = n - F.lit(max_len)
    start = F.floor(u2 * (over + 1)).cast("int") + 1
    return (F.when(n <= max_len, a)
            .when(u <= 0.33, F.slice(a, 1, max_len))
            .when(u >= 0.66, F.slice(a, n - max_len + 1, max_len))
            .otherwise(F.slice(a, start, max_len)))


def side_pad(cut, max_len: int, u: Column, u2: Column, pad: int = PAD_ID):
    """Pads a part to ``max_len`` on the side that ``u`` chooses; (ids, mask)."""
    cut = _c(cut)
    m = F.transform(cut, lambda x: F.lit(1))
    missing = F.greatest(F.lit(max_len) - F.size(cut), F.lit(0))
    left = (F.when(u <= 0.33, F.lit(0)).when(u >= 0.66, missing)
            .otherwise(F.floor(u2 * (missing + 1)).cast("int")))
    right = missing - left

    def place(arr, fill):
        return F.concat(F.array_repeat(F.lit(fill), left), arr, F.array_repeat(F.lit(fill), right))
    return place(cut, pad), place(m, 0)


def label_suffix(ids, mask, targets, sep: int = SEP_ID):
    """Append ``[sep, rint(2 y) + 1]`` per target; mask extended by ones."""
    extra = []
    for t in targets:
        extra += [F.lit(sep), (F.rint(F.lit(2.0) * _c(t)) + 1).cast("int")]
    return F.concat(_c(ids), F.array(*extra)), F.concat(_c(mask), F.array(*[F.lit(1)] * (2 * len(targets))))


def mask_hits(ids, key, p: float = 0.15, seed: int = 42) -> Column:
    """Per position i of row ``key``: masked when ``u(seed, key, i) < p`` and the id
    is not special (an array of booleans).  One hash of 32 digits serves four positions:
    position i takes digits ``8 (i % 4) ..`` of ``md5(seed|key|i // 4)``."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(_c(ids)) / 4).cast("int")), lambda b: F.md5(
        F.concat_ws("|", F.lit(str(seed)), _c(key).cast("string"), b.cast("string"))))

    def hits(h):
        def hit(x, i):
            digits = F.substring(F.get(h, F.floor(i / 4).cast("int")), F.lit(8) * (i % 4) + 1, F.lit(8))
            u = F.conv(digits, 16, 10).cast("bigint") / F.lit(4294967296.0)
            return (u < p) & ~x.isin(*SPECIAL_IDS)
        return F.transform(_c(ids), hit)
    return F.transform(F.array(blocks), hits)[0]  # binds the hashes: they are worked out once


def apply_mask(ids, hits):
    """(masked ids, labels) from a hit array: labels = original id at masked
    positions, -100 elsewhere."""
    masked = F.zip_with(_c(ids), _c(hits), lambda x, h: F.when(h, F.lit(MASK_ID)).otherwise(x))
    labels = F.zip_with(_c(ids), _c(hits), lambda x, h: F.when(h, x).otherwise(F.lit(IGNORE_LABEL)))
    return masked, labels


def mask_tokens(ids, key, p: float = 0.15, seed: int = 42):
    """Independent masking: (masked ids, labels).  Select :func:`mask_hits` into a
    column first and use :func:`apply_mask` to hash each token only once."""
    return apply_mask(ids, mask_hits(ids, key, p, seed))


def _mask_ngrams_row(ids: np.ndarray, seed: int, vocab_size: int, budget_frac=0.15,
                     max_n: int = 3, protect=(CLS_ID, SEP_ID)):
    """Greedy n-gram masking of one row (sequential by nature)."""
    rng = np.random.default_rng(seed)
    ids = np.asarray(ids, dtype=np.int64)
    out = ids.copy()
    labels = np.full(len(ids), IGNORE_LABEL, dtype=np.int64)
    protected = np.isin(ids, list(protect) + [PAD_ID])
    cand = np.flatnonzero(~protected)
    if len(cand) == 0:
        return out, labels
    budget = max(1, int(round(budget_frac * len(cand))))
    ns = np.arange(1, max_n + 1)
    # what ``rng.choice`` of these chances does, without its checks at every draw
    cdf = ((1.0 / ns) / (1.0 / ns).sum()).cumsum()
    cdf = (cdf / cdf[-1]).tolist()
    free, was, top = (~protected).tolist(), ids.tolist(), max(vocab_size, VOCAB_BASE + 1)
    n_cov, draw = 0, rng.random
    for s in rng.permutation(cand).tolist():
        if n_cov >= budget:
            break
        if not free[s]:
            continue
        n = bisect_right(cdf, draw()) + 1
        for j in range(s, min(s + n, len(was))):
            if not free[j]:
                continue
            free[j] = False
            n_cov += 1
            labels[j] = was[j]
            r = draw()
            if r < 0.8:
                out[j] = MASK_ID
            elif r >= 0.9:
                out[j] = int(rng.integers(VOCAB_BASE, top))
    return out, labels


def mask_ngrams(ids, key, vocab_size: int, seed: int = 42) -> Column:
    """N-gram masking (n in 1..3, p ~ 1/n, 15 % budget, 80/10/10) as an Arrow UDF
    seeded per row by ``md5(seed|key)``; returns struct(input_ids, labels)."""
    schema = T.StructType([T.StructField("input_ids", T.ArrayType(T.LongType())),
                           T.StructField("labels", T.ArrayType(T.LongType()))])

    @F.pandas_udf(schema)
    def _udf(arrs: pd.Series, hexes: pd.Series) -> pd.DataFrame:
        outs, labs = [], []
        for a, h in zip(arrs, hexes):
            o, lab = _mask_ngrams_row(a if a is not None else [], int(h[:8], 16), vocab_size)
            outs.append(o.tolist())
            labs.append(lab.tolist())
        return pd.DataFrame({"input_ids": outs, "labels": labs})

    return _udf(_c(ids), F.md5(F.concat_ws("|", F.lit(str(seed)), _c(key).cast("string"))))


def mask_ngrams_keyed(ids, key, vocab_size, seed: int = 42, budget: float = 0.15, max_n: int = 3) -> Column:
    """N-gram masking as a fold, without Python: struct(input_ids, labels).

    Positions that are not special are visited in the order of ``md5(seed|key|position)``; each
    that is not covered yet covers itself and up to ``max_n - 1`` positions behind it (n with
    chance ~ 1/n), until ``budget`` of them are covered.  A covered id becomes the mask (80 %),
    stays (10 %) or becomes any vocabulary id (10 %).  For rows cut to a model's length: a
    row costs its length times its covered positions."""
    a, total = _c(ids), sum(1 / n for n in range(1, max_n + 1))

    def hashed(i):
        return F.md5(F.concat_ws("|", F.lit(str(seed)), _c(key).cast("string"), i.cast("string")))

    def below(h, at, chance):
        # eight digits as a share of 2^32, compared as digits
        return F.substring(h, at, 8) < F.lit(f"{math.ceil(chance * 2 ** 32):08x}")

    def draw(h, i):
        n, least = F.lit(max_n), total
        for k in range(max_n, 1, -1):  # from the largest chance down
            least -= 1 / k
            n = F.when(below(h, 9, least / total), F.lit(k - 1)).otherwise(n)
        return F.struct(F.substring(h, 1, 8).alias("order"), i.alias("i"), n.alias("n"))
    free = lambda i: ~F.get(a, i).isin(*SPECIAL_IDS)
    places = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i < F.size(a)) & (i >= 0) & free(i))
    # an array of one hash binds it: it is worked out once a place
    draws = F.transform(places, lambda i: F.transform(F.array(hashed(i)), lambda h: draw(h, i))[0])

    def covered(d):
        most = F.greatest(F.lit(1), F.rint(F.lit(budget) * F.size(d)).cast("int"))

        def visit(have, x):
            more = F.filter(F.sequence(x["i"], x["i"] + x["n"] - 1),
                            lambda j: (j < F.size(a)) & free(j) & ~F.array_contains(have, j))
            return F.when((F.size(have) >= most) | F.array_contains(have, x["i"]), have).otherwise(F.concat(have, more))
        return F.aggregate(F.sort_array(d), F.array().cast("array<int>"), visit)

    def result(hit):
        def new(h, x):
            v = F.conv(F.substring(h, 25, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
            any_id = (F.lit(VOCAB_BASE) + F.floor(v * (F.lit(vocab_size) - VOCAB_BASE))).cast("int")
            return F.when(below(h, 17, 0.8), F.lit(MASK_ID)).when(below(h, 17, 0.9), x).otherwise(any_id)

        def one(x, i):  # only a covered place is hashed again
            return F.when(~F.array_contains(hit, i), x).otherwise(F.transform(F.array(hashed(i)), lambda h: new(h, x))[0])
        return F.struct(F.transform(a, one).alias("input_ids"),
                        F.transform(a, lambda x, i: F.when(F.array_contains(hit, i), x).otherwise(F.lit(IGNORE_LABEL))).alias("labels"))
    bound = F.transform(F.array(draws), covered)  # worked out once
    return F.transform(bound, result)[0]


def sample_positions(n: Column, k: int) -> Column:
    """Evenly spaced positions of ``k`` samples among ``n`` items: ``rint(j * n / k)``
    while below ``n``; all positions when ``k >= n``."""
    step = n.cast("double") / F.lit(k)
    idx = F.transform(F.sequence(F.lit(0), F.lit(k)), lambda j: F.rint(j * step).cast("int"))
    return F.when(n <= k, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))) \
        .otherwise(F.array_distinct(F.filter(idx, lambda x: x < n)))


def sigmoid(c) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return 1 / (1 + F.exp(-x))


def softmax(c) -> Column:
    """Softmax of an array column, shifted by its maximum so that no exponential overflows."""
    x = F.transform((F.col(c) if isinstance(c, str) else c).cast("array<double>"), lambda v: v)
    e = F.transform(F.array(F.array_max(x)), lambda m: F.transform(x, lambda v: F.exp(v - m)))[0]
    return F.transform(F.array(e), lambda y: F.transform(y, lambda v: v / F.aggregate(y, F.lit(0.0), lambda a, z: a + z)))[0]
