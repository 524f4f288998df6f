"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Words are runs of letters, digits and characters above 0x7F, lower-cased.  A word's input
joins an embedding of the word (hashed) with the mean embeddings of its character 3- and
4-grams and of its beginnings of 2 to 7 bytes.  A text is cut into windows of ``WINDOW``
words that overlap; the network reads each in both directions, attention pools its states
into one logit, and the text's score comes from its highest and its third highest window.

The network is fitted in one task on a bounded sample: ``max_rows`` labelled rows at most,
a third of them toxic at most, by a hash of the id, and ``MOST_WINDOWS`` windows of each.
Embeddings start from how much oftener than by chance a feature stands in toxic rows.
Windows of a toxic text need not be toxic: training takes the two that look worst, first by
those embeddings and later by the network.  A fifth of the sample is held back to place
the scores, so that 0.7 lies between the labels.

Scoring is a map over whole texts, every window of each, without a shuffle.  A null text,
like one without a word, scores 0.  Very long texts are scored in slices of windows.  Rows
with a null label are not learned from; of several labels of an id the highest counts.  A
null doc_id is scored like any other.  Ties in the sample's order go by id and text.
Repeated rows give repeated results; other columns, whatever their names, are ignored; an
empty table gives an empty result; without rows of both labels every score is 0.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .arrow import arrow_schema, record_batch, small_batches
from .common import spread
from .ranked_search import terms_of

WINDOW, STRIDE = 64, 48
BITS, DIM, HIDDEN = 13, 4, 8  # buckets of each embedding table, and its width
TABLES = ("word", "gram", "head")
ROWS = 1024
SLICE = 4096  # windows read at once
MOST_WINDOWS = 64
LIMIT = 0.7


# -- inputs -------------------------------------------------------------------

def features(names: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each table: buckets of the words' features, and the word each belongs to."""
    raw = [b" " + w.lower().encode("utf-8", "surrogatepass") for w in names]
    data = np.frombuffer(b"".join(raw) + b" ", dtype=np.uint8)
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(names)), sizes)
    x = data.astype(np.uint64)

    def bucket(h):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - BITS)).astype(np.int64)

    inner = data[:-1] != 32  # the last blank only ends the last word
    grams, owners, h = [], [], x
    heads, head_owners = [], []
    for n in range(2, 8):
        if len(x) < n:
            break
        h = h[:len(x) - n + 1] * np.uint64(0x100000001B3) + x[n - 1:] + np.uint64(n)
        if n in (3, 4):  # one blank at either end is part of it
            ok = inner[1:len(x) - n + 2].copy()
            for k in range(2, n - 1):
                ok &= inner[k:len(x) - n + 1 + k]
            at = np.flatnonzero(ok)
            grams.append(bucket(h[at]))
            owners.append(owner[at + 1])
        some = np.flatnonzero(sizes >= n)
        heads.append(bucket(h[begin[some]]))
        head_owners.append(some)
    whole = np.zeros(len(names), dtype=np.uint64)
    if len(names):
        place = np.arange(len(data) - 1) - np.repeat(begin, sizes)
        power = np.multiply.accumulate(np.concatenate([[1], np.full(int(sizes.max()), 0x9E3779B97F4A7C15 | 5)]).astype(np.uint64))
        whole = np.add.reduceat(x[:-1] * power[place], begin)
    out = {"word": (bucket(whole), np.arange(len(names)))}
    for name, b, o in (("gram", grams, owners), ("head", heads, head_owners)):
        out[name] = (np.concatenate(b), np.concatenate(o)) if b else (np.zeros(0, np.int64),) * 2
    return out


def inputs(tables: dict[str, np.ndarray], of: dict, n: int) -> np.ndarray:
    """Input rows of n words, after a row of zeros for padding."""
    out = np.zeros((n + 1, DIM * len(TABLES)), dtype=np.float32)
    for k, name in enumerate(TABLES):
        bucket, owner = of[name]
        count = np.maximum(np.bincount(owner, minlength=n), 1)
        for d in range(DIM):
            out[1:, k * DIM + d] = np.bincount(owner, weights=tables[name][bucket, d], minlength=n) / count
    return out


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and text of each window; texts of ``sizes`` words stand one after another."""
    count = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    first = np.minimum(k * STRIDE, np.maximum(0, sizes[owner] - WINDOW))  # the last ends with the text
    return first + (np.cumsum(sizes) - sizes)[owner], owner


def places(numbers: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Word places of windows; 0 behind a text's end."""
    at = first[:, None] + np.arange(WINDOW)
    out = np.take(numbers, at, mode="clip") + 1
    if len(first) and (at[:, -1] >= end).any():
        out[at >= end[:, None]] = 0
    return out


def two_highest(logit: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The highest logit of each text, and its third highest (or lowest, if there are fewer)."""
    out = np.full((n, 2), -np.inf)
    order = np.lexsort((-logit, owner))
    count = np.bincount(owner, minlength=n)
    some, begin = count > 0, np.cumsum(count) - count
    out[some, 0] = logit[order[begin[some]]]
    out[some, 1] = logit[order[begin[some] + np.minimum(2, count[some] - 1)]]
    return out


# -- training, in one task ----------------------------------------------------

def surprise(of: dict, name: str, doc: np.ndarray, word: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """For each bucket: standard errors by which it stands in more toxic texts than by chance."""
    bucket, owner = of[name]
    order = np.argsort(owner, kind="stable")
    bucket, count = bucket[order], np.bincount(owner, minlength=int(word.max()) + 1 if len(word) else 0)
    begin = np.cumsum(count) - count
    n = count[word]
    at = np.repeat(begin[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    pair = np.unique(np.repeat(doc, n) << np.int64(BITS) | bucket[at])
    d, b = pair >> BITS, pair & (1 << BITS) - 1
    seen, bad = (np.bincount(b, weights=x, minlength=1 << BITS) for x in (np.ones(len(b)), toxic[d]))
    rate = toxic.mean()
    return (bad - rate * seen) / np.sqrt(rate * (1 - rate) * seen + 1)


def fit(texts: list[str], toxic: np.ndarray, steps: int = 260, batch: int = 128, seed: int = 5) -> dict | None:
    """Parameters of the network and of the scale; texts in a fixed order."""
    rng = np.random.default_rng(seed)
    numbers, distinct, doc = terms_of(pa.array(texts, pa.string()))
    names = distinct.to_pylist()
    of, n_docs = features(names), len(texts)
    held = np.zeros(n_docs, dtype=bool)
    for label in (0, 1):
        held[np.flatnonzero(toxic == label)[2::5]] = True
    learn = np.flatnonzero(~held)
    if not 0 < toxic[learn].sum() < len(learn) or not len(numbers):
        return None
    sizes = np.bincount(doc, minlength=n_docs)
    ends = np.cumsum(sizes)
    first, owner = windows(sizes)
    # an even choice of the windows of very long texts
    count = np.bincount(owner, minlength=n_docs)
    k = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    some = (k * MOST_WINDOWS // count[owner] != (k - 1) * MOST_WINDOWS // count[owner]) | (count[owner] <= MOST_WINDOWS)
    first, owner = first[some], owner[some]
    at = places(numbers, first, ends[owner])

    tables = {}
    mine = ~held[doc]
    pairs = np.unique(doc[mine] << np.int64(32) | numbers[mine])
    for name in TABLES:
        z = surprise(of, name, pairs >> 32, pairs & 0xFFFFFFFF, toxic.astype(float))
        tables[name] = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
        tables[name][:, 0] = np.clip(z, -6, 12) / 4
    p = gru.start(DIM * len(TABLES), HIDDEN, rng)
    rows = inputs(tables, of, len(names))
    looks = np.maximum(rows[:, 0] + rows[:, DIM] + rows[:, 2 * DIM] - 1, 0)[at].sum(axis=1)
    state = {**p, **{f"table-{k}": v for k, v in tables.items()}}
    adam = gru.Adam(state, rate=0.01)
    flat = {k: (b[np.argsort(o, kind="stable")], np.bincount(o, minlength=len(names))) for k, (b, o) in of.items()}
    begin = {k: np.cumsum(c) - c for k, (_, c) in flat.items()}

    def choose():
        """Windows to learn: the two worst of each text, and any one of the clean ones."""
        order = np.lexsort((rng.random(len(owner)), -looks, owner))
        count = np.bincount(owner[order], minlength=n_docs)
        rank = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)
        own = order[(rank < 2) & ~held[owner[order]]]
        free = rng.permutation(len(owner))[:4 * len(learn)]
        free = free[~held[owner[free]] & (toxic[owner[free]] == 0)]
        bad = toxic[owner[own]] == 1
        return own[bad], np.concatenate([own[~bad], free])

    def step(i):
        used, local = np.unique(at[i], return_inverse=True)
        local = local.reshape(len(i), -1)
        if used[0] != 0:
            used, local = np.concatenate([[0], used]), local + 1
        word = used[1:] - 1
        rows, take = np.zeros((len(used), DIM * len(TABLES)), np.float32), {}
        for k, name in enumerate(TABLES):
            n = flat[name][1][word]
            spot = np.repeat(begin[name][word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            take[name] = flat[name][0][spot], np.repeat(np.arange(len(word)), n), np.maximum(n, 1)
            for d in range(DIM):
                rows[1:, k * DIM + d] = np.bincount(take[name][1], weights=tables[name][take[name][0], d],
                                                    minlength=len(word)) / take[name][2]
        kept, y = {}, toxic[owner[i]].astype(np.float32)
        logit = gru.forward(p, rows, local, kept)
        grads, d_rows = gru.backward(p, rows, local, kept, ((gru.sigmoid(logit) - y) / len(i)).astype(np.float32))
        for k, name in enumerate(TABLES):
            bucket, mine, n = take[name]
            part = d_rows[1:, k * DIM:(k + 1) * DIM] / n[:, None]
            g = np.zeros_like(tables[name])
            for d in range(DIM):
                g[:, d] = np.bincount(bucket, weights=part[mine, d], minlength=1 << BITS)
            grads[f"table-{name}"] = g
        adam.step(grads)

    for turn in range(3):
        bad, clean = choose()
        for _ in range(steps // 3):
            step(np.concatenate([rng.choice(bad, batch // 2), rng.choice(clean, batch // 2)]))
        rows = inputs(tables, of, len(names))
        looks = np.concatenate([gru.forward(p, rows, at[a:a + SLICE]) for a in range(0, len(at), SLICE)])
    high = two_highest(looks, owner, n_docs)
    test = held & (sizes > 0)
    if not 0 < toxic[test].sum() < test.sum():
        test = sizes > 0
    return {**p, **{f"table-{k}": v for k, v in tables.items()}, "scale": scale(high[test], toxic[test])}


def scale(high: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Weights of the two logits, then where the scores are LIMIT: a logistic regression, and
    the middle of the widest gap among the best cuts."""
    x = np.clip(np.column_stack([high, np.ones(len(high))]), -20, 20)
    w, weight = np.array([1.0, 0.3, 0.0]), np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (1 - toxic).sum())
    for _ in range(500):
        w -= 0.5 * x.T @ (weight * (gru.sigmoid(x @ w) - toxic)) + 0.001 * w * [1, 1, 0]
        w[:2] = np.maximum(w[:2], 0)
    value = x[:, :2] @ w[:2]
    order = np.argsort(value, kind="stable")
    v, y = value[order], toxic[order]
    # errors of the cut below each place: the share of clean rows above it weighs three times that of toxic ones below
    missed, wrong = np.concatenate([[0], np.cumsum(y)]), np.concatenate([[0], np.cumsum(1 - y)])
    cost = missed / max(1, y.sum()) + 3 * (wrong[-1] - wrong) / max(1, wrong[-1])
    edge = np.concatenate([[v[0] - 1], (v[1:] + v[:-1]) / 2, [v[-1] + 1]])
    gap = np.concatenate([[0], np.diff(v), [0]])
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    cut = edge[best[gap[best].argmax()]]
    return np.array([w[0], w[1], np.log(LIMIT / (1 - LIMIT)) - cut])


def train(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = 6000, steps: int = 260) -> dict | None:
    """Model from rows of ``docs`` (doc_id, text) with a ``toxic`` label in ``labels``, where
    ``learn`` (over doc_id) holds."""
    marked = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
              .filter(learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    order = [F.xxhash64(F.lit("toxic"), "doc_id"), "doc_id"]
    picked = marked.filter("toxic = 1").orderBy(*order).limit(max_rows // 3).unionByName(
        marked.filter("toxic = 0").orderBy(*order).limit(max_rows - max_rows // 3))
    schema = "model binary"
    kind = arrow_schema(schema)

    def run(batches):
        rows = []
        for b in batches:
            rows += zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("toxic").to_pylist())
        rows.sort()
        model = fit([r[1] for r in rows], np.array([r[2] for r in rows]), steps) if rows else None
        if model is not None:
            out = io.BytesIO()
            np.savez(out, **model)
            yield record_batch(kind, {"model": [out.getvalue()]})

    # at most max_rows ids: a bounded broadcast, and a bounded sample for the one task that fits
    sample = docs.select("doc_id", "text").filter("text IS NOT NULL")
    sample = sample.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")
    found = small_batches(sample.repartition(1)).mapInArrow(run, schema).collect()
    if not found:
        return None
    with np.load(io.BytesIO(found[0]["model"])) as f:
        return dict(f)


# -- scoring ------------------------------------------------------------------

def score_texts(model: dict, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of windows of each text."""
    numbers, distinct, doc = terms_of(texts)
    n = len(texts)
    sizes = np.bincount(doc, minlength=n)
    if not len(numbers):
        return np.zeros(n), np.zeros(n, dtype=np.int64)
    names = distinct.to_pylist()
    rows = inputs({k: model[f"table-{k}"] for k in TABLES}, features(names), len(names))
    first, owner = windows(sizes)
    ends = np.cumsum(sizes)[owner]
    # windows that are not full come last, so that few slices need padding
    order = np.argsort(ends - first < WINDOW, kind="stable")
    first, owner, ends = first[order], owner[order], ends[order]
    logit = np.concatenate([
        gru.forward(model, rows, places(numbers, first[a:a + SLICE], ends[a:a + SLICE])) for a in range(0, len(first), SLICE)])
    a, b, c = model["scale"]
    high = np.clip(two_highest(logit, owner, n), -20, 20)
    return np.where(sizes > 0, gru.sigmoid(high @ [a, b] + c), 0.0), np.bincount(owner, minlength=n)


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score, n_windows: a row for each row of ``docs``."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, score double, n_windows long"
    kind = arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                if model is None:
                    value, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64)
                else:
                    value, n = score_texts(model, batch.column("text"))
                yield record_batch(kind, {"doc_id": batch.column("doc_id"), "score": value, "n_windows": n})

    return small_batches(spread(docs.select("doc_id", "text")), ROWS).mapInArrow(run, schema)
