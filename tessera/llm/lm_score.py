"""Scoring texts with a log-bilinear neural model trained by noise-contrastive estimation.

Tokens are lower-cased words and one end a text.  A count pass over all training texts
gives every word's frequency.  The model predicts a token's class from the classes of the
``CONTEXT`` tokens before it: context embeddings, weighted by position, add up to a
predicted embedding, whose products with the class embeddings go through a softmax.  The
most frequent words are classes of their own, ``TOP`` or as many as the square root of the
number of distinct words if that is more; other words share ``SUFFIXES`` classes by their
last two bytes, and within a class the smoothed word frequencies hold; so token
probabilities are normalised over all words, unseen ones included.

Training is numpy in the tasks: from a common start (fitted in the driver on a bounded
sample of ``start_rows`` texts) every task runs minibatch noise-contrastive estimation
over all its training texts, and Spark averages the parameters, weighted by tokens.
Scoring sums the softmax of the distinct contexts of some texts over all classes.  The
exponential of a sum is the product of the context tokens' own exponentials: these are worked
out once a class and position for the texts, and multiplied for each context.  Contexts whose
factors leave the safe range of float32, or that are few, go by the products of embeddings.
Training and scoring multiply in float32; parameters are float64.

Word counts reach the texts in two ways at every size: words above a frequency at which
at most ``KNOWN`` remain are broadcast; the others, a small share of the tokens, are
joined by word and added up by document.  Words are addressed by 128-bit hashes.

Texts are taken whole: a batch holds ``BYTES`` of text (scoring: 8 times that) or one text, whose tokens are then
learned ``TOKENS`` and scored ``SCORED`` at a time.  Ties of counts go by the words' hashes; other
columns, whatever their names, are ignored.  A null text is empty: one end token.  A null doc_id is scored like any other.  Repeated
rows are each learned from and each scored.  With no training text every token has the
same smoothed probability.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

from . import shingle
from .arrow import arrow_schema, map_rows, record_batch, slices, small_batches
from .common import keyed, same_document, spread

TOP, SUFFIXES, CONTEXT, DIM = 127, 128, 3, 24
CLASSES = 1 + SUFFIXES + TOP  # of a small vocabulary: the end, shared classes, words of their own
PAD = -1  # before the first token; context only
KNOWN = 400_000
SMOOTH = 0.1
END = np.uint64(1)
BATCH, NOISE = 4096, 128
CELLS = 1 << 18  # products of contexts and classes held at a time
ROWS, BYTES = 64, 1 << 18  # texts whose tokens are held at a time, and bytes of them (or one text)
TOKENS = 1 << 16  # tokens of one text that are worked on at a time
SCORED = 1 << 19  # tokens whose contexts are scored together
WIDTH, BLOCK = 512, 512  # classes whose factors are held at a time; contexts multiplied at a time
FAR, STEEP = 20.0, 40.0  # the largest exponents of a factor and of a class's own share that are multiplied
LEAST, MOST = 1e-28, 1e30  # sums outside may have lost terms to float32


# -- tokens -------------------------------------------------------------------

def tokens(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Both hashes and the suffix number of all tokens of some texts, and tokens a text."""
    raws = [shingle.lower(t or "") for t in texts]
    raw = b"\n".join(raws)  # words end there
    data = np.frombuffer(raw, dtype=np.uint8)
    starts, ends = shingle.word_bounds(data)
    begins = np.cumsum([0] + [len(r) + 1 for r in raws])
    sizes = np.diff(np.searchsorted(starts, begins)) + 1
    before = np.where(ends - starts > 1, data[ends - 2], 0).astype(np.int64)
    suffix = (data[ends - 1].astype(np.int64) * 31 + before * 7) % SUFFIXES
    end = np.zeros(int(sizes.sum()), dtype=bool)
    end[np.cumsum(sizes) - 1] = True
    out = []
    for words, last in zip((*shingle.word_hashes(raw, both=True, bounds=(starts, ends)), suffix), (END, END, 0)):
        col = np.full(len(end), last, dtype=words.dtype)
        col[~end] = words
        out.append(col)
    return *out, sizes


def contexts(classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Classes of the CONTEXT tokens before each token, the nearest first."""
    place = np.arange(len(classes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.full((len(classes), CONTEXT), PAD)
    for k in range(CONTEXT):
        some = place > k
        out[some, k] = classes[np.flatnonzero(some) - k - 1]
    return out


# -- model --------------------------------------------------------------------

def start(noise: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    rng, classes = np.random.default_rng(seed), len(noise)
    # the first row of the context embeddings is that of PAD
    return {"context": rng.normal(0, 0.3, (classes + 1, DIM)), "weight": np.ones((CONTEXT, DIM)) / CONTEXT,
            "target": rng.normal(0, 0.1, (classes, DIM)), "bias": np.log(noise)}


def flat(model: dict) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in ("context", "weight", "target", "bias")])


def unflat(x: np.ndarray, classes: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in (("context", (classes + 1, DIM)), ("weight", (CONTEXT, DIM)), ("target", (classes, DIM)),
                        ("bias", (classes,))):
        size = int(np.prod(shape))
        out[name] = x[at:at + size].reshape(shape).copy()
        at += size
    return out


class RowSums:
    """Sums of rows by index, in arrays that are kept: new ones of a batch cost more than the sums."""

    def __init__(self):
        self.places, self.doubles = np.empty((BATCH, DIM), dtype=np.int64), np.empty((BATCH, DIM))

    def __call__(self, index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        places, doubles = self.places[:len(index)], self.doubles[:len(index)]
        np.add((index * DIM)[:, None], np.arange(DIM), out=places)
        doubles[:] = rows
        return np.bincount(places.ravel(), weights=doubles.ravel(), minlength=n * DIM).reshape(n, DIM)


def _keep_memory() -> None:
    """The C library hands arrays of some MB back to the system and fetches them anew for every batch,
    until an array of this size was freed once; it then keeps up to twice that."""
    np.empty(24 << 20, dtype=np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place: copies of a batch's products cost more than the arithmetic."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive estimation with per-parameter step sizes (Adagrad)."""

    def __init__(self, model: dict, noise: np.ndarray, seed: int, rate: float = 0.1):
        self.model = {k: v.copy() for k, v in model.items()}
        self.squares = {k: np.full_like(v, 0.1) for k, v in model.items()}
        self.noise, self.rate, self.rng = noise, rate, np.random.default_rng(seed)
        self.log_noise = np.log(noise) + np.log(NOISE)
        self.rows_sum, self.fake = RowSums(), np.empty((BATCH, NOISE), dtype=np.float32)
        self.seen = 0

    def learn(self, ctx: np.ndarray, target: np.ndarray) -> None:
        for first in range(0, len(target), TOKENS):
            order = first + self.rng.permutation(min(TOKENS, len(target) - first))
            for at in range(0, len(order), BATCH):
                i = order[at:at + BATCH]
                self._step(ctx[i], target[i])
        self.seen += len(target)

    def _step(self, ctx: np.ndarray, target: np.ndarray) -> None:
        m, n, classes = {k: v.astype(np.float32) for k, v in self.model.items()}, len(target), len(self.noise)
        drawn = self.rng.choice(classes, NOISE, p=self.noise)  # shared by the batch
        given = [m["context"].take(ctx[:, k] + 1, axis=0) for k in range(CONTEXT)]
        guess = sum(given[k] * m["weight"][k] for k in range(CONTEXT))
        hit, wrong = m["target"][target], m["target"][drawn]
        level = (self.model["bias"] - self.log_noise).astype(np.float32)
        data = (guess * hit).sum(axis=1) + level[target]
        fake = np.matmul(guess, wrong.T, out=self.fake[:n])
        fake += level[drawn]
        up, down = _sigmoid(data) - 1, _sigmoid(fake)
        back = up[:, None] * hit + down @ wrong
        grads = {
            "target": self.rows_sum(target, up[:, None] * guess, classes) + self.rows_sum(drawn, down.T @ guess, classes),
            "bias": np.bincount(target, weights=up, minlength=classes)
            + np.bincount(drawn, weights=down.sum(axis=0), minlength=classes),
            "weight": np.stack([(back * g).sum(axis=0, dtype=np.float64) for g in given]),
            "context": sum(self.rows_sum(ctx[:, k] + 1, back * m["weight"][k], classes + 1) for k in range(CONTEXT)),
        }
        for name, g in grads.items():
            g = g / n * classes ** 0.5
            self.squares[name] += g * g
            self.model[name] -= self.rate * g / np.sqrt(self.squares[name])


def _guesses(context: np.ndarray, weight: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """The predicted embedding of each context."""
    guess = np.zeros((len(ctx), DIM), dtype=np.float32)
    for k in range(ctx.shape[1]):
        given = context.take(ctx[:, k] + 1, axis=0)
        given *= weight[k]
        guess += given
    return guess


def _sums_by_factors(context: np.ndarray, weight: np.ndarray, to: np.ndarray, bias: np.ndarray, ctx: np.ndarray,
                     rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum over all classes of the exponentials for each context, and whether it is to be trusted.
    ``rows``: the distinct context embeddings at each position, and each context's among them."""
    total = np.zeros(len(ctx))
    far = [np.zeros(len(r), dtype=bool) for r, _ in rows]
    held = np.empty((3, BLOCK * WIDTH), dtype=np.float32)
    blocks = []  # neighbours that differ in the last position alone share the product of the others
    for at in range(0, len(ctx), BLOCK):
        part = ctx[at:at + BLOCK, :-1]
        new = np.ones(len(part), dtype=bool)
        new[1:] = (part[1:] != part[:-1]).any(axis=1)
        blocks.append(([w[at:at + BLOCK][new] for _, w in rows[:-1]], np.cumsum(new) - 1, rows[-1][1][at:at + BLOCK]))

    def take(table, index, at):
        return table.take(index, axis=0, mode="clip", out=held[at, :len(index) * table.shape[1]].reshape(len(index), -1))

    with np.errstate(over="ignore", invalid="ignore"):
        for a in range(0, len(to), WIDTH):
            across, factors = np.ascontiguousarray(to[a:a + WIDTH].T), []
            for k, (r, _) in enumerate(rows):
                part = (context[r] * weight[k]) @ across
                far[k] |= ~((part.max(axis=1) <= FAR) & (part.min(axis=1) >= -FAR))
                if k == 0:
                    part += bias[a:a + WIDTH]
                factors.append(np.exp(part, out=part))
            for at, (heads, shared, last) in zip(range(0, len(ctx), BLOCK), blocks):
                head = take(factors[0], heads[0], 0)
                for k in range(1, len(heads)):
                    head *= take(factors[k], heads[k], 1)
                total[at:at + BLOCK] += np.vecdot(take(head, shared, 1), take(factors[-1], last, 2))
    trusted = (total > LEAST) & (total < MOST)
    for f, (_, which) in zip(far, rows):
        trusted &= ~f[which]
    return total, trusted


def _log_sums(context: np.ndarray, weight: np.ndarray, to: np.ndarray, bias: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """Logarithm of the sum over all classes of the exponentials, for each of some distinct contexts."""
    out, left = np.empty(len(ctx)), np.arange(len(ctx))
    rows = [np.unique(ctx[:, k] + 1, return_inverse=True) for k in range(ctx.shape[1])]
    if len(rows) > 1 and 2 * sum(len(r) for r, _ in rows) < len(ctx) and np.abs(bias).max() <= STEEP:
        total, trusted = _sums_by_factors(context, weight, to, bias, ctx, rows)
        out[trusted], left = np.log(total[trusted]), np.flatnonzero(~trusted)
    step, across = max(1, CELLS // len(to)), np.ascontiguousarray(to.T)
    for at in range(0, len(left), step):
        i = left[at:at + step]
        logits = _guesses(context, weight, ctx[i]) @ across
        logits += bias
        most = logits.max(axis=1)
        logits -= most[:, None]
        out[i] = most + np.log(np.exp(logits, out=logits).sum(axis=1))
    return out


def log_probabilities(model: dict, ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Normalised log10 probability of each class in its context; each distinct context is summed once."""
    context, weight = model["context"].astype(np.float32), model["weight"].astype(np.float32)
    to, bias = model["target"].astype(np.float32), model["bias"].astype(np.float32)
    if len(target) > SCORED:
        return np.concatenate([log_probabilities(model, ctx[a:a + SCORED], target[a:a + SCORED])
                               for a in range(0, len(target), SCORED)])
    key = np.zeros(len(ctx), dtype=np.int64)
    for k in range(ctx.shape[1]):
        key = key * len(context) + ctx[:, k] + 1
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    out = -_log_sums(context, weight, to, bias, ctx[first])[which]
    for at in range(0, len(target), BATCH):
        mine = target[at:at + BATCH]
        guess = _guesses(context, weight, ctx[at:at + BATCH])
        out[at:at + BATCH] += np.einsum("bd,bd->b", guess, to.take(mine, axis=0)) + bias[mine]
    return out / np.log(10)


# -- counts -------------------------------------------------------------------

def word_counts(docs: DataFrame) -> DataFrame:
    """h1, h2, suffix, n of every distinct token of ``docs``."""
    def run(texts):
        h1, h2, suffix, _ = tokens(texts)
        word, first, n = np.unique(h1, return_index=True, return_counts=True)
        return {"h1": shingle.signed(word), "h2": shingle.signed(h2[first]), "suffix": suffix[first], "n": n}

    return (map_rows(docs, run, ["text"], "h1 long, h2 long, suffix int, n long", rows=8 * ROWS, most_bytes=8 * BYTES)
            .groupBy("h1", "h2").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("n")))


class Counts:
    """Totals, the broadcast words and the classes."""

    def __init__(self, counts: DataFrame, known: int):
        level = F.floor(F.log2("n") * 8)
        steps = counts.groupBy(level.alias("level"), "suffix").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
        self.total, self.distinct = sum(r["n"] for r in steps), sum(r["words"] for r in steps)
        self.least, have = None, 0
        for at in sorted({r["level"] for r in steps}, reverse=True):
            have += sum(r["words"] for r in steps if r["level"] == at)
            if have > known:
                break
            self.least = at
        end = (F.col("h1") == int(END)) & (F.col("h2") == int(END))
        self.ends = sum(r["n"] for r in counts.filter(end).collect())
        rows = counts.filter((level >= F.lit(self.least if self.least is not None else 1 << 30)) & ~end).toArrow()
        self.h1, self.h2 = (rows[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2"))
        order = np.lexsort((self.h2, self.h1))
        self.h1, self.h2 = self.h1[order], self.h2[order]
        self.n, suffix = (rows[c].to_numpy().astype(np.int64)[order] for c in ("n", "suffix"))
        self.top = np.lexsort((self.h2, self.h1, -self.n))[:max(TOP, int(self.distinct ** 0.5))]
        self.n_classes, own = 1 + SUFFIXES + len(self.top), slice(1 + SUFFIXES, None)
        self.classes = 1 + suffix
        self.classes[self.top] = np.arange(self.n_classes)[own]
        # tokens and words of each class
        self.class_n, self.class_words = np.zeros(self.n_classes), np.zeros(self.n_classes)
        for r in steps:
            self.class_n[1 + r["suffix"]] += r["n"]
            self.class_words[1 + r["suffix"]] += r["words"]
        for n, at in [(self.ends, 1), *zip(self.n[self.top], 1 + suffix[self.top])]:  # the end has suffix 0
            self.class_n[at] -= n
            self.class_words[at] -= n > 0
        self.class_n[0], self.class_n[own] = self.ends, self.n[self.top]
        self.single = np.zeros(self.n_classes, dtype=bool)
        self.single[0] = self.single[own] = True

    def find(self, h1: np.ndarray, h2: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, ...]:
        """Class of each token, its count, and whether that is known here (ends are)."""
        classes, n, known = 1 + suffix, np.zeros(len(h1)), np.zeros(len(h1), dtype=bool)
        if len(self.h1):
            at = np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)
            known = (self.h1[at] == h1) & (self.h2[at] == h2)
            classes, n = np.where(known, self.classes[at], classes), np.where(known, self.n[at], n)
        end = (h1 == END) & (h2 == END)
        return np.where(end, 0, classes), np.where(end, self.ends, n), known | end

    def classify(self, h1: np.ndarray, h2: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """Class of each token: only the words that are classes of their own are looked up."""
        classes = np.where((h1 == END) & (h2 == END), 0, 1 + suffix)
        if len(self.top):
            order = np.sort(self.top)  # places in h1, so in order of h1
            at = order[np.minimum(np.searchsorted(self.h1[order], h1), len(order) - 1)]
            classes = np.where((self.h1[at] == h1) & (self.h2[at] == h2), self.classes[at], classes)
        return classes

    def noise(self) -> np.ndarray:
        p = self.class_n + 1
        return p / p.sum()


# -- operator -----------------------------------------------------------------

def fit(train: DataFrame, counts: Counts, start_rows: int = 200) -> dict[str, np.ndarray]:
    """The averaged model."""
    noise = counts.noise()

    def classes_of(texts):
        h1, h2, suffix, sizes = tokens(texts)
        return counts.classify(h1, h2, suffix), sizes

    first = train.select("doc_id", "text").orderBy(F.xxhash64(F.lit("start"), "doc_id"), "doc_id", "text").limit(start_rows)

    def sample(texts):  # an even draw of places of each text, 4096 at most
        classes, sizes = classes_of(texts)
        ctx = contexts(classes, sizes)
        at = np.unique(np.concatenate([np.linspace(a, a + n - 1, min(n, 4096)).astype(int)
                                       for a, n in zip(np.cumsum(sizes) - sizes, sizes)]))
        return {"target": classes[at], "ctx": list(ctx[at])}

    warm = start(noise)
    rows = map_rows(first, sample, ["text"], "target int, ctx array<int>", rows=ROWS, most_bytes=BYTES).toArrow()
    if not rows.num_rows:
        return warm
    ctx = np.concatenate([c.flatten().to_numpy() for c in rows["ctx"].chunks]).reshape(-1, CONTEXT).astype(np.int64)
    target = rows["target"].to_numpy().astype(np.int64)
    order = np.lexsort((*ctx.T, target))  # the sample's rows come in any order
    trainer = Trainer(warm, noise, seed=1, rate=0.2)
    for _ in range(max(1, min(40, 2_000_000 // len(target)))):
        trainer.learn(ctx[order], target[order])
    warm = trainer.model

    schema = "place int, part double, weight double"
    kind = arrow_schema(schema)

    def run(batches):
        _keep_memory()
        trainer = Trainer(warm, noise, seed=2, rate=0.05)
        for batch in batches:
            for part in slices(batch, ROWS, BYTES):
                classes, sizes = classes_of(part.column("text").to_pylist())
                trainer.learn(contexts(classes, sizes), classes)
        if trainer.seen:
            x = flat(trainer.model)
            yield record_batch(kind, {"place": np.arange(len(x)), "part": x * trainer.seen,
                                      "weight": np.full(len(x), float(trainer.seen))})

    parts = small_batches(train.select("text")).mapInArrow(run, schema)
    mean = (parts.groupBy("place").agg((F.sum("part") / F.sum("weight")).alias("x")).toPandas()
            .sort_values("place")["x"].to_numpy())  # as many rows as the model has parameters
    return unflat(mean, counts.n_classes)


def score(docs: DataFrame, learn: Column, known: int = KNOWN) -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score, score; ``learn`` (over
    doc_id) says which documents are learned from."""
    whole = keyed(spread(docs))
    counted = materialize(word_counts(whole.filter(learn)), "lm-counts")
    counts = Counts(counted, known)
    model = fit(whole.filter(learn), counts)
    below = float(np.log10(counts.total + SMOOTH * (counts.distinct + 1)))
    single = counts.single
    class_below = np.where(single, 0, np.log10(counts.class_n + SMOOTH * (counts.class_words + 1)))

    def by_text(texts):
        _keep_memory()
        h1, h2, suffix, sizes = tokens(texts)
        classes, n, found = counts.find(h1, h2, suffix)
        ends = np.cumsum(sizes)
        # the count's logarithm of the others comes from the join
        own = np.where(found, np.log10(n + SMOOTH), 0)
        base = own - below
        whole_p = (log_probabilities(model, contexts(classes, sizes), classes) - class_below[classes]
                   + np.where(single[classes], 0, own))
        total = lambda x: np.add.reduceat(x, ends - sizes) if len(sizes) else x
        # the other words of each text, each with how often it stands there
        row = np.repeat(np.arange(len(sizes)), sizes)[~found]
        a, b = h1[~found], h2[~found]
        order = np.lexsort((b, a, row))
        a, b, row = a[order], b[order], row[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        word = pa.StructArray.from_arrays(
            [pa.array(shingle.signed(a[at])), pa.array(shingle.signed(b[at])), pa.array(np.diff(np.append(at, len(row))))],
            names=["h1", "h2", "times"])
        cuts = pa.array(np.searchsorted(row[at], np.arange(len(sizes) + 1)), pa.int32())
        return {"n_tokens": sizes, "n_known": total((found & (n > 0)).astype(np.int64)), "base": total(base),
                "model": total(whole_p), "others": pa.ListArray.from_arrays(cuts, word)}

    kind = dict(whole.dtypes)["doc_id"]
    state = materialize(map_rows(
        whole.select("doc_id", "text_key", "text"), by_text, ["text"],
        f"doc_id {kind}, text_key long, n_tokens long, n_known long, base double, model double, "
        "others array<struct<h1: long, h2: long, times: long>>", rows=8 * ROWS, most_bytes=8 * BYTES), "lm-state")
    # rows given several times are added up once and given back as often
    scored = state.groupBy("doc_id", "text_key").agg(
        F.count("*").alias("rows"), *[F.max(c).alias(c) for c in ("n_tokens", "n_known", "base", "model")])
    others = state.select("doc_id", "text_key", F.explode("others").alias("w")).select("doc_id", "text_key", "w.*")
    others = (others.join(counted.select("h1", "h2", "n"), ["h1", "h2"], "left")
              .groupBy("doc_id", "text_key").agg(
                  F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))).alias("more"),
                  F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known")))
    both = scored.join(others, same_document(scored, others), "left").select(
        scored["*"], F.coalesce(others["more"] / scored["rows"], F.lit(0.0)).alias("more"),
        F.coalesce((others["more_known"] / scored["rows"]).cast("long"), F.lit(0)).alias("more_known"))
    return both.withColumn("each", F.explode(F.sequence(F.lit(1), F.col("rows")))).select(
        "doc_id", learn.alias("learned"), "n_tokens", (F.col("n_known") + F.col("more_known")).alias("n_known"),
        F.lit(int(counts.total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more")).alias("base_score"), (F.col("model") + F.col("more")).alias("score"))
