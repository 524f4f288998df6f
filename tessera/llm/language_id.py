"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are the character 2-, 3- and 4-grams of lower-cased words (letters only, with
word ends), hashed into ``BUCKETS`` rows of an embedding table.  A document is the mean
of the embeddings of all its subwords; a linear layer and a softmax give the languages.
Embeddings and layer are trained together by minibatch stochastic gradient descent in
numpy.  A part of the sample is held back to calibrate: a temperature for the
probabilities, then the probability under which a prediction is rejected.

The classifier is fitted on a bounded sample of labelled rows, in one task: ``max_rows``
in all, shared evenly by all languages (8 rows of each at least), chosen by a hash of the
id; ties go by id and text.  Prediction is a map over whole texts, at any length, without a
shuffle.  Other columns, whatever their names, pass through or are ignored.  Nulls: a null text, like one without a letter, is
``und`` with score 0 and rejected; null labels are not learned from.  Repeated rows give
repeated results; an empty table, or one without labels, gives ``und`` everywhere.
"""

from __future__ import annotations

import io
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import arrow_schema, map_rows, record_batch, small_batches
from .common import spread

BITS, DIM, CHUNK = 12, 16, 1 << 20
BUCKETS = 1 << BITS
# multipliers of the n-gram hash (odd numbers)
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def subword_counts(text: str | None) -> np.ndarray | None:
    """How often each bucket's subwords stand in the whole text; None without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters, total = _letters(), np.zeros(BUCKETS)
    seen = False
    for at in range(0, len(points), CHUNK):  # a chunk owns the n-grams that begin in it
        own = points[at:at + CHUNK + 3]
        z = np.zeros(len(own) + 2, dtype=np.uint32)
        z[1:-1] = np.where(letters[own], own, 0)
        if at:
            z = z[1:]
        if at + CHUNK + 3 < len(points):
            z = z[:-1]
        seen = seen or bool(z.any())
        if len(z) < 2:
            continue
        last = min(len(z) - 1, CHUNK + (at == 0))
        h = z * MULTIPLIERS[0]
        for n in (2, 3, 4):
            m = len(z) - n + 1
            if m <= 0:
                break
            h = h[:m] + z[n - 1:] * MULTIPLIERS[n - 1]
            inner = (z[:m] | z[1:m + 1]) != 0 if n == 2 else z[1:m + 1] != 0
            if n == 4:
                inner &= z[2:m + 2] != 0
            m = min(m, last)
            mixed = (h[:m] ^ (h[:m] >> np.uint32(15))) * MULTIPLIERS[1] + np.uint32(n)
            total += np.bincount((mixed * MULTIPLIERS[2] >> np.uint32(32 - BITS))[inner[:m]], minlength=BUCKETS)
    return total if seen and total.any() else None


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, n_classes: int, epochs: int = 30, batch: int = 32, rate: float = 0.5,
        seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """SGD on the mean embedding and the softmax; returns bucket x class weights (embedding
    table times layer: the mean is linear) and the biases."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, n_classes), np.float32), np.zeros(n_classes, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            i = order[at:at + batch]
            mean = x[i] @ emb
            err = _softmax(mean @ layer + bias)
            err[np.arange(len(i)), y[i]] -= 1
            err /= len(i)
            back = err @ layer.T
            layer -= step * (mean.T @ err)
            bias -= step * err.sum(axis=0)
            emb -= step * BUCKETS / DIM * (x[i].T @ back)  # an entry moves with its share of the mean
    return emb @ layer, bias


def calibrate(logits: np.ndarray, y: np.ndarray, most_rejected: float = 0.001) -> tuple[float, float]:
    """Temperature of least log loss, and the least probability that is accepted: at most
    ``most_rejected`` of the right predictions lie under it, and it is a third at most, so
    that texts in two languages stay."""
    if not len(y):
        return 1.0, 1 / 3
    best = min((-np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean(), t)
               for t in np.geomspace(0.25, 8, 36))[1]
    p = _softmax(logits / best)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    return float(best), float(min(1 / 3, np.quantile(right, most_rejected))) if len(right) else 1 / 3


def fit_sample(rows: list[tuple]) -> dict[str, np.ndarray] | None:
    """Weights, biases, languages and least probability from rows of (id, text, lang), in any order."""
    found = [(str(i), lang, c) for i, text, lang in rows if (c := subword_counts(text)) is not None]
    if not found:
        return None
    found.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
    langs = sorted({r[1] for r in found})
    x = np.stack([(r[2] / r[2].sum()).astype(np.float32) for r in found])
    y = np.array([langs.index(r[1]) for r in found])
    held = np.arange(len(y)) % 5 == 0
    weights, bias = fit(x[~held], y[~held], len(langs))
    heat, least = calibrate(x[held] @ weights + bias, y[held])
    return {"langs": np.array(langs), "weights": weights.astype(np.float64) / heat,
            "bias": bias.astype(np.float64) / heat, "least": np.array(least)}


def train(docs: DataFrame, learn: Column | None = None, max_rows: int = 2400) -> dict | None:
    """Model from labelled rows of ``docs`` (``text``, ``lang``, ``doc_id``) where ``learn`` holds.
    One task fits the bounded sample; the driver gets the weights alone."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows if learn is None else rows.filter(learn)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return None
    share = max(8, max_rows // len(sizes))  # a class needs 8 rows or more
    draw = (F.xxhash64(F.lit("sample"), F.col("doc_id")).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53)))
    chance = F.create_map(*[F.lit(v) for k, n in sorted(sizes.items()) for v in (k, 1.5 * share / n + 0.001 * (n < 10_000))])
    near = (rows.select("doc_id", "text", "lang", draw.alias("draw"))
            .filter(F.col("draw") < F.element_at(chance, F.col("lang"))))
    each = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    picked = (near.withColumn("nth", F.row_number().over(each)).filter(F.col("nth") <= share)
              .select("doc_id", "text", "lang").repartition(1))
    schema = "model binary"
    kind = arrow_schema(schema)

    def run(batches):
        sample = [r for b in batches for r in zip(*(b.column(n).to_pylist() for n in ("doc_id", "text", "lang")))]
        model = fit_sample(sample)
        if model is not None:
            out = io.BytesIO()
            np.savez(out, **model)
            yield record_batch(kind, {"model": [out.getvalue()]})

    found = small_batches(picked).mapInArrow(run, schema).collect()
    if not found:
        return None
    with np.load(io.BytesIO(found[0]["model"])) as f:
        return {"langs": f["langs"].tolist(), "weights": f["weights"], "bias": f["bias"], "least": float(f["least"])}


def _classify(texts: list[str | None], model: dict | None) -> list[tuple[str, float, bool]]:
    out = []
    for text in texts:
        c = None if model is None else subword_counts(text)
        if c is None:
            out.append(("und", 0.0, True))
            continue
        p = _softmax(c @ model["weights"] / c.sum() + model["bias"])
        k = int(p.argmax())
        out.append((model["langs"][k], float(p[k]), bool(p[k] < model["least"])))
    return out


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, lang_score (calibrated), lang_rejected: a row for each row of ``docs``."""
    names = ("lang_pred", "lang_score", "lang_rejected")

    def run(texts):
        out = _classify(texts, model)
        return {n: [o[i] for o in out] for i, n in enumerate(names)}

    kind = dict(docs.dtypes)["doc_id"]
    return map_rows(spread(docs.select("doc_id", "text")), run, ["text"],
                    f"doc_id {kind}, lang_pred string, lang_score double, lang_rejected boolean")


def keep_recognised(docs: DataFrame, model: dict | None) -> DataFrame:
    """The rows of ``docs`` whose prediction is not rejected."""
    def run(batches):
        for batch in batches:
            out = _classify(batch.column(batch.schema.get_field_index("text")).to_pylist(), model)
            yield batch.filter(pa.array([not o[2] for o in out], pa.bool_()))

    return small_batches(spread(docs)).mapInArrow(run, docs.schema)
