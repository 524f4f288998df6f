"""Pooling of token vectors per group: masked mean / max / min, mean||max,
weighted layer average and attention (softmax-weighted) pooling.

Group aggregates use ``ml.stat.Summarizer`` on vectors: its buffer is one
vector per partition and group, merged map-side, so a group of any size costs
O(dim) memory and no row is exploded per dimension.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import join_null_safe


def _vec(col):
    return array_to_vector(F.col(col).cast("array<double>"))


def _unmasked(df: DataFrame, group_col: str, vec_col: str, mask_col: str, *metrics: str) -> DataFrame:
    """Every group with the metrics of its unmasked rows (null where it has none) and
    the length of its vectors.  The summarizer fails on a group of masked rows only, so
    it sees the others alone and the groups are joined back."""
    s = Summarizer.metrics(*metrics).summary(F.col("_v"))
    some = df.where(F.col(mask_col) != 0).select(group_col, _vec(vec_col).alias("_v")).groupBy(group_col).agg(s.alias("_s"))
    some = some.select(group_col, *[vector_to_array(F.col(f"_s.{m}")).alias(f"_{m}") for m in metrics])
    groups = df.groupBy(group_col).agg(F.max(F.size(vec_col)).alias("_dim"))
    return join_null_safe(groups, some, [group_col], "left")


def masked_pool(df: DataFrame, group_col: str, vec_col: str, mask_col: str, how: str = "mean") -> DataFrame:
    """Masked mean / max / min per group.

    Rows with mask 0 are skipped.  A group with no unmasked row gives zeros for the
    mean (the 1e-9 clamp of the original) and null for max / min.
    """
    g = _unmasked(df, group_col, vec_col, mask_col, how)
    out = F.col(f"_{how}")
    if how == "mean":
        out = F.coalesce(out, F.array_repeat(F.lit(0.0), F.col("_dim")))
    return g.select(group_col, out.alias("pooled"))


def mean_max_pool(df: DataFrame, group_col: str, vec_col: str, mask_col: str) -> DataFrame:
    """Concatenation of masked mean and masked max (one pass, two metrics); null for a
    group with no unmasked row."""
    g = _unmasked(df, group_col, vec_col, mask_col, "mean", "max")
    return g.select(group_col, F.concat("_mean", "_max").alias("pooled"))


def layer_pool(vec, n_layers: int, start_layer: int, weights) -> "F.Column":
    """Weighted average of layers ``start_layer..`` of a row's layer stack, the stack
    being ``n_layers`` equal slices of one array.  Weights are normalized."""
    v = F.col(vec) if isinstance(vec, str) else vec
    w = list(weights)[start_layer:n_layers]
    tot = float(sum(w))
    width = F.floor(F.size(v) / n_layers).cast("int")

    def at(layer, d):
        return F.try_element_at(v, (F.lit(layer) * width + d + 1).cast("int")).cast("double")
    return F.transform(F.sequence(F.lit(0), width - 1),
                       lambda d: sum((F.lit(wi / tot) * at(start_layer + i, d) for i, wi in enumerate(w)),
                                     F.lit(0.0)))


def dot(vec, weights) -> "F.Column":
    v = F.col(vec) if isinstance(vec, str) else vec
    a = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(v.cast("array<double>"), a, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def attention_pool(df: DataFrame, group_col: str, vec_col: str, mask_col: str, heads) -> DataFrame:
    """Multi-head attention pooling with supplied score vectors (one per head).

    Head h scores each row ``s = v . a_h``; masked rows are excluded (score -inf);
    the pooled vector is ``sum softmax(s) v`` within the group, heads concatenated.
    The softmax is a weighted mean with weights ``exp(s - max_group(s))``: only
    the group max is joined back, then one summarizer pass per head.
    """
    base = df.where(F.col(mask_col) != 0).select(group_col, vec_col)
    hs = range(len(heads))
    scored = base.select(group_col, vec_col, *[dot(vec_col, a).alias(f"_s{h}") for h, a in zip(hs, heads)])
    mx = scored.groupBy(group_col).agg(*[F.max(f"_s{h}").alias(f"_m{h}") for h in hs])
    w = join_null_safe(scored, mx, [group_col]).select(
        group_col, _vec(vec_col).alias("_v"), *[F.exp(F.col(f"_s{h}") - F.col(f"_m{h}")).alias(f"_w{h}") for h in hs])
    g = w.groupBy(group_col).agg(*[Summarizer.mean(F.col("_v"), F.col(f"_w{h}")).alias(f"_h{h}") for h in hs])
    g = g.select(group_col, F.concat(*[vector_to_array(F.col(f"_h{h}")) for h in hs]).alias("pooled"))
    return join_null_safe(df.select(group_col).distinct(), g, [group_col], "left")


def layer_attention_pool(df: DataFrame, group_col: str, vec_col: str, mask_col: str, heads, n_layers: int,
                         start_layer: int, weights) -> DataFrame:
    """Attention pooling over each row's weighted layer average."""
    layered = df.withColumn("_layer", layer_pool(vec_col, n_layers, start_layer, weights))
    return attention_pool(layered, group_col, "_layer", mask_col, heads)
