"""Pooling plans over ``embeddings`` (label = sequence, vec_id = position)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.hashing import uniform
from tessera.functions import arrays as A
from tessera.operators import pooling as PO
from tessera.plans import sql as S
from tessera.plans.registry import query
from tessera.sources.tables import Tables

# attention score vectors (one per head): fixed, deterministic parameters
HEADS = [[((j % 5) - 2) / 10.0 for j in range(64)], [((j % 3) - 1) / 8.0 for j in range(64)]]
LAYER_WEIGHTS = [1.0, 2.0, 3.0, 4.0]


def tokens(t):
    """Embeddings as masked token vectors: about 20 % of positions masked out by a keyed hash."""
    e = t.embeddings
    return e.select("vec_id", "label", "embedding", (uniform(9, "vec_id") >= 0.2).cast("int").alias("mask"))


LONG = f"""
tok AS (SELECT vec_id, label, embedding, CAST({S.u(9, 'vec_id')} >= 0.2 AS INTEGER) AS mask FROM embeddings),
lng AS (SELECT label, vec_id, mask, unnest(generate_series(1, len(embedding))) AS dim,
               CAST(unnest(embedding) AS DOUBLE) AS v FROM tok)
"""


def _round_arr(c):
    return F.transform(c, lambda x: F.round(x, 6))


@query("pool_mean", f"""
WITH {LONG},
d AS (SELECT label, dim, sum(mask * v) / greatest(sum(mask), 1e-9) AS m FROM lng GROUP BY label, dim)
SELECT label, list(round(m, 6) ORDER BY dim) AS pooled FROM d GROUP BY label""")
def q_pool_mean(spark, sf):
    p = PO.masked_pool(tokens(Tables(spark, sf)), "label", "embedding", "mask", "mean")
    return p.select("label", _round_arr("pooled").alias("pooled"))


@query("pool_max", f"""
WITH {LONG},
d AS (SELECT label, dim, max(v) FILTER (WHERE mask = 1) AS m FROM lng GROUP BY label, dim)
SELECT label, CASE WHEN count(m) > 0 THEN list(round(m, 6) ORDER BY dim) END AS pooled FROM d GROUP BY label""")
def q_pool_max(spark, sf):
    p = PO.masked_pool(tokens(Tables(spark, sf)), "label", "embedding", "mask", "max")
    return p.select("label", _round_arr("pooled").alias("pooled"))


@query("pool_min", f"""
WITH {LONG},
d AS (SELECT label, dim, min(v) FILTER (WHERE mask = 1) AS m FROM lng GROUP BY label, dim)
SELECT label, CASE WHEN count(m) > 0 THEN list(round(m, 6) ORDER BY dim) END AS pooled FROM d GROUP BY label""")
def q_pool_min(spark, sf):
    p = PO.masked_pool(tokens(Tables(spark, sf)), "label", "embedding", "mask", "min")
    return p.select("label", _round_arr("pooled").alias("pooled"))


@query("pool_mean_max", f"""
WITH {LONG},
d AS (SELECT label, dim, sum(mask * v) / sum(mask) AS mn, max(v) FILTER (WHERE mask = 1) AS mx FROM lng GROUP BY label, dim)
SELECT label, CASE WHEN count(mx) > 0 THEN list(round(mn, 6) ORDER BY dim) || list(round(mx, 6) ORDER BY dim) END AS pooled
FROM d GROUP BY label""")
def q_pool_mean_max(spark, sf):
    p = PO.mean_max_pool(tokens(Tables(spark, sf)), "label", "embedding", "mask")
    return p.select("label", _round_arr("pooled").alias("pooled"))


@query("pool_layers", f"""
WITH l AS (SELECT vec_id, unnest(generate_series(1, 16)) AS d, embedding FROM embeddings)
SELECT vec_id, list(round(((2.0 / 9) * CAST(embedding[16 + d] AS DOUBLE) + (3.0 / 9) * CAST(embedding[32 + d] AS DOUBLE)
                           + (4.0 / 9) * CAST(embedding[48 + d] AS DOUBLE)), 6) ORDER BY d) AS pooled
FROM l GROUP BY vec_id""")
def q_pool_layers(spark, sf):
    """Each 64-float vector viewed as 4 layers x 16; weighted mean of layers 1..3."""
    e = Tables(spark, sf).embeddings
    return e.select("vec_id", _round_arr(PO.layer_pool("embedding", 4, 1, LAYER_WEIGHTS)).alias("pooled"))


def _masked_groups(t):
    """The same vectors grouped so that some groups are masked as a whole."""
    e = t.embeddings
    return e.select((F.col("vec_id") % 97).alias("grp"), "embedding",
                    ((F.col("vec_id") % 97 % 7 != 3) & (uniform(9, "vec_id") >= 0.2)).cast("int").alias("mask"))


GROUPED = f"""
g AS (SELECT vec_id % 97 AS grp, CAST(vec_id % 97 % 7 <> 3 AND {S.u(9, 'vec_id')} >= 0.2 AS INTEGER) AS mask, embedding FROM embeddings),
lng AS (SELECT grp, mask, unnest(generate_series(1, len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM g)
"""


@query("pool_masked_groups", f"""
WITH {GROUPED},
d AS (SELECT grp, dim, sum(mask * v) / greatest(sum(mask), 1e-9) AS mn, max(v) FILTER (WHERE mask = 1) AS mx,
             min(v) FILTER (WHERE mask = 1) AS lo FROM lng GROUP BY grp, dim)
SELECT grp, list(round(mn, 6) ORDER BY dim) AS mean, CASE WHEN count(mx) > 0 THEN list(round(mx, 6) ORDER BY dim) END AS most,
       CASE WHEN count(lo) > 0 THEN list(round(lo, 6) ORDER BY dim) END AS least FROM d GROUP BY grp""")
def q_pool_masked_groups(spark, sf):
    """Mean, max and min where a seventh of the groups has no unmasked row."""
    d = _masked_groups(Tables(spark, sf))
    out = [PO.masked_pool(d, "grp", "embedding", "mask", how).select("grp", _round_arr("pooled").alias(name))
           for how, name in (("mean", "mean"), ("max", "most"), ("min", "least"))]
    return out[0].join(out[1], "grp").join(out[2], "grp")


def _att_sql():
    heads = []
    for h, a in enumerate(HEADS):
        arr = "[" + ", ".join(repr(x) for x in a) + "]::DOUBLE[]"
        heads.append(f"""
s{h} AS (SELECT label, vec_id, list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), {arr}), lambda z: z[1] * z[2])) AS s
        FROM tok WHERE mask <> 0),
w{h} AS (SELECT s{h}.label, s{h}.vec_id, exp(s - max(s) OVER (PARTITION BY s{h}.label)) AS w FROM s{h}),
p{h} AS (SELECT lng.label, dim, sum(w * v) / sum(w) AS m FROM lng JOIN w{h} USING (label, vec_id) GROUP BY lng.label, dim),
r{h} AS (SELECT label, list(round(m, 6) ORDER BY dim) AS pooled FROM p{h} GROUP BY label)""")
    return f"""
WITH {LONG}, {','.join(heads)}
SELECT g.label, r0.pooled || r1.pooled AS pooled
FROM (SELECT DISTINCT label FROM embeddings) g LEFT JOIN r0 USING (label) LEFT JOIN r1 USING (label)"""


@query("pool_attention", _att_sql())
def q_pool_attention(spark, sf):
    p = PO.attention_pool(tokens(Tables(spark, sf)), "label", "embedding", "mask", HEADS)
    return p.select("label", _round_arr("pooled").alias("pooled"))


LAYER_HEAD = [((j % 5) - 2) / 10.0 for j in range(16)]


@query("pool_layer_attention", f"""
WITH tok AS (SELECT vec_id, label, embedding FROM embeddings WHERE {S.u(9, 'vec_id')} >= 0.2),
lng AS (SELECT vec_id, label, unnest(generate_series(1, 16)) AS d, embedding FROM tok),
v AS (SELECT vec_id, label, d, (2.0 / 9) * CAST(embedding[16 + d] AS DOUBLE) + (3.0 / 9) * CAST(embedding[32 + d] AS DOUBLE)
             + (4.0 / 9) * CAST(embedding[48 + d] AS DOUBLE) AS x FROM lng),
s AS (SELECT vec_id, label, sum(x * ([{', '.join(map(repr, LAYER_HEAD))}]::DOUBLE[])[d]) AS s FROM v GROUP BY vec_id, label),
w AS (SELECT vec_id, exp(s - max(s) OVER (PARTITION BY label)) AS w FROM s),
p AS (SELECT label, d, sum(w * x) / sum(w) AS m FROM v JOIN w USING (vec_id) GROUP BY label, d),
r AS (SELECT label, list(round(m, 6) ORDER BY d) AS pooled FROM p GROUP BY label)
SELECT g.label, pooled FROM (SELECT DISTINCT label FROM embeddings) g LEFT JOIN r USING (label)""")
def q_pool_layer_attention(spark, sf):
    """Attention over the weighted average of layers 1..3 (4 layers x 16)."""
    p = PO.layer_attention_pool(tokens(Tables(spark, sf)), "label", "embedding", "mask", [LAYER_HEAD], 4, 1, LAYER_WEIGHTS)
    return p.select("label", _round_arr("pooled").alias("pooled"))


@query("sigmoid_softmax", """
WITH e AS (SELECT vec_id, CAST(embedding[1:8] AS DOUBLE[]) AS x FROM embeddings),
w AS (SELECT vec_id, x, list_transform(x, lambda v: exp(v - list_max(x))) AS w FROM e)
SELECT vec_id, list_transform(x, lambda v: round(1 / (1 + exp(-v)), 6)) AS sigmoid,
       list_transform(w, lambda v: round(v / list_sum(w), 6)) AS softmax FROM w""")
def q_sigmoid_softmax(spark, sf):
    """Both over the first eight numbers of each vector."""
    x = F.slice("embedding", 1, 8).cast("array<double>")
    e = Tables(spark, sf).embeddings.select("vec_id", x.alias("x"))
    return e.select("vec_id", F.transform("x", lambda v: F.round(A.sigmoid(v), 6)).alias("sigmoid"),
                    _round_arr(A.softmax("x")).alias("softmax"))
