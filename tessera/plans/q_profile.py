"""Profiling and tabular-feature plans (customer / lineitem / documents)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.hashing import hash_hex
from tessera.operators import features as FE
from tessera.operators import profile as PR
from tessera.operators.ranking import hashed_rank
from tessera.plans import sql as S
from tessera.plans.registry import query
from tessera.sources.tables import Tables

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _r6(df, cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("value_counts", """
SELECT lang, count(*) AS cnt, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY lang""")
def q_value_counts(spark, sf):
    return _r6(PR.value_counts(Tables(spark, sf).documents, "lang"), ["share"])


_LEVEL_COLS = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
               ("c_mktsegment", "string")]


@query("column_levels", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT {c}) AS BIGINT) AS levels, '{t}' AS dtype FROM customer"
    for c, t in _LEVEL_COLS))
def q_column_levels(spark, sf):
    return PR.column_levels(Tables(spark, sf).customer)


@query("describe_numeric", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
       round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM lineitem""" for c in NUM))
def q_describe_numeric(spark, sf):
    d = PR.describe_numeric(Tables(spark, sf).lineitem, NUM)
    return _r6(d, ["mean", "std", "min", "p25", "p50", "p75", "max"])


@query("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for a in NUM for b in NUM))
def q_corr_matrix(spark, sf):
    return _r6(PR.corr_matrix(Tables(spark, sf).lineitem, NUM), ["corr"])


@query("skew_adj", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", n, round(g1 * sqrt(n * (n - 1)) / (n - 2), 6) AS skew FROM (
  SELECT count({c}) AS n, avg(power({c} - mu, 3)) / power(avg(power({c} - mu, 2)), 1.5) AS g1
  FROM lineitem, (SELECT avg({c}) AS mu FROM lineitem))""" for c in NUM))
def q_skew_adj(spark, sf):
    return _r6(PR.skew_adjusted(Tables(spark, sf).lineitem, NUM), ["skew"])


@query("histogram", """
WITH st AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((l_extendedprice - lo) / ((hi - lo) / 10)), 9) END AS INTEGER) AS bin
      FROM lineitem, st WHERE l_extendedprice IS NOT NULL),
c AS (SELECT bin, count(*) AS cnt FROM b GROUP BY bin),
g AS (SELECT CAST(unnest(generate_series(0, 9)) AS INTEGER) AS bin, lo, hi FROM st)
SELECT g.bin, round(lo + g.bin * ((hi - lo) / 10), 6) AS lo, round(lo + (g.bin + 1) * ((hi - lo) / 10), 6) AS hi,
       coalesce(c.cnt, 0) AS cnt FROM g LEFT JOIN c USING (bin)""")
def q_histogram(spark, sf):
    return _r6(PR.histogram(Tables(spark, sf).lineitem, "l_extendedprice", 10), ["lo", "hi"])


@query("category_means", """
SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, count(l_quantity) AS n, round(stddev_samp(l_quantity), 6) AS std,
       round(avg(l_quantity) - 1.96 * stddev_samp(l_quantity) / sqrt(count(l_quantity)), 6) AS ci_lo,
       round(avg(l_quantity) + 1.96 * stddev_samp(l_quantity) / sqrt(count(l_quantity)), 6) AS ci_hi
FROM lineitem GROUP BY l_returnflag""")
def q_category_means(spark, sf):
    return _r6(PR.category_means(Tables(spark, sf).lineitem, "l_returnflag", "l_quantity"),
               ["mean", "std", "ci_lo", "ci_hi"])


@query("kde_grid", """
WITH st AS (SELECT l_linestatus, min(l_discount) AS lo, max(l_discount) AS hi, count(l_discount) AS n,
                   stddev_samp(l_discount) * power(count(l_discount), -0.2) AS bw FROM lineitem GROUP BY l_linestatus),
g AS (SELECT l_linestatus, n, bw, gi, lo + (hi - lo) * gi / 49 AS g FROM st, (SELECT unnest(generate_series(0, 49)) AS gi))
SELECT g.l_linestatus, CAST(gi AS INTEGER) AS gi, round(g, 6) AS g,
       round(sum(exp(-0.5 * ((g - l_discount) / bw) * ((g - l_discount) / bw))) / (n * bw * sqrt(2 * pi())), 6) AS density
FROM g JOIN lineitem l ON g.l_linestatus = l.l_linestatus WHERE l_discount IS NOT NULL
GROUP BY g.l_linestatus, gi, g, n, bw""")
def q_kde_grid(spark, sf):
    k = PR.kde_grid(Tables(spark, sf).lineitem, "l_discount", "l_linestatus", points=50)
    return _r6(k.withColumn("gi", F.col("gi").cast("int")), ["g", "density"])


@query("kde_2d", """
WITH l AS (SELECT l_returnflag, l_linestatus, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem),
st AS (SELECT l_returnflag, l_linestatus, count(*) AS n, min(x) AS lox, (max(x) - min(x)) / 23 AS wx, stddev_samp(x) * power(count(*), -1 / 6.0) AS bwx,
              min(y) AS loy, (max(y) - min(y)) / 23 AS wy, stddev_samp(y) * power(count(*), -1 / 6.0) AS bwy FROM l GROUP BY ALL),
c AS (SELECT l_returnflag, l_linestatus, CAST(round_even((x - lox) / wx, 0) AS INT) AS bx, CAST(round_even((y - loy) / wy, 0) AS INT) AS by_,
             count(*) AS c FROM l JOIN st USING (l_returnflag, l_linestatus) GROUP BY ALL),
g AS (SELECT CAST(unnest(range(24)) AS INT) AS g)
SELECT st.l_returnflag, st.l_linestatus, gx.g AS gx, gy.g AS gy, round(lox + gx.g * wx, 4) AS x, round(loy + gy.g * wy, 4) AS y,
       round(1e6 * sum(c * exp(-0.5 * (power((gx.g - bx) * wx / bwx, 2) + power((gy.g - by_) * wy / bwy, 2)))) / (n * 2 * pi() * bwx * bwy), 6) AS density
FROM c JOIN st USING (l_returnflag, l_linestatus), g gx, g gy
GROUP BY st.l_returnflag, st.l_linestatus, gx.g, gy.g, lox, loy, wx, wy, bwx, bwy, n""")
def q_kde_2d(spark, sf):
    """Density of price and quantity in every return flag and status (in millionths)."""
    k = PR.kde_2d(Tables(spark, sf).lineitem, "l_quantity", "l_extendedprice", ["l_returnflag", "l_linestatus"], points=24)
    return k.select("l_returnflag", "l_linestatus", "gx", "gy", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"),
                    F.round(F.col("density") * 1e6, 6).alias("density"))


@query("impute_mean", """
SELECT d.doc_id, round(coalesce(CAST(l.quality AS DOUBLE), avg(l.quality) OVER ()), 6) AS quality,
       round(coalesce(CAST(l.toxic AS DOUBLE), avg(l.toxic) OVER ()), 6) AS toxic
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def q_impute_mean(spark, sf):
    t = Tables(spark, sf)
    j = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return _r6(FE.impute_mean(j, ["quality", "toxic"]), ["quality", "toxic"])


@query("one_hot", "SELECT c_custkey, " + ", ".join(
    f"coalesce(CAST(c_mktsegment = '{s}' AS INTEGER), 0) AS seg_{s}" for s in SEGMENTS) + " FROM customer")
def q_one_hot(spark, sf):
    c = Tables(spark, sf).customer.select("c_custkey", "c_mktsegment")
    return FE.one_hot(c, "c_mktsegment", prefix="seg").drop("c_mktsegment")


@query("family_bins", """
WITH n AS (SELECT l_orderkey AS o_orderkey, count(*) AS size FROM lineitem GROUP BY l_orderkey)
SELECT o.o_orderkey, coalesce(n.size, 0) AS size, CAST(coalesce(n.size, 0) = 1 AS INTEGER) AS single,
       CAST(coalesce(n.size, 0) BETWEEN 2 AND 4 AS INTEGER) AS small, CAST(coalesce(n.size, 0) >= 5 AS INTEGER) AS large
FROM orders o LEFT JOIN n USING (o_orderkey)""")
def q_family_bins(spark, sf):
    t = Tables(spark, sf)
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("size"))
    o = t.orders.select("o_orderkey").join(n, "o_orderkey", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    return o.select("o_orderkey", "size", *FE.size_bins("size"))


@query("tabular_assemble", """
WITH n AS (SELECT o_custkey AS c_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey)
SELECT c.c_custkey, round(c.c_acctbal, 6) AS c_acctbal, coalesce(n.n_orders, 0) AS n_orders, """ + ", ".join(
    f"coalesce(CAST(c.c_mktsegment = '{s}' AS INTEGER), 0) AS seg_{s}" for s in SEGMENTS) + """
FROM customer c LEFT JOIN n USING (c_custkey)""")
def q_tabular_assemble(spark, sf):
    """Feature blocks computed separately, assembled by key (never by position)."""
    t = Tables(spark, sf)
    base = t.customer.select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    hot = FE.one_hot(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", prefix="seg").drop("c_mktsegment")
    return (base.join(n, "c_custkey", "left").withColumn("n_orders", F.coalesce("n_orders", F.lit(0)))
            .join(hot, "c_custkey", "left"))


@query("label_projection", "SELECT doc_id AS id, text AS full_text, 0 AS label FROM documents")
def q_label_projection(spark, sf):
    d = Tables(spark, sf).documents
    return d.withColumnRenamed("doc_id", "id").select("id", F.col("text").alias("full_text"), F.lit(0).alias("label"))


@query("dropna_any", """
SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)
WHERE doc_id IS NOT NULL AND lang IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL""")
def q_dropna_any(spark, sf):
    t = Tables(spark, sf)
    j = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id", "left")
    return j.drop("n_chars").na.drop("any")


@query("category_filter", "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 1000")
def q_category_filter(spark, sf):
    d = Tables(spark, sf).documents
    return d.where((F.col("lang") == "en") & (F.col("n_chars") >= 1000)).select("doc_id", "n_chars")


@query("head_sample", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def q_head_sample(spark, sf):
    """Quick sample: the first 100 rows by key (a sampling operator: top-k, no global sort)."""
    return Tables(spark, sf).documents.select("doc_id", "lang").orderBy("doc_id").limit(100)


@query("head_half", f"""
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {S.h(11, 'doc_id')}, doc_id) - 1 AS r,
                           count(*) OVER () AS n FROM documents) WHERE r < n // 2""")
def q_head_half(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id")
    r = hashed_rank(d.withColumn("_h", hash_hex(11, "doc_id")), "_h", ["doc_id"], out="_r")
    n = F.broadcast(d.agg(F.count(F.lit(1)).alias("_n")))
    return r.crossJoin(n).where(F.col("_r") < F.floor(F.col("_n") / 2)).select("doc_id")


@query("stable_sort", """
SELECT doc_id, lang, n_chars, row_number() OVER (ORDER BY lang, n_chars DESC, doc_id) - 1 AS position FROM documents""")
def q_stable_sort(spark, sf):
    """Sort with a tie-break key and an explicit position column."""
    from tessera.operators.ranking import sort_with_position
    d = Tables(spark, sf).documents.select("doc_id", "lang", "n_chars")
    return sort_with_position(d, [F.asc("lang"), F.desc("n_chars"), F.asc("doc_id")])
