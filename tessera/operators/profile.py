"""Dataset profiling: counts and shares, levels per column, summary statistics,
pairwise correlations, adjusted skewness, histograms, category means, density grids.

Every statistic is one aggregate pass (partial + final); values never reach the
driver except level lists of bounded size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count and share of each value (share uses a one-row total, broadcast)."""
    c = df.groupBy(col).agg(F.count(F.lit(1)).alias("cnt"))
    tot = F.broadcast(df.agg(F.count(F.lit(1)).alias("_tot")))
    return c.crossJoin(tot).withColumn("share", F.col("cnt") / F.col("_tot")).drop("_tot")


def column_levels(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct non-null levels and type of every column, ascending by levels."""
    agg = F.approx_count_distinct if approx else F.count_distinct
    one = df.agg(*[agg(F.col(f"`{c}`")).alias(f"l{i}") for i, c in enumerate(df.columns)])
    types = dict(df.dtypes)
    parts = []
    for i, c in enumerate(df.columns):
        parts += [f"'{c}'", f"CAST(l{i} AS BIGINT)", f"'{types[c]}'"]
    return one.selectExpr(f"stack({len(df.columns)}, {', '.join(parts)}) AS (`column`, levels, dtype)").orderBy("levels", "column")


def sorted_quantiles(df: DataFrame, col: str, probs) -> DataFrame:
    """Exact linear-interpolation quantiles from one distributed sort: the rows at
    ranks ``floor(q (n-1))`` and ``ceil(q (n-1))`` are picked by their positions
    (range-partitioned sort + per-partition offsets); nothing is buffered per value.
    One row: ``q0, q1, ...``."""
    from tessera.operators.ranking import sort_with_position
    v = df.select(F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    pos = sort_with_position(v, [F.asc("_x")], out="_pos")
    n = pos.agg(F.count(F.lit(1)).alias("_n"))
    picks = []
    for i, q in enumerate(probs):
        r = F.lit(float(q)) * (F.col("_n") - 1)
        picks.append((i, F.floor(r).cast("bigint"), F.ceil(r).cast("bigint"), r - F.floor(r)))
    want = n.select(*[c.alias(f"_{k}{i}") for i, lo, hi, fr in picks for k, c in (("lo", lo), ("hi", hi), ("fr", fr))])
    j = pos.crossJoin(F.broadcast(want))
    aggs = []
    for i, _, _, _ in picks:
        aggs += [F.max(F.when(F.col("_pos") == F.col(f"_lo{i}"), F.col("_x"))).alias(f"_a{i}"),
                 F.max(F.when(F.col("_pos") == F.col(f"_hi{i}"), F.col("_x"))).alias(f"_b{i}"),
                 F.first(f"_fr{i}").alias(f"_f{i}")]
    one = j.agg(*aggs)
    return one.select(*[(F.col(f"_a{i}") + F.col(f"_f{i}") * (F.col(f"_b{i}") - F.col(f"_a{i}"))).alias(f"q{i}")
                        for i, _, _, _ in picks])


def describe_numeric(df: DataFrame, cols, exact: bool = True, max_buffered: int = 1_000_000) -> DataFrame:
    """count / mean / std / min / 25 % / 50 % / 75 % / max per column, long form.

    Quartiles interpolate linearly.  Exact ``percentile`` buffers a column's
    distinct values in one task, so it is used only when a first pass of
    ``approx_count_distinct`` shows at most ``max_buffered`` values; otherwise the
    quartiles come from one distributed sort (:func:`sorted_quantiles`).
    ``exact=False`` uses ``percentile_approx``.
    """
    distinct = (df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first().asDict()
                if exact else {})
    # one aggregate for all columns; only columns of very many distinct values are sorted
    sort = [c for c in cols if exact and (distinct.get(c) or 0) > max_buffered]
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).cast("double").alias(f"a{i}"), F.max(x).cast("double").alias(f"b{i}")]
        if c not in sort:
            q = F.percentile(x, [0.25, 0.5, 0.75]) if exact else F.percentile_approx(x, [0.25, 0.5, 0.75], 10000)
            aggs.append(q.cast("array<double>").alias(f"q{i}"))
    one = df.agg(*aggs)
    for i, c in enumerate(cols):
        if c in sort:
            q = sorted_quantiles(df, c, [0.25, 0.5, 0.75]).select(F.array("q0", "q1", "q2").alias(f"q{i}"))
            one = one.crossJoin(q)  # one row on either side
    parts = [x for i, c in enumerate(cols) for x in
             (f"'{c}'", f"n{i}", f"m{i}", f"s{i}", f"a{i}", f"q{i}[0]", f"q{i}[1]", f"q{i}[2]", f"b{i}")]
    return one.selectExpr(f"stack({len(cols)}, {', '.join(parts)}) AS "
                          "(`column`, count, mean, std, min, p25, p50, p75, max)")


def corr_matrix(df: DataFrame, cols) -> DataFrame:
    """Pairwise-complete Pearson correlation of every column pair, one aggregate pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    parts = []
    for k, (a, b) in enumerate(pairs):
        parts += [f"'{a}'", f"'{b}'", f"c{k}"]
        if a != b:
            parts += [f"'{b}'", f"'{a}'", f"c{k}"]
    n = len(parts) // 3
    return one.selectExpr(f"stack({n}, {', '.join(parts)}) AS (col_a, col_b, corr)")


def skew_adjusted(df: DataFrame, cols) -> DataFrame:
    """Bias-adjusted sample skewness ``g1 * sqrt(n (n - 1)) / (n - 2)`` per column."""
    one = df.agg(*[x for i, c in enumerate(cols) for x in (F.count(c).alias(f"n{i}"), F.skewness(c).alias(f"g{i}"))])
    parts = [x for i, c in enumerate(cols) for x in (f"'{c}'", f"n{i}", f"g{i}")]
    long = one.selectExpr(f"stack({len(cols)}, {', '.join(parts)}) AS (`column`, n, g1)")
    return long.select("column", "n", F.when(F.col("n") > 2, F.col("g1") * F.sqrt(F.col("n") * (F.col("n") - 1))
                                             / (F.col("n") - 2)).alias("skew"))


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between min and max, last edge inclusive; empty bins kept."""
    st = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    b = (df.select(col).where(F.col(col).isNotNull()).crossJoin(F.broadcast(st))
         .select(F.when(F.col("_hi") == F.col("_lo"), F.lit(0))
                 .otherwise(F.least(F.floor((F.col(col) - F.col("_lo")) / w), F.lit(bins - 1))).cast("int").alias("bin")))
    counts = b.groupBy("bin").agg(F.count(F.lit(1)).alias("cnt"))
    grid = st.select("_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin", (F.col("_lo") + F.col("bin") * w).alias("lo"),
                    (F.col("_lo") + (F.col("bin") + 1) * w).alias("hi"),
                    F.coalesce("cnt", F.lit(0)).alias("cnt")))


def category_means(df: DataFrame, cat: str, measure: str, z: float = 1.96) -> DataFrame:
    """Mean of a measure per category with a normal-approximation interval."""
    g = df.groupBy(cat).agg(F.avg(measure).alias("mean"), F.count(measure).alias("n"),
                            F.stddev_samp(measure).alias("std"))
    half = F.lit(z) * F.col("std") / F.sqrt(F.col("n"))
    return g.withColumn("ci_lo", F.col("mean") - half).withColumn("ci_hi", F.col("mean") + half)


def kde_grid(df: DataFrame, x: str, hue: str, points: int = 50, max_hues: int = 1000) -> DataFrame:
    """Gaussian density of ``x`` per hue on a grid of ``points`` between the hue's
    min and max, Scott bandwidth ``std * n^(-1/5)``.

    The grid is at most ``points`` rows per hue and joined to the rows of its hue
    (a bounded fan-out, summed at once by a partial aggregate).
    """
    st = df.groupBy(hue).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count(x).alias("_n"),
                             F.stddev_samp(x).alias("_sd"))
    st = st.withColumn("_bw", F.col("_sd") * F.pow(F.col("_n"), -0.2))
    grid = st.select(hue, "_bw", "_n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("gi"),
                     "_lo", "_hi")
    grid = grid.withColumn("g", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("gi") / (points - 1))
    from tessera.sources.tables import spread
    # each row meets ``points`` grid values: spread a narrow scan before the fan-out
    rows = spread(df.select(hue, F.col(x).alias("_x")).where(F.col("_x").isNotNull()))
    # the grid has ``points`` rows per hue level; the level count is checked first, so the
    # broadcast is bounded and the rows never shuffle by few, skewed hues; many are joined
    few = df.select(hue).distinct().limit(max_hues + 1).count() <= max_hues
    grid = grid.select(hue, "gi", "g", "_bw", "_n")
    k = rows.join(F.broadcast(grid) if few else grid, hue)
    u = (F.col("g") - F.col("_x")) / F.col("_bw")
    dens = k.groupBy(hue, "gi", "g", "_bw", "_n").agg(F.sum(F.exp(-0.5 * u * u)).alias("_s"))
    return dens.select(hue, "gi", "g", (F.col("_s") / (F.col("_n") * F.col("_bw") * F.lit(math.sqrt(2 * math.pi))))
                       .alias("density"))


def kde_2d(df: DataFrame, x: str, y: str, facets, points: int = 24) -> DataFrame:
    """Gaussian density of ``(x, y)`` in each facet (any number of columns and levels, nulls
    included) on a grid of ``points`` x ``points`` between the facet's extremes, Scott
    bandwidths ``std * n^(-1/6)``.

    Binned: rows are counted at their nearest grid points by one aggregate, and the counts
    are smoothed along x, then along y.  Work after the count follows the grid, not the
    rows; rows meet their facet's extremes in a join that AQE broadcasts or splits.  A facet
    without spread in x or y has no density and gives no rows."""
    from tessera.operators.ranking import join_null_safe
    from tessera.session import materialize
    facets = [facets] if isinstance(facets, str) else list(facets)
    rows = df.select(*facets, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where(
        "_x IS NOT NULL AND _y IS NOT NULL AND NOT isnan(_x) AND NOT isnan(_y)")
    st = rows.groupBy(*facets).agg(F.count(F.lit(1)).alias("_n"), *[e for c in "xy" for e in (
        F.min(f"_{c}").alias(f"_lo{c}"), F.max(f"_{c}").alias(f"_hi{c}"), F.stddev_samp(f"_{c}").alias(f"_sd{c}"))])
    st = st.where("_sdx > 0 AND _sdy > 0")
    for c in "xy":
        st = (st.withColumn(f"_bw{c}", F.col(f"_sd{c}") * F.pow(F.col("_n"), F.lit(-1 / 6)))
              .withColumn(f"_w{c}", (F.col(f"_hi{c}") - F.col(f"_lo{c}")) / (points - 1)))
    st = materialize(st, "density-facets")
    at = [F.rint((F.col(f"_{c}") - F.col(f"_lo{c}")) / F.col(f"_w{c}")).cast("int").alias(f"_b{c}") for c in "xy"]
    cells = join_null_safe(rows, st, facets).groupBy(*facets, *at).agg(F.count(F.lit(1)).cast("double").alias("_s"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    for c, keep in (("x", "_by"), ("y", "gx")):
        j = join_null_safe(cells, st.select(*facets, f"_w{c}", f"_bw{c}"), facets).withColumn(f"g{c}", grid)
        u = (F.col(f"g{c}") - F.col(f"_b{c}")) * F.col(f"_w{c}") / F.col(f"_bw{c}")
        cells = j.groupBy(*facets, keep, f"g{c}").agg(F.sum(F.col("_s") * F.exp(-0.5 * u * u)).alias("_s"))
    out = join_null_safe(cells, st, facets)
    return out.select(*facets, "gx", "gy", *[(F.col(f"_lo{c}") + F.col(f"g{c}") * F.col(f"_w{c}")).alias(c) for c in "xy"],
                      (F.col("_s") / (F.col("_n") * F.col("_bwx") * F.col("_bwy") * F.lit(2 * math.pi))).alias("density"))
