"""Cross-site line dedup by distinct-site spread, in built-in expressions only.

A line (between ``\\n``, without blanks around it, of ``min_chars`` characters or more) is
boilerplate when it stands on ``min_sites`` different sites or more.  One aggregation per
line hash merges HyperLogLog sketches of the sites, so a line that half the corpus
carries is summed up before the shuffle.  The sketch decides lines whose estimate is
clearly above or below the limit; those near it get an exact distinct count.  Of each
boilerplate line the first occurrence (smallest doc_id, then position) stays, all others
go, so one copy of every passage is left in the corpus.

Lines are addressed by two independent hashes (96 bits).  Nulls: a null text has no
lines, a null site counts as no site, a null doc_id sorts first.  Blank and short lines
always stay.  Texts are split whole, at any length; columns of any further names pass through.
Repeated rows give repeated results, an empty table an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

from .common import keyed, same_document


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    parts = docs.select("doc_id", "text_key", F.col("source").cast("string").alias("site"),
                        F.posexplode(F.split("text", "\n", -1)).alias("idx", "raw"))
    line = parts.withColumn("line", F.trim("raw")).filter(F.length("line") >= min_chars)
    return line.select("doc_id", "text_key", "site", "idx",
                       F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def boilerplate_lines(docs: DataFrame, min_sites: int = 5, min_chars: int = 16, lg_k: int = 8) -> DataFrame:
    """h1, h2 (line hashes), first (doc_id, idx of the occurrence that stays)."""
    lines = _lines(keyed(docs, "source"), min_chars)
    # the sketch's standard error is 1.04 / sqrt(2^lg_k): five of them, and one site more
    slack = 5 * 1.04 / 2 ** (lg_k / 2)
    low, high = min_sites * (1 - slack) - 1, min_sites * (1 + slack) + 1
    spreads = materialize(
        lines.groupBy("h1", "h2")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"),
             F.min(F.struct("doc_id", "idx")).alias("first"))
        .filter(F.col("sites") >= low), "line-spread")
    near = spreads.filter(F.col("sites") <= high).select("h1", "h2")
    exact = (lines.join(near, ["h1", "h2"], "left_semi").filter("site IS NOT NULL")
             .groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
             .groupBy("h1", "h2").agg(F.count("*").alias("n_sites"))
             .filter(F.col("n_sites") >= min_sites).select("h1", "h2"))
    return materialize(spreads.filter(F.col("sites") > high).select("h1", "h2", "first").unionByName(
        spreads.join(exact, ["h1", "h2"], "left_semi").select("h1", "h2", "first")), "line-boilerplate")


def remove_boilerplate(docs: DataFrame, min_sites: int = 5, min_chars: int = 16, lg_k: int = 8,
                       counts: bool = False) -> DataFrame:
    """The columns of ``docs``, ``text`` without boilerplate lines (null stays null); or,
    for ``counts``, doc_id, text, n_lines, n_removed_lines."""
    boiler = boilerplate_lines(docs, min_sites, min_chars, lg_k)
    hits = _lines(keyed(docs, "source"), min_chars).join(boiler, ["h1", "h2"])
    gone = (hits.filter(~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.idx") == F.col("idx"))))
            .groupBy("doc_id", "text_key").agg(F.collect_set("idx").alias("gone")))
    left = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", "text",
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    out = left.join(gone, same_document(left, gone), "left")
    text = F.expr(r"CASE WHEN gone IS NULL THEN text ELSE array_join(filter(split(text, '\n', -1), "
                  r"(l, i) -> NOT array_contains(gone, i)), '\n') END").alias("text")
    if not counts:
        return out.select(*[text if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
    return out.select(
        left["doc_id"], text,
        F.expr(r"CASE WHEN text IS NULL THEN 0 ELSE size(split(text, '\n', -1)) END").cast("long").alias("n_lines"),
        F.greatest(F.lit(0), F.size("gone")).cast("long").alias("n_removed_lines"))
