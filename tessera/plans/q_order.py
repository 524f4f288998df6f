"""Notebook-ordering plans over ``conversations`` (conv = notebook, turn = true position)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.hashing import uniform
from tessera.functions.text import unescape_newlines
from tessera.operators import ordering as O
from tessera.operators.splits import group_holdout
from tessera.plans import sql as S
from tessera.plans.common import cells_frame, orders_frame
from tessera.plans.registry import ORACLES, query
from tessera.sources import files
from tessera.sources.tables import Tables


def notebook_bound(t):
    """Cells in the largest notebook (checked on the source table)."""
    from tessera.operators.ranking import largest_group
    return largest_group(t.conversations, ["conv_id"])


def scored_cells(t, bound=None):
    """Cells with true rank and a predicted score (markdown: hashed stand-in for a
    model output; code: average-tie percentile rank of the true position)."""
    cells = O.attach_rank(cells_frame(t), orders_frame(t))
    code_pct = O.pct_rank_avg(cells, ["id", "cell_type"], "turn", out="_pct", largest_group=bound)
    return code_pct.withColumn(
        "pred", F.when(F.col("cell_type") == "markdown", uniform(1, "cell_id")).otherwise(F.col("_pct"))).drop("_pct")


@query("ordered_cells", f"""
WITH cells AS ({S.CELLS})
SELECT id, string_agg(cell_id, ' ' ORDER BY turn, cell_id) AS cell_order FROM cells GROUP BY id""")
def q_ordered_cells(spark, sf):
    return orders_frame(Tables(spark, sf))


@query("cell_rank_join", f"""
WITH cells AS ({S.CELLS})
SELECT id, cell_id, cell_type, CAST(row_number() OVER (PARTITION BY id ORDER BY turn, cell_id) - 1 AS INTEGER) AS rank,
       round((row_number() OVER (PARTITION BY id ORDER BY turn, cell_id) - 1) / count(*) OVER (PARTITION BY id), 6) AS pct_rank
FROM cells""")
def q_cell_rank_join(spark, sf):
    t = Tables(spark, sf)
    r = O.attach_rank(cells_frame(t), orders_frame(t))
    return r.select("id", "cell_id", "cell_type", "rank", F.round("pct_rank", 6).alias("pct_rank"))


@query("pct_rank_avg", f"""
WITH cells AS (SELECT *, floor(length(source) / 40) AS len_bin FROM ({S.CELLS}))
SELECT id, cell_id, cell_type, len_bin,
       round((rank() OVER (PARTITION BY id, cell_type ORDER BY len_bin)
              + (count(*) OVER (PARTITION BY id, cell_type, len_bin) - 1) / 2.0)
             / count(*) OVER (PARTITION BY id, cell_type), 6) AS pct_rank
FROM cells""")
def q_pct_rank_avg(spark, sf):
    t = Tables(spark, sf)
    c = cells_frame(t).withColumn("len_bin", F.floor(F.char_length("source") / 40))
    r = O.pct_rank_avg(c, ["id", "cell_type"], "len_bin", largest_group=notebook_bound(t))
    return r.select("id", "cell_id", "cell_type", "len_bin", F.round("pct_rank", 6).alias("pct_rank"))


@query("predicted_order", f"""
WITH {S.PRED_CTES}
SELECT id, string_agg(cell_id, ' ' ORDER BY pred, cell_id) AS pred_order FROM placed GROUP BY id""")
def q_predicted_order(spark, sf):
    t = Tables(spark, sf)
    s = scored_cells(t, notebook_bound(t))
    lst = O.ordered_list(s.withColumn("_k", F.struct("pred", "cell_id")), "id", "_k", "cell_id", "items")
    return lst.select("id", F.array_join("items", " ").alias("pred_order"))


@query("kendall_tau", f"""
WITH {S.PRED_CTES},
inv AS (SELECT count(*) AS inversions FROM placed a JOIN placed b ON a.id = b.id AND a.rank < b.rank AND a.pred_pos > b.pred_pos),
tot AS (SELECT sum(n * (n - 1)) AS total_2max FROM (SELECT id, count(*) AS n FROM cells GROUP BY id))
SELECT CAST(inversions AS BIGINT) AS inversions, CAST(total_2max AS BIGINT) AS total_2max,
       round(1 - 4 * inversions / total_2max, 6) AS kendall_tau FROM inv, tot""")
def q_kendall_tau(spark, sf):
    t = Tables(spark, sf)
    b = notebook_bound(t)
    s = O.predicted_position(scored_cells(t, b), "id", "pred", "cell_id", largest_group=b)
    k = O.kendall_tau(s, "id", "rank", "pred_pos")
    return k.select(F.col("inversions").cast("bigint").alias("inversions"),
                    F.col("total_2max").cast("bigint").alias("total_2max"),
                    F.round("kendall_tau", 6).alias("kendall_tau"))


@query("pct_rank_avg_segmented", ORACLES["pct_rank_avg"])
def q_pct_rank_avg_segmented(spark, sf):
    """The same without a size check: every group in sub-ranges."""
    c = cells_frame(Tables(spark, sf)).withColumn("len_bin", F.floor(F.char_length("source") / 40))
    r = O.pct_rank_avg(c, ["id", "cell_type"], "len_bin")
    return r.select("id", "cell_id", "cell_type", "len_bin", F.round("pct_rank", 6).alias("pct_rank"))


@query("kendall_tau_segmented", ORACLES["kendall_tau"])
def q_kendall_tau_segmented(spark, sf):
    """The same with every level of the count in sub-ranges."""
    t = Tables(spark, sf)
    s = O.predicted_position(scored_cells(t), "id", "pred", "cell_id")
    k = O.kendall_tau(s, "id", "rank", "pred_pos", plain_max=0, top_level=1)
    return k.select(F.col("inversions").cast("bigint").alias("inversions"),
                    F.col("total_2max").cast("bigint").alias("total_2max"),
                    F.round("kendall_tau", 6).alias("kendall_tau"))


@query("md_ratio", f"""
WITH cells AS ({S.CELLS})
SELECT id, count_if(cell_type <> 'markdown') AS total_code, count_if(cell_type = 'markdown') AS total_md,
       round(count_if(cell_type = 'markdown') / count(*), 6) AS md_ratio
FROM cells GROUP BY id""")
def q_md_ratio(spark, sf):
    r = O.md_ratio(cells_frame(Tables(spark, sf)), "id")
    return r.withColumn("md_ratio", F.round("md_ratio", 6))


@query("md_count_moments", f"""
WITH cells AS ({S.CELLS}),
m AS (SELECT id, count(*) AS total_md FROM cells WHERE cell_type = 'markdown' GROUP BY id)
SELECT round(avg(total_md), 6) AS md_mean, round(avg(total_md * total_md), 6) AS md_mean_square, count(*) AS n_ids FROM m""")
def q_md_count_moments(spark, sf):
    c = cells_frame(Tables(spark, sf)).where(F.col("cell_type") == "markdown")
    m = c.groupBy("id").agg(F.count(F.lit(1)).alias("total_md"))
    return m.agg(F.round(F.avg("total_md"), 6).alias("md_mean"),
                 F.round(F.avg(F.col("total_md") * F.col("total_md")), 6).alias("md_mean_square"),
                 F.count(F.lit(1)).alias("n_ids"))


@query("order_masks", f"""
WITH cells AS ({S.CELLS}),
md AS (SELECT id, cell_id, turn,
              row_number() OVER (PARTITION BY id ORDER BY turn, cell_id) - 1 AS slot,
              row_number() OVER (PARTITION BY id ORDER BY {S.h(42, 'cell_id')}, cell_id) - 1 AS dslot
       FROM cells WHERE cell_type = 'markdown'),
fill AS (SELECT s.id, s.cell_id AS slot_item, s.slot, d.cell_id AS dealt, d.slot AS src
         FROM md s JOIN md d ON s.id = d.id AND s.slot = d.dslot),
x AS (SELECT c.id, c.turn, CAST(c.cell_type = 'markdown' AS INTEGER) AS is_md, coalesce(f.dealt, c.cell_id) AS shown, f.slot, f.src
      FROM cells c LEFT JOIN fill f ON c.id = f.id AND c.cell_id = f.slot_item)
SELECT id, list(shown ORDER BY turn) AS cell_shuffle,
       coalesce(list(src ORDER BY slot) FILTER (WHERE slot IS NOT NULL), []) AS permutation,
       list(is_md ORDER BY turn) AS md_mask, CAST(sum(is_md) AS BIGINT) AS length
FROM x GROUP BY id""")
def q_order_masks(spark, sf):
    t = Tables(spark, sf)
    return O.order_masks(cells_frame(t), pos_col="turn", largest_group=notebook_bound(t))


_SPLIT_IDS = f"""
WITH cells AS ({S.CELLS}),
g AS (SELECT DISTINCT id FROM cells),
r AS (SELECT id, (row_number() OVER (ORDER BY {S.h(0, 'id')}, id) - 1) < round_even(0.9 * count(*) OVER (), 0) AS is_train FROM g)
"""


def _split_ids(t):
    ids = cells_frame(t).select("id").distinct()
    return group_holdout(ids, "id", frac=0.9, seed=0)


@query("order_split_semi", _SPLIT_IDS + "SELECT id, cell_id FROM cells WHERE id IN (SELECT id FROM r WHERE is_train)")
def q_order_split_semi(spark, sf):
    t = Tables(spark, sf)
    train = _split_ids(t).where("is_train").select("id")
    return cells_frame(t).join(train, "id", "left_semi").select("id", "cell_id")


@query("order_split_anti", _SPLIT_IDS + "SELECT id, cell_id FROM cells WHERE id NOT IN (SELECT id FROM r WHERE is_train)")
def q_order_split_anti(spark, sf):
    t = Tables(spark, sf)
    train = _split_ids(t).where("is_train").select("id")
    return cells_frame(t).join(train, "id", "left_anti").select("id", "cell_id")


@query("unescape_newlines", r"""
SELECT conv_id, turn, replace(replace(text, chr(10), '\n'), '\n', chr(10)) AS text FROM conversations""")
def q_unescape_newlines(spark, sf):
    c = Tables(spark, sf).conversations
    escaped = F.replace(F.col("text"), F.lit("\n"), F.lit("\\n"))
    return c.select("conv_id", "turn", unescape_newlines(escaped).alias("text"))


@query("src_notebook_json", f"""
WITH cells AS ({S.CELLS})
SELECT id, cell_id, cell_type, source FROM cells""")
def q_src_notebook_json(spark, sf):
    """Round trip: notebooks written as one JSON document per id, read back as cells."""
    from tessera.session import scratch_path
    t = Tables(spark, sf)
    path = scratch_path(spark, "notebooks")
    files.write_notebook_docs(cells_frame(t), path)
    return files.read_notebook_dir(spark, path + "/*/*.json").select("id", "cell_id", "cell_type", "source")
