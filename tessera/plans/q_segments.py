"""Cell sampling, segment concatenation, pair encoding and literal-list parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions.text import clean_text
from tessera.plans import sql as S
from tessera.plans.common import cells_frame
from tessera.plans.q_pairs import members_frame
from tessera.plans.registry import query
from tessera.operators.pairs import positive_pairs
from tessera.operators.vocab import build_vocab, encode, top_tokens
from tessera.operators.ordering import md_ratio
from tessera.session import materialize, scratch_path
from tessera.sources import files
from tessera.sources.tables import Tables

N_SAMPLE = 3
CUT = 200


def sampled_cells(t, n: int = N_SAMPLE, cell_type: str = "code"):
    """Evenly spaced sample of each notebook's cells of one type (positions
    ``rint(j * len / n)`` below len, the last cell forced in); when ``n >= len`` every
    cell, cut to 200 characters.  Positions come from per-notebook counts: no
    notebook's cells are collected to choose them."""
    from tessera.operators.ranking import segmented_cumsum
    from tessera.plans.q_order import notebook_bound
    c = cells_frame(t).where(F.col("cell_type") == cell_type)
    c = segmented_cumsum(c, ["id"], ["turn", "cell_id"], F.lit(1), "pos", largest_group=notebook_bound(t)) \
        .withColumn("pos", F.col("pos") - 1)
    cnt = c.groupBy("id").agg(F.count(F.lit(1)).alias("len"))
    idx = A.sample_positions(F.col("len"), n)
    last = F.col("len") - 1
    fixed = F.when(F.array_contains(idx, last), idx).otherwise(
        F.concat(F.slice(idx, 1, F.size(idx) - 1), F.array(last)))
    picks = cnt.select("id", "len", F.posexplode(fixed).alias("sample_rank", "pos"))
    j = picks.join(c, ["id", "pos"])
    src = F.when(F.col("len") <= n, F.substring("source", 1, CUT)).otherwise(F.col("source"))
    return j.select("id", "sample_rank", "cell_id", src.alias("source"))


def _sample_ctes(n: int) -> str:
    """``p``: id, len, pos, sample_rank of the sampled code cells; ``c``: all code cells with pos."""
    return f"""
cells AS ({S.CELLS}),
c AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn, cell_id) - 1 AS pos FROM cells WHERE cell_type = 'code'),
n AS (SELECT id, count(*) AS len FROM c GROUP BY id),
ix AS (SELECT id, len, CASE WHEN len <= {n} THEN range(0, len)
                            ELSE list_distinct(list_filter(list_transform(range(0, {n} + 1),
                                                lambda j: CAST(round_even(j * len / {n}, 0) AS BIGINT)), lambda x: x < len)) END AS raw FROM n),
ix2 AS (SELECT id, len, CASE WHEN list_contains(list_sort(raw), len - 1) THEN list_sort(raw)
                             ELSE list_slice(list_sort(raw), 1, len(raw) - 1) || [len - 1] END AS idx FROM ix),
p AS (SELECT id, len, unnest(idx) AS pos, unnest(range(0, len(idx))) AS sample_rank FROM ix2)"""


@query("sample_cells", f"""
WITH {_sample_ctes(N_SAMPLE)}
SELECT p.id, CAST(p.sample_rank AS INTEGER) AS sample_rank, c.cell_id,
       CASE WHEN p.len <= {N_SAMPLE} THEN substr(c.source, 1, {CUT}) ELSE c.source END AS source
FROM p JOIN c ON p.id = c.id AND p.pos = c.pos""")
def q_sample_cells(spark, sf):
    return sampled_cells(Tables(spark, sf))


MAIN_MAX, SIDE_TOK, TOTAL_MAX, MAX_SIDE = 24, 8, 64, 20


def _words(col):
    return F.filter(F.split(clean_text(col), " ", -1), lambda x: x != F.lit(""))


def _concat_sql(n: int) -> str:
    return f"""
WITH {_sample_ctes(n)},
w AS (SELECT *, list_filter(string_split({S.clean('source')}, ' '), lambda x: x <> '') AS w FROM (
        SELECT p.id, p.sample_rank, CASE WHEN p.len <= {n} THEN substr(c.source, 1, {CUT}) ELSE c.source END AS source
        FROM p JOIN c ON p.id = c.id AND p.pos = c.pos)),
side AS (SELECT id, flatten(list(list_slice(w, 1, {SIDE_TOK} - 1) ORDER BY sample_rank)) AS s FROM w GROUP BY id),
md AS (SELECT *, list_filter(string_split({S.clean('source')}, ' '), lambda x: x <> '') AS w FROM cells WHERE cell_type = 'markdown'),
t AS (SELECT m.id, m.cell_id, list_slice(list_slice(m.w, 1, {MAIN_MAX}) || coalesce(s.s, []::VARCHAR[]), 1, {TOTAL_MAX}) AS t
      FROM md m LEFT JOIN side s USING (id))
SELECT id, cell_id, list_resize(t, {TOTAL_MAX}, '[PAD]') AS tokens,
       list_resize(list_transform(t, lambda x: 1), {TOTAL_MAX}, 0) AS attention_mask FROM t"""


def _concat(t, n: int):
    """Each markdown cell's words (cut) followed by the leading words (last of each
    dropped) of ``n`` evenly spaced code cells of its notebook, clipped, padded, with
    mask.  The side list of a notebook is bounded (n cells x a few tokens)."""
    code = sampled_cells(t, n).withColumn("w", _words("source"))
    side = code.groupBy("id").agg(F.sort_array(F.collect_list(
        F.struct("sample_rank", F.slice("w", 1, SIDE_TOK - 1).alias("t")))).alias("_s"))
    side = side.select("id", F.flatten(F.transform("_s", lambda x: x["t"])).alias("s"))
    md = cells_frame(t).where(F.col("cell_type") == "markdown").withColumn("w", _words("source")).join(side, "id", "left")
    tok = F.slice(F.concat(F.slice("w", 1, MAIN_MAX), F.coalesce("s", F.array().cast("array<string>"))), 1, TOTAL_MAX)
    md = md.select("id", "cell_id", tok.alias("t"))
    return md.select("id", "cell_id", A.pad_right("t", TOTAL_MAX, "[PAD]").alias("tokens"),
                     A.ones_mask("t", TOTAL_MAX).alias("attention_mask"))


@query("concat_segments", _concat_sql(MAX_SIDE))
def q_concat_segments(spark, sf):
    return _concat(Tables(spark, sf), MAX_SIDE)


@query("concat_segments_2", _concat_sql(2))
def q_concat_segments_2(spark, sf):
    """Two code cells a notebook: fewer than most notebooks have."""
    return _concat(Tables(spark, sf), 2)


PAIR_SIDE, PAIR_LEN = 4, 10


@query("encode_pairs", f"""
WITH {S.PAIR_CTES},
w AS (SELECT p_partkey AS fid, list_filter(string_split({S.clean('p_name')}, ' '), lambda x: x <> '') AS w FROM part),
e AS (SELECT pos.a, pos.b, ['[CLS]'] || list_slice(wa.w, 1, {PAIR_SIDE}) || list_slice(wb.w, 1, {PAIR_SIDE}) AS core
      FROM pos JOIN w wa ON pos.a = wa.fid JOIN w wb ON pos.b = wb.fid)
SELECT a, b, list_resize(list_slice(core, 1, {PAIR_LEN}), {PAIR_LEN}, '[PAD]') AS tokens,
       list_resize(list_transform(list_slice(core, 1, {PAIR_LEN}), lambda x: 1), {PAIR_LEN}, 0) AS attention_mask FROM e""")
def q_encode_pairs(spark, sf):
    """Pair encoding ``[CLS] a b`` (each side cut), clipped, padded, with mask."""
    t = Tables(spark, sf)
    w = t.part.select(F.col("p_partkey").alias("fid"), _words("p_name").alias("w"))
    p = positive_pairs(members_frame(t))
    e = (p.join(w.withColumnRenamed("fid", "a").withColumnRenamed("w", "wa"), "a")
         .join(w.withColumnRenamed("fid", "b").withColumnRenamed("w", "wb"), "b"))
    core = F.slice(F.concat(F.array(F.lit("[CLS]")), F.slice("wa", 1, PAIR_SIDE), F.slice("wb", 1, PAIR_SIDE)), 1, PAIR_LEN)
    return e.select("a", "b", A.pad_right(core, PAIR_LEN, "[PAD]").alias("tokens"),
                    A.ones_mask(core, PAIR_LEN).alias("attention_mask"))


# ---- the same on ids ---------------------------------------------------------------------

def _vocab(words):
    """Ids of the 2000 most frequent words of an array column."""
    return build_vocab(top_tokens(words, "w", 2000))


def _vocab_sql(src: str) -> str:
    return f"""
cnt AS (SELECT tok AS token, count(*) AS c FROM (SELECT unnest(w) AS tok FROM {src}) GROUP BY tok),
vocab AS (SELECT token, CAST({A.VOCAB_BASE} + row_number() OVER (ORDER BY token) - 1 AS INT) AS id
          FROM (SELECT token FROM cnt ORDER BY c DESC, token LIMIT 2000))"""


def _side_sql(src: str, keys: str, size: int) -> str:
    """``keys``, ids and mask of every row of ``src`` (w): looked up, cut, with specials, padded to ``size``."""
    return f"""
SELECT {keys}, list_resize([{A.CLS_ID}] || ids || [{A.SEP_ID}], {size}, {A.PAD_ID}) AS ids,
       list_resize(list_transform(range(len(ids) + 2), lambda i: 1), {size}, 0) AS mask
FROM (SELECT {keys}, coalesce(list(coalesce(v.vid, {A.UNK_ID}) ORDER BY pos) FILTER (t.token IS NOT NULL), []::INT[]) AS ids
      FROM (SELECT {keys}, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE list_slice(w, 1, {size - 2}) END) AS token,
                   unnest(range(greatest(1, least(len(w), {size - 2})))) AS pos FROM {src}) t
      LEFT JOIN (SELECT token, id AS vid FROM vocab) v USING (token) GROUP BY {keys})"""


def encode_side(df, key, words: str, vocab, size: int):
    """(key, ids, mask): a side's words cut to ``size - 2``, looked up, with specials, padded to ``size``."""
    cut = df.select(key, F.slice(words, 1, size - 2).alias("w"))
    core = A.with_specials("input_ids")
    return encode(cut, key, "w", vocab).select(key, A.pad_right(core, size).alias("ids"), A.ones_mask(core, size).alias("mask"))


SIDE_LEN, BOTH_LEN = 6, 10


@query("encode_pairs_ids", f"""
WITH {S.PAIR_CTES},
w AS (SELECT p_partkey AS fid, list_filter(string_split({S.clean('p_name')}, ' '), lambda x: x <> '') AS w FROM part),
{_vocab_sql('w')},
side AS ({_side_sql('w', 'fid', SIDE_LEN)})
SELECT pos.a, pos.b, list_resize(list_slice([{A.CLS_ID}] || x.ids || y.ids, 1, {BOTH_LEN}), {BOTH_LEN}, {A.PAD_ID}) AS input_ids,
       list_resize(list_slice([1] || x.mask || y.mask, 1, {BOTH_LEN}), {BOTH_LEN}, 0) AS attention_mask, 1 AS target
FROM pos JOIN side x ON pos.a = x.fid JOIN side y ON pos.b = y.fid""")
def q_encode_pairs_ids(spark, sf):
    """Pairs on ids: each side looked up, given its specials, cut and padded by itself; a start token and both
    sides, cut to one length, with the mask."""
    t = Tables(spark, sf)
    w = t.part.select(F.col("p_partkey").alias("fid"), _words("p_name").alias("w"))
    side = materialize(encode_side(w, "fid", "w", _vocab(w), SIDE_LEN), "pair-sides")
    a, b = (side.select(F.col("fid").alias(n), F.col("ids").alias(f"i{n}"), F.col("mask").alias(f"m{n}")) for n in "ab")
    e = positive_pairs(members_frame(t)).join(a, "a").join(b, "b")
    ids = F.slice(F.concat(F.array(F.lit(A.CLS_ID)), "ia", "ib"), 1, BOTH_LEN)
    mask = F.slice(F.concat(F.array(F.lit(1)), "ma", "mb"), 1, BOTH_LEN)
    return e.select("a", "b", A.pad_right(ids, BOTH_LEN).alias("input_ids"), A.pad_right(mask, BOTH_LEN, 0).alias("attention_mask"),
                    F.lit(1).alias("target"))


MD_LEN, CODE_LEN, CELLS_LEN = 16, 9, 64


@query("concat_segments_ids", f"""
WITH {_sample_ctes(4)},
k AS (SELECT p.id, p.sample_rank, list_filter(string_split({S.clean('src')}, ' '), lambda x: x <> '') AS w FROM (
        SELECT p.*, CASE WHEN p.len <= 4 THEN substr(c.source, 1, {CUT}) ELSE c.source END AS src
        FROM p JOIN c ON p.id = c.id AND p.pos = c.pos) p),
md AS (SELECT id, cell_id, list_filter(string_split({S.clean('source')}, ' '), lambda x: x <> '') AS w FROM cells WHERE cell_type = 'markdown'),
alltok AS (SELECT w FROM md UNION ALL SELECT w FROM k),
{_vocab_sql('alltok')},
mds AS ({_side_sql('md', 'id, cell_id', MD_LEN)}),
ks AS ({_side_sql('k', 'id, sample_rank', CODE_LEN)}),
s AS (SELECT id, flatten(list(list_slice(ids, 1, {CODE_LEN - 1}) ORDER BY sample_rank)) AS ids,
             flatten(list(list_slice(mask, 1, {CODE_LEN - 1}) ORDER BY sample_rank)) AS mask FROM ks GROUP BY id)
SELECT m.id, m.cell_id, list_resize(list_slice(m.ids || coalesce(s.ids, []::INT[]), 1, {CELLS_LEN}), {CELLS_LEN}, {A.PAD_ID}) AS input_ids,
       list_resize(list_slice(m.mask || coalesce(s.mask, []::INT[]), 1, {CELLS_LEN}), {CELLS_LEN}, 0) AS attention_mask
FROM mds m LEFT JOIN s USING (id)""")
def q_concat_segments_ids(spark, sf):
    """Markdown cells on ids, padded, followed by the ids of four evenly spaced code cells, each padded and
    less its last place; cut to one length, padded, with the mask."""
    t = Tables(spark, sf)
    code = materialize(sampled_cells(t, 4).select("id", "sample_rank", F.struct("id", "sample_rank").alias("key"),
                                                  _words("source").alias("w")), "code-cells")
    md = (cells_frame(t).where(F.col("cell_type") == "markdown")
          .select(F.struct("id", "cell_id").alias("key"), _words("source").alias("w")))
    vocab = materialize(_vocab(md.select("w").unionByName(code.select("w"))), "cell-vocab")
    c = encode_side(code, "key", "w", vocab, CODE_LEN).select("key.id", "key.sample_rank", "ids", "mask")
    # four cells of a few ids each: a bounded list
    side = c.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(
        "sample_rank", F.slice("ids", 1, CODE_LEN - 1).alias("i"), F.slice("mask", 1, CODE_LEN - 1).alias("m")))).alias("s"))
    side = side.select("id", F.flatten(F.transform("s", lambda x: x["i"])).alias("si"), F.flatten(F.transform("s", lambda x: x["m"])).alias("sm"))
    m = encode_side(md, "key", "w", vocab, MD_LEN).select("key.id", "key.cell_id", "ids", "mask").join(side, "id", "left")
    none = F.array().cast("array<int>")
    ids = F.slice(F.concat("ids", F.coalesce("si", none)), 1, CELLS_LEN)
    mask = F.slice(F.concat("mask", F.coalesce("sm", none)), 1, CELLS_LEN)
    return m.select("id", "cell_id", A.pad_right(ids, CELLS_LEN).alias("input_ids"), A.pad_right(mask, CELLS_LEN, 0).alias("attention_mask"))


N_FEATURE_CELLS = 20


def _typed_sql(cell_type: str, name: str) -> str:
    """``name`` (id, texts): the sampled cells of a type, as a list per notebook."""
    ctes = _sample_ctes(N_FEATURE_CELLS).replace("cell_type = 'code'", f"cell_type = '{cell_type}'")
    return f"""{name} AS (
WITH {ctes}
SELECT p.id, list(CASE WHEN p.len <= {N_FEATURE_CELLS} THEN substr(c.source, 1, {CUT}) ELSE c.source END ORDER BY p.sample_rank) AS texts
FROM p JOIN c ON p.id = c.id AND p.pos = c.pos GROUP BY p.id)"""


@query("features_json_cells", f"""
WITH {_typed_sql('code', 'codes')}, {_typed_sql('markdown', 'mds')},
f AS (SELECT id, count_if(cell_type <> 'markdown') AS total_code, count_if(cell_type = 'markdown') AS total_md
      FROM ({S.CELLS}) GROUP BY id)
SELECT f.id, total_code, total_md, coalesce(codes.texts, []::VARCHAR[]) AS codes, coalesce(mds.texts, []::VARCHAR[]) AS mds
FROM f LEFT JOIN codes ON codes.id = f.id LEFT JOIN mds ON mds.id = f.id""")
def q_features_json_cells(spark, sf):
    """Features of every notebook as JSON: counts, and up to twenty evenly spaced code and markdown cells;
    written, and read back with a schema."""
    t = Tables(spark, sf)
    path = scratch_path(spark, "features_cells")
    feats = md_ratio(cells_frame(t), "id").select("id", "total_code", "total_md")
    for kind, name in (("code", "codes"), ("markdown", "mds")):
        cells = sampled_cells(t, N_FEATURE_CELLS, kind)
        # twenty cells a notebook and a little more: a bounded list
        lists = cells.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("sample_rank", "source"))).alias("s"))
        feats = feats.join(lists.select("id", F.transform("s", lambda x: x["source"]).alias(name)), "id", "left") \
            .withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    files.write_features_json(feats, path)
    return files.read_features_json(spark, path, feats.schema)


def _py_quote(c):
    """A string column as Python writes it: double quotes if it has single ones only."""
    t = F.replace(F.col(c), F.lit("\\"), F.lit("\\\\"))
    for raw, written in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ("\x07", "\\x07")):
        t = F.replace(t, F.lit(raw), F.lit(written))
    double = F.contains(F.col(c), F.lit("'")) & ~F.contains(F.col(c), F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), t, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("\\'")), F.lit("'")))


# a tuple's third element with its quotes; the others are strings of either quote or bare
# values; possessive loops keep Java's regex engine from recursing on long literals
_SINGLE, _DOUBLE = (rf"{q}[^{q}\\]*+(?:\\.[^{q}\\]*+)*+{q}" for q in "'\"")
_ANY = rf"(?:{_SINGLE}|{_DOUBLE}|[^,'\"()]++)"
THIRD_FIELD = rf"(?s)\(\s*{_ANY}\s*,\s*{_ANY}\s*,\s*({_SINGLE}|{_DOUBLE})\s*,?\s*\)"


def code_text(lit_col):
    """Instruction text out of a literal list of 3-tuples: third fields, unescaped, space-joined."""
    parts = F.regexp_extract_all(F.col(lit_col), F.lit(THIRD_FIELD), 1)

    def unescape(x):
        x = F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit("\\\\"), F.lit("\u0000"))
        for written, raw in (("\\'", "'"), ('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r")):
            x = F.replace(x, F.lit(written), F.lit(raw))
        # what follows each \x begins with two hexadecimal digits
        cut = F.split(x, r"\\x", -1)
        rest = F.transform(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))), lambda p: F.concat(
            F.chr(F.conv(F.substring(p, 1, 2), 16, 10).cast("int")), F.substring(p, F.lit(3), F.length(p))))
        return F.replace(F.array_join(F.concat(F.slice(cut, 1, 1), rest), ""), F.lit("\u0000"), F.lit("\\"))
    return F.array_join(F.transform(parts, unescape), " ")


# quotes of both kinds, tabs, backslashes and an unprintable character, by turn
_SPICED = ("text || CASE turn % 4 WHEN 0 THEN ' it''s' || chr(9) || 'x' WHEN 1 THEN ' \"quoted\" \\n' || chr(13) "
           "WHEN 2 THEN ' ''both\"' || chr(7) ELSE '' END")


@query("code_text", f"SELECT conv_id, string_agg({_SPICED}, ' ' ORDER BY turn) AS code FROM conversations GROUP BY conv_id")
def q_code_text(spark, sf):
    """Round trip: each conversation rendered as a literal list of (turn or name, role, text)
    tuples, then parsed back to its instruction text."""
    spice = F.create_map(*[x for k, v in enumerate([" it's\tx", ' "quoted" \\n\r', " 'both\"\x07", ""]) for x in (F.lit(k), F.lit(v))])
    c = Tables(spark, sf).conversations.select(
        "conv_id", "turn", "role", F.concat("text", F.element_at(spice, (F.col("turn") % 4).cast("int"))).alias("text"))
    c = c.withColumn("name", F.concat(F.lit("0x"), F.col("turn").cast("string")))
    first = F.when(F.col("turn") % 2 == 0, F.col("turn").cast("string")).otherwise(_py_quote("name"))
    tup = F.concat(F.lit("("), first, F.lit(", "), _py_quote("role"), F.lit(", "), _py_quote("text"), F.lit(")"))
    lits = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", tup.alias("s")))).alias("_l"))
    lits = lits.select("conv_id", F.concat(F.lit("["), F.array_join(F.transform("_l", lambda x: x["s"]), ", "),
                                           F.lit("]")).alias("code_literal"))
    return lits.select("conv_id", code_text("code_literal").alias("code"))
