"""DuckDB SQL fragments mirroring the Spark column helpers (for oracles only)."""

from __future__ import annotations

WS = r"[\t\n\x0B\f\r ]"


def h(seed, *keys) -> str:
    inner = ", ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"md5(concat_ws('|', {inner}))"


def u(seed, *keys) -> str:
    return f"(('0x' || substr({h(seed, *keys)}, 1, 8))::BIGINT / 4294967296.0)"


def clean(c: str) -> str:
    t = f"regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_]', ' ', 'g')"
    t = f"replace({t}, '_', ' ')"
    t = f"regexp_replace({t}, ' +[a-zA-Z] +', ' ', 'g')"
    t = f"regexp_replace({t}, ' +', ' ', 'g')"
    return f"lower({t})"


def ari_chars(c):
    return f"length(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"


def ari_words(c):
    return f"len(list_filter(regexp_split_to_array({c}, '{WS}+'), lambda w: w <> ''))"


def ari_sents(c):
    return f"greatest(len(list_filter(regexp_split_to_array({c}, '[.!?]+'), lambda s: trim(s) <> '')), 1)"


def ari(c):
    w = f"greatest({ari_words(c)}, 1)"
    return f"(4.71 * {ari_chars(c)} / {w} + 0.5 * {w} / {ari_sents(c)} - 21.43)"


ESSAY = f"""
SELECT doc_id, lang, source, {clean('text')} AS clean,
       round({ari('text')}, 6) AS t_ari,
       round({ari_chars('text')} / greatest({ari_words('text')}, 1), 6) AS t_wlen,
       round(ln(1 + n_chars), 6) AS t_loglen
FROM documents
"""

ESSAY_LONG = """
SELECT doc_id, lang, source, 't_ari' AS target, CAST(t_ari AS DOUBLE) AS y FROM essay
UNION ALL SELECT doc_id, lang, source, 't_wlen', CAST(t_wlen AS DOUBLE) FROM essay
UNION ALL SELECT doc_id, lang, source, 't_loglen', CAST(t_loglen AS DOUBLE) FROM essay
"""


def group_folds(src: str, group: str, k: int = 5, seed: int = 42) -> str:
    return f"""
SELECT {group}, CAST((row_number() OVER (ORDER BY {h(seed, group)}, {group}) - 1) % {k} AS INTEGER) AS kfold
FROM (SELECT DISTINCT {group} FROM {src} WHERE {group} IS NOT NULL)
"""


# long essay table with group folds on source and group-mean OOF predictions by lang
OOF_CTES = f"""
essay AS ({ESSAY}),
folds AS ({group_folds('essay', 'source')}),
long AS (SELECT l.*, f.kfold FROM ({ESSAY_LONG}) l LEFT JOIN folds f USING (source)),
gf AS (SELECT lang, kfold, target, sum(CAST(y AS DECIMAL(38,6))) AS sgf, count(y) AS ngf FROM long GROUP BY lang, kfold, target),
g AS (SELECT lang, target, sum(sgf) AS sg, sum(ngf) AS ng FROM gf GROUP BY lang, target),
f AS (SELECT kfold, target, sum(sgf) AS sf, sum(ngf) AS nf FROM gf GROUP BY kfold, target),
a AS (SELECT target, sum(sgf) AS s, sum(ngf) AS n FROM gf GROUP BY target),
stats AS (
  SELECT gf.lang, gf.kfold, gf.target,
         CASE WHEN g.ng > gf.ngf THEN CAST(g.sg - gf.sgf AS DOUBLE) / (g.ng - gf.ngf)
              WHEN a.n > f.nf THEN CAST(a.s - f.sf AS DOUBLE) / (a.n - f.nf) END AS pred
  FROM gf JOIN g USING (lang, target) JOIN f USING (kfold, target) JOIN a USING (target)),
oof AS (SELECT long.*, stats.pred FROM long LEFT JOIN stats USING (lang, kfold, target))
"""


CELLS = """
SELECT conv_id AS id, substr(md5(concat_ws('|', 'cell', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR))), 1, 8) AS cell_id,
       CASE WHEN role = 'user' THEN 'markdown' ELSE 'code' END AS cell_type, turn, text AS source
FROM conversations
"""

# cells with their true rank and the predicted score: markdown = hashed model stand-in,
# code = average-tie percentile rank of the true position inside (id, cell_type)
PRED_CTES = f"""
cells AS ({CELLS}),
scored AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn, cell_id) - 1 AS rank,
         CASE WHEN cell_type = 'markdown' THEN {u(1, 'cell_id')}
              ELSE (rank() OVER (PARTITION BY id, cell_type ORDER BY turn)
                    + (count(*) OVER (PARTITION BY id, cell_type, turn) - 1) / 2.0)
                   / count(*) OVER (PARTITION BY id, cell_type) END AS pred
  FROM cells),
placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pred, cell_id) - 1 AS pred_pos FROM scored)
"""


TOKENS = f"SELECT doc_id, list_filter(string_split({clean('text')}, ' '), lambda x: x <> '') AS tokens FROM documents"

VOCAB_CTES = f"""
toks AS ({TOKENS}),
tok_cnt AS (SELECT tok AS token, count(*) AS cnt FROM (SELECT unnest(tokens) AS tok FROM toks) GROUP BY tok),
top AS (SELECT token FROM tok_cnt ORDER BY cnt DESC, token LIMIT 2000),
lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
ff AS (SELECT list_filter(string_split({clean('line')}, ' '), lambda x: x <> '')[1] AS token FROM lines),
vocab AS (SELECT token, CAST(1000 + row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS id
          FROM (SELECT token FROM top UNION SELECT token FROM ff WHERE token IS NOT NULL)),
tok_pos AS (SELECT doc_id, unnest(tokens) AS token, unnest(generate_series(1, len(tokens))) AS pos FROM toks),
enc0 AS (SELECT doc_id, list(CAST(coalesce(v.id, 100) AS INTEGER) ORDER BY pos) AS input_ids
         FROM tok_pos LEFT JOIN vocab v USING (token) GROUP BY doc_id),
enc AS (SELECT d.doc_id, coalesce(e.input_ids, []::INTEGER[]) AS input_ids FROM documents d LEFT JOIN enc0 e USING (doc_id))
"""


MEMBERS = "SELECT CAST(regexp_extract(p_brand, '#([0-9]+)', 1) AS BIGINT) AS gid, p_partkey AS fid FROM part"


def ranked_sql(src, part, idc, seed, out):
    return (f"SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {h(seed, idc)}, {idc}) - 1 AS {out}, "
            f"count(*) OVER (PARTITION BY {part}) AS {out}_n FROM {src}")


PAIR_CTES = f"""
members AS ({MEMBERS}),
gb AS (SELECT gid, CAST(floor((row_number() OVER (ORDER BY {h(42, 'gid')}, gid) - 1) * 5 / count(*) OVER ()) AS INTEGER) AS block
       FROM (SELECT DISTINCT gid FROM members)),
mb AS (SELECT m.*, gb.block FROM members m JOIN gb USING (gid)),
pr AS ({ranked_sql('members', 'gid', 'fid', 42, 'r')}),
pos AS (SELECT a.fid AS a, b.fid AS b, 1 AS label FROM pr a
        JOIN (SELECT * FROM pr) b ON a.gid = b.gid AND b.r = (a.r + 1) % a.r_n WHERE a.r_n > 1),
bs AS ({ranked_sql('mb', 'block', 'fid', 42, 's')}),
dr AS (SELECT bs.block, bs.gid, bs.fid AS a, d.draw,
              CAST(floor({u(43, 'bs.fid', 'd.draw')} * bs.s_n) AS BIGINT) AS s
       FROM bs, (SELECT unnest(generate_series(0, 29)) AS draw) d),
draws AS (SELECT dr.a, t.fid AS b, dr.draw FROM dr JOIN bs t ON dr.block = t.block AND dr.s = t.s WHERE t.gid <> dr.gid),
firsts AS (SELECT a, b, min(draw) AS draw FROM draws GROUP BY a, b),
neg AS (SELECT a, b, 0 AS label FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY draw) AS k FROM firsts) WHERE k <= 10)
"""


LONG_CTES = f"""
essay AS ({ESSAY}),
folds AS ({group_folds('essay', 'source')}),
long AS (SELECT l.*, 'all' AS all_, f.kfold FROM ({ESSAY_LONG}) l LEFT JOIN folds f USING (source)),
fm_m AS (SELECT CAST(unnest(generate_series(0, 4)) AS INTEGER) AS model_fold)
"""


def fold_models(src: str, g: str, y: str = "y", target: str = "target", name: str | None = None) -> str:
    """CTEs ``fm_<name>``: every row of ``src`` with the 5 fold-model group-mean predictions."""
    n = name or g
    return f"""
fm_gf_{n} AS (SELECT {g}, kfold, {target}, sum(CAST({y} AS DECIMAL(38,6))) AS s, count({y}) AS n FROM {src} GROUP BY {g}, kfold, {target}),
fm_gm_{n} AS (SELECT {g}, {target}, model_fold, sum(s) AS sg, sum(n) AS ng FROM fm_gf_{n}, fm_m WHERE kfold <> model_fold GROUP BY {g}, {target}, model_fold),
fm_am_{n} AS (SELECT {target}, model_fold, sum(s) AS sa, sum(n) AS na FROM fm_gf_{n}, fm_m WHERE kfold <> model_fold GROUP BY {target}, model_fold),
fm_grid_{n} AS (
  SELECT d.{g}, d.{target}, fm_m.model_fold,
         CASE WHEN gm.ng > 0 THEN CAST(gm.sg AS DOUBLE) / gm.ng WHEN am.na > 0 THEN CAST(am.sa AS DOUBLE) / am.na END AS pred
  FROM (SELECT DISTINCT {g}, {target} FROM {src}) d CROSS JOIN fm_m
  LEFT JOIN fm_gm_{n} gm ON gm.{g} = d.{g} AND gm.{target} = d.{target} AND gm.model_fold = fm_m.model_fold
  LEFT JOIN fm_am_{n} am ON am.{target} = d.{target} AND am.model_fold = fm_m.model_fold),
fm_{n} AS (SELECT s.*, gr.model_fold, gr.pred FROM {src} s JOIN fm_grid_{n} gr ON gr.{g} = s.{g} AND gr.{target} = s.{target})
"""


RUNS = ["lang", "source", "all_"]
RUN_CTES = LONG_CTES + "," + ",".join(fold_models("long", g) for g in RUNS) + """,
oof_runs AS (
  SELECT 'lang' AS run, doc_id, target, y, pred FROM fm_lang WHERE model_fold = kfold
  UNION ALL SELECT 'source', doc_id, target, y, pred FROM fm_source WHERE model_fold = kfold
  UNION ALL SELECT 'all', doc_id, target, y, pred FROM fm_all_ WHERE model_fold = kfold)
"""

# binary labels (quality) with group folds; 15 models = 3 groupings x 5 folds
CLS_BODY = f"""
lab AS (SELECT d.doc_id, d.lang, d.source, 'all' AS all_, 'quality' AS target, CAST(l.quality AS DOUBLE) AS y
        FROM documents d JOIN labels l USING (doc_id)),
cfolds AS ({group_folds('documents', 'source')}),
clab AS (SELECT lab.*, f.kfold FROM lab LEFT JOIN cfolds f USING (source)),
{fold_models('clab', 'lang', name='c_lang')}, {fold_models('clab', 'source', name='c_source')}, {fold_models('clab', 'all_', name='c_all')},
probs AS (
  SELECT 'lang_' || model_fold AS run, 0 AS grp, model_fold, doc_id, y, pred AS p FROM fm_c_lang
  UNION ALL SELECT 'source_' || model_fold, 1, model_fold, doc_id, y, pred FROM fm_c_source
  UNION ALL SELECT 'all_' || model_fold, 2, model_fold, doc_id, y, pred FROM fm_c_all),
votes AS (SELECT doc_id, y, sum(CASE WHEN grp = 0 THEN 0.2 ELSE 0.07 END * CAST(p >= 0.5 AS INTEGER)) AS score FROM probs GROUP BY doc_id, y)
"""

CLS_CTES = "fm_m AS (SELECT CAST(unnest(generate_series(0, 4)) AS INTEGER) AS model_fold),\n" + CLS_BODY
