"""Text and token-array plans over ``documents`` (and a few tabular text columns)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import text as X
from tessera.functions.hashing import hash_hex, uniform
from tessera.operators.ranking import hashed_rank
from tessera.operators.vocab import top_tokens
from tessera.plans import sql as S
from tessera.plans.common import STOP_WORDS, doc_tokens, encoded_docs, vocab_frame
from tessera.operators.features import map_values
from tessera.plans.registry import query
from tessera.sources.tables import Tables

L = 64
SPECIALS_SQL = "[" + ", ".join(str(s) for s in A.SPECIAL_IDS) + "]"
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
CORE_SQL = f"[{A.CLS_ID}] || list_slice(input_ids, 1, {L - 2}) || [{A.SEP_ID}]"
FULL_SQL = f"[{A.CLS_ID}] || input_ids || [{A.SEP_ID}]"


@query("top_tokens", r"""
SELECT tok AS token, count(*) AS cnt
FROM (SELECT unnest(regexp_split_to_array(text, '\t| |\*|\(|\)')) AS tok FROM documents)
GROUP BY tok ORDER BY cnt DESC, token LIMIT 2000""")
def q_top_tokens(spark, sf):
    d = Tables(spark, sf).documents.select(X.code_tokens("text").alias("tokens"))
    return top_tokens(d, "tokens", 2000)


@query("build_vocab", f"WITH {S.VOCAB_CTES} SELECT token, id FROM vocab")
def q_build_vocab(spark, sf):
    return vocab_frame(Tables(spark, sf))


@query("encode_tokens", f"WITH {S.VOCAB_CTES} SELECT doc_id, input_ids FROM enc")
def q_encode_tokens(spark, sf):
    return encoded_docs(Tables(spark, sf))


@query("ngram_counts", f"""
WITH t AS (SELECT list_filter(string_split(lower(text), ' '), lambda x: x <> '' AND NOT list_contains({STOP_SQL}, x)) AS toks
           FROM documents),
g AS (SELECT unnest(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) AS ngram FROM t)
SELECT ngram, count(*) AS cnt FROM g GROUP BY ngram""")
def q_ngram_counts(spark, sf):
    d = Tables(spark, sf).documents
    g = d.select(F.explode(X.ngrams(X.word_tokens("text", STOP_WORDS), 2)).alias("ngram"))
    return g.groupBy("ngram").agg(F.count(F.lit(1)).alias("cnt"))


@query("token_length_stats", f"""
WITH t AS ({S.TOKENS}), d AS (
  SELECT least(len(t.tokens), 5000) AS n_tok, length(text) AS n_chars, len(string_split(text, chr(10))) AS n_lines
  FROM documents JOIN t USING (doc_id))
SELECT CAST(max(n_tok) AS BIGINT) AS max_tokens, round(avg(n_tok), 6) AS mean_tokens, CAST(min(n_tok) AS BIGINT) AS min_tokens,
       round(avg(n_chars), 6) AS mean_chars, round(avg(n_lines), 6) AS mean_lines FROM d""")
def q_token_length_stats(spark, sf):
    t = Tables(spark, sf)
    d = t.documents.join(doc_tokens(t), "doc_id").select(
        F.least(F.size("tokens"), F.lit(5000)).alias("n_tok"),
        X.char_count("text").alias("n_chars"), X.line_count("text").alias("n_lines"))
    return d.agg(F.max("n_tok").cast("bigint").alias("max_tokens"), F.round(F.avg("n_tok"), 6).alias("mean_tokens"),
                 F.min("n_tok").cast("bigint").alias("min_tokens"), F.round(F.avg("n_chars"), 6).alias("mean_chars"),
                 F.round(F.avg("n_lines"), 6).alias("mean_lines"))


@query("truncate_pad", f"""
WITH {S.VOCAB_CTES}
SELECT doc_id, list_resize({CORE_SQL}, {L}, 0) AS input_ids,
       list_resize(list_transform({CORE_SQL}, lambda x: 1), {L}, 0) AS attention_mask FROM enc""")
def q_truncate_pad(spark, sf):
    e = encoded_docs(Tables(spark, sf), lambda x: F.slice(x, 1, L - 2))
    ids, mask = A.truncate_pad("input_ids", L)
    return e.select("doc_id", ids.alias("input_ids"), mask.alias("attention_mask"))


@query("random_truncate", f"""
WITH {S.VOCAB_CTES},
f AS (SELECT doc_id, [{A.CLS_ID}] || input_ids || [{A.SEP_ID}] AS a, {S.u(3, 'doc_id')} AS u, {S.u(4, 'doc_id')} AS u2 FROM enc),
c AS (SELECT doc_id, u, u2,
        CASE WHEN len(a) <= {L} THEN a WHEN u <= 0.33 THEN list_slice(a, 1, {L})
             WHEN u >= 0.66 THEN list_slice(a, len(a) - {L} + 1, len(a))
             ELSE list_slice(a, CAST(floor(u2 * (len(a) - {L} + 1)) AS INTEGER) + 1,
                             CAST(floor(u2 * (len(a) - {L} + 1)) AS INTEGER) + {L}) END AS cut FROM f),
p AS (SELECT *, greatest({L} - len(cut), 0) AS missing FROM c),
q AS (SELECT *, CASE WHEN u <= 0.33 THEN 0 WHEN u >= 0.66 THEN missing ELSE CAST(floor(u2 * (missing + 1)) AS INTEGER) END AS lft FROM p)
SELECT doc_id,
       list_resize([]::INTEGER[], lft, 0) || cut || list_resize([]::INTEGER[], missing - lft, 0) AS input_ids,
       list_resize([]::INTEGER[], lft, 0) || list_transform(cut, lambda x: 1) || list_resize([]::INTEGER[], missing - lft, 0) AS attention_mask
FROM q""")
def q_random_truncate(spark, sf):
    u, u2 = uniform(3, "doc_id"), uniform(4, "doc_id")
    markers = {"[CLS]": A.CLS_ID, "[SEP]": A.SEP_ID}  # cleaned words have no brackets
    first, last = (F.array(F.lit(m)) for m in markers)
    e = encoded_docs(Tables(spark, sf), lambda x: A.side_cut(F.concat(first, x, last), L, u, u2), markers)
    ids, mask = A.side_pad("input_ids", L, u, u2)
    return e.select("doc_id", ids.alias("input_ids"), mask.alias("attention_mask"))


@query("batch_pad", f"""
WITH {S.VOCAB_CTES},
c AS (SELECT doc_id, {CORE_SQL} AS core,
             CAST((row_number() OVER (ORDER BY {S.h(5, 'doc_id')}, doc_id) - 1) // 8 AS BIGINT) AS batch FROM enc),
m AS (SELECT *, max(len(core)) OVER (PARTITION BY batch) AS blen FROM c)
SELECT doc_id, batch, list_resize(core, blen, 0) AS input_ids,
       list_resize(list_transform(core, lambda x: 1), blen, 0) AS attention_mask FROM m""")
def q_batch_pad(spark, sf):
    e = encoded_docs(Tables(spark, sf), lambda x: F.slice(x, 1, L - 2)).withColumn("core", A.with_specials("input_ids", L))
    r = hashed_rank(e.withColumn("_h", hash_hex(5, "doc_id")), "_h", ["doc_id"], out="_r")
    b = r.withColumn("batch", F.floor(F.col("_r") / 8).cast("bigint"))
    # a batch holds at most 8 rows: the window is bounded by construction
    b = b.withColumn("_blen", F.max(F.size("core")).over(Window.partitionBy("batch")))
    return b.select("doc_id", "batch",
                    F.concat("core", F.array_repeat(F.lit(A.PAD_ID), F.col("_blen") - F.size("core"))).alias("input_ids"),
                    F.concat(F.transform("core", lambda x: F.lit(1)),
                             F.array_repeat(F.lit(0), F.col("_blen") - F.size("core"))).alias("attention_mask"))


@query("label_suffix", f"""
WITH {S.VOCAB_CTES}
SELECT doc_id,
       {FULL_SQL} || [{A.SEP_ID}, CAST(round_even(2.0 * quality, 0) + 1 AS INTEGER), {A.SEP_ID}, CAST(round_even(2.0 * toxic, 0) + 1 AS INTEGER)] AS input_ids,
       list_transform({FULL_SQL}, lambda x: 1) || [1, 1, 1, 1] AS attention_mask
FROM enc JOIN labels USING (doc_id)""")
def q_label_suffix(spark, sf):
    t = Tables(spark, sf)
    e = encoded_docs(t).join(t.labels, "doc_id")
    core = A.with_specials("input_ids")
    ids, mask = A.label_suffix(core, A.ones_mask(core), ["quality", "toxic"])
    return e.select("doc_id", ids.alias("input_ids"), mask.alias("attention_mask"))


@query("mask_tokens", f"""
WITH {S.VOCAB_CTES},
c AS (SELECT doc_id, {FULL_SQL} AS core FROM enc)
SELECT doc_id,
  list_transform(core, lambda x, i: CASE WHEN (('0x' || substr(md5(concat_ws('|', '42', CAST(doc_id AS VARCHAR), CAST((i - 1) // 4 AS VARCHAR))), (i - 1) % 4 * 8 + 1, 8))::BIGINT / 4294967296.0) < 0.15
                                      AND NOT list_contains({SPECIALS_SQL}, x) THEN {A.MASK_ID} ELSE x END) AS input_ids,
  list_transform(core, lambda x, i: CASE WHEN (('0x' || substr(md5(concat_ws('|', '42', CAST(doc_id AS VARCHAR), CAST((i - 1) // 4 AS VARCHAR))), (i - 1) % 4 * 8 + 1, 8))::BIGINT / 4294967296.0) < 0.15
                                      AND NOT list_contains({SPECIALS_SQL}, x) THEN x ELSE {A.IGNORE_LABEL} END) AS labels
FROM c""")
def q_mask_tokens(spark, sf):
    e = encoded_docs(Tables(spark, sf)).select("doc_id", A.with_specials("input_ids").alias("ids"))
    h = e.select("doc_id", "ids", A.mask_hits("ids", "doc_id", p=0.15, seed=42).alias("hits"))
    masked, labels = A.apply_mask("ids", "hits")
    return h.select("doc_id", masked.alias("input_ids"), labels.alias("labels"))


@query("mask_ngrams")
def q_mask_ngrams(spark, sf):
    """N-gram masking (row-sequential greedy cover) as an Arrow UDF; rows-only check."""
    e, vocab = encoded_docs(Tables(spark, sf), with_vocab=True)
    v = vocab.agg(F.max("id").alias("m")).first()["m"] or A.VOCAB_BASE
    m = A.mask_ngrams(A.with_specials("input_ids"), "doc_id", vocab_size=int(v) + 1)
    return e.select("doc_id", m.alias("m")).select("doc_id", "m.input_ids", "m.labels")


MASK_LEN = 128
_U = "(('0x' || substr(h, {0}, 8))::BIGINT / 4294967296.0)"


@query("mask_ngrams_keyed", f"""
WITH {S.VOCAB_CTES},
m AS (SELECT max(id) + 1 AS size FROM vocab),
c AS (SELECT doc_id, [{A.CLS_ID}] || list_slice(input_ids, 1, {MASK_LEN - 2}) || [{A.SEP_ID}] AS ids FROM enc),
p AS (SELECT doc_id, ids, unnest(ids) AS x, unnest(range(0, len(ids))) AS i FROM c),
d AS (SELECT *, md5(concat_ws('|', '42', CAST(doc_id AS VARCHAR), CAST(i AS VARCHAR))) AS h FROM p),
e AS (SELECT *, CASE WHEN {_U.format(9)} < 6.0 / 11 THEN 1 WHEN {_U.format(9)} < 9.0 / 11 THEN 2 ELSE 3 END AS n,
             {_U.format(17)} AS r, {_U.format(25)} AS v FROM d),
f AS (SELECT doc_id, any_value(ids) AS ids, greatest(1, CAST(round_even(0.15 * count(*), 0) AS INT)) AS most,
             list([i, n] ORDER BY substr(h, 1, 8), i) AS visits FROM e WHERE NOT list_contains({SPECIALS_SQL}, x) GROUP BY doc_id),
g AS (SELECT doc_id, list_reduce(visits, lambda have, x: CASE WHEN len(have) >= most OR list_contains(have, x[1]) THEN have
        ELSE list_concat(have, list_filter(range(x[1], x[1] + x[2]), lambda j: j < len(ids)
             AND NOT list_contains({SPECIALS_SQL}, ids[j + 1]) AND NOT list_contains(have, j))) END, CAST([] AS BIGINT[])) AS hit FROM f)
SELECT e.doc_id,
       list(CAST(CASE WHEN NOT coalesce(list_contains(hit, i), FALSE) THEN x WHEN r < 0.8 THEN {A.MASK_ID} WHEN r < 0.9 THEN x
                      ELSE {A.VOCAB_BASE} + floor(v * (m.size - {A.VOCAB_BASE})) END AS INT) ORDER BY i) AS input_ids,
       list(CASE WHEN coalesce(list_contains(hit, i), FALSE) THEN x ELSE {A.IGNORE_LABEL} END ORDER BY i) AS labels
FROM e LEFT JOIN g USING (doc_id), m GROUP BY e.doc_id""")
def q_mask_ngrams_keyed(spark, sf):
    """N-gram masking as a fold over keyed draws, for the first 126 tokens of every document."""
    e, vocab = encoded_docs(Tables(spark, sf), cut=lambda c: F.slice(c, 1, MASK_LEN - 2), with_vocab=True)
    size = int(vocab.agg(F.max("id").alias("m")).first()["m"] or A.VOCAB_BASE) + 1
    ids = e.select("doc_id", A.with_specials("input_ids").alias("ids"))
    m = ids.select("doc_id", A.mask_ngrams_keyed("ids", "doc_id", size).alias("m"))
    return m.select("doc_id", "m.input_ids", "m.labels")


@query("distinct_texts", r"""
SELECT DISTINCT trim(regexp_replace(text, '[\t\n\x0B\f\r ]+', ' ', 'g')) AS text FROM conversations""")
def q_distinct_texts(spark, sf):
    return Tables(spark, sf).conversations.select(X.collapse_ws("text").alias("text")).distinct()


# Title -> title class dictionary of the tabular tutorial.
TITLE_CLASSES = {
    "Capt": "Officer", "Col": "Officer", "Major": "Officer", "Jonkheer": "Royalty", "Don": "Royalty",
    "Sir": "Royalty", "Dr": "Officer", "Rev": "Officer", "the Countess": "Royalty", "Dona": "Royalty",
    "Mme": "Mrs", "Mlle": "Miss", "Ms": "Mrs", "Mr": "Mr", "Mrs": "Mrs", "Miss": "Miss",
    "Master": "Master", "Lady": "Royalty",
}
_TITLE_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in TITLE_CLASSES.items()) + "}"


@query("title_map", f"""
WITH t AS (SELECT doc_id, trim(string_split(string_split(text, ',')[2], '.')[1]) AS title FROM documents)
SELECT doc_id, title, {_TITLE_SQL}[title] AS title_class FROM t""")
def q_title_map(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", X.title_of("text").alias("title"))
    m = F.create_map(*[F.lit(x) for kv in TITLE_CLASSES.items() for x in kv])
    return d.select("doc_id", "title", F.try_element_at(m, F.col("title")).alias("title_class"))


@query("role_map", """
SELECT conv_id, turn, CASE role WHEN 'user' THEN 'markdown' WHEN 'assistant' THEN 'code' END AS cell_type FROM conversations""")
def q_role_map(spark, sf):
    """Dictionary map of a column whose values are keys."""
    c = Tables(spark, sf).conversations
    return c.select("conv_id", "turn", map_values("role", {"user": "markdown", "assistant": "code"}).alias("cell_type"))


@query("cabin_letter", """
SELECT d.doc_id, substr(coalesce(CAST(l.quality AS VARCHAR), 'U'), 1, 1) AS cabin FROM documents d LEFT JOIN labels l USING (doc_id)""")
def q_cabin_letter(spark, sf):
    t = Tables(spark, sf)
    j = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return j.select("doc_id", X.first_letter_or(F.col("quality").cast("string")).alias("cabin"))


_TICKET_SQL = ("coalesce(list_filter(regexp_split_to_array(trim(regexp_replace({c}, '[./]', '', 'g')), '\\s+'), "
               "lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9]+$'))[1], 'XXX')")


@query("ticket_prefix", f"""
SELECT p_partkey, {_TICKET_SQL.format(c='p_name')} AS name_prefix,
       {_TICKET_SQL.format(c='CAST(p_size AS VARCHAR)')} AS size_prefix FROM part""")
def q_ticket_prefix(spark, sf):
    p = Tables(spark, sf).part
    return p.select("p_partkey", X.ticket_prefix("p_name").alias("name_prefix"),
                    X.ticket_prefix(F.col("p_size").cast("string")).alias("size_prefix"))


@query("file_stem", r"""
SELECT page_id, CASE WHEN contains(url, '.') THEN array_to_string(list_slice(string_split(url, '.'), 1, -2), '_') ELSE url END AS stem
FROM pages""")
def q_file_stem(spark, sf):
    return Tables(spark, sf).pages.select("page_id", X.file_stem("url").alias("stem"))
