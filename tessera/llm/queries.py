"""The registered queries: each numbered operator over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (decontaminate, language_id, lm_score, near_dedup, packing, ranked_search, secret_scan, suffix_dedup,
               toxicity)
from .collocations import collocations
from .common import documents, remainder
from .line_dedup import remove_boilerplate
from .quality_rules import judge_documents
from .registry import query
from .substring_dedup import remove_repeats


@query("op1_language_id")
def op1_language_id(spark, sf_dir):
    """Learned from the documents that are not held out; every document predicted."""
    docs = documents(spark, sf_dir)
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = language_id.train(docs, ~held_out)
    found = language_id.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
                        F.col("lang_rejected").alias("rejected"))


@query("op2_substring_dedup")
def op2_substring_dedup(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir), window=50)


@query("op3_secret_scan")
def op3_secret_scan(spark, sf_dir):
    return secret_scan.digest(secret_scan.find_secrets(documents(spark, sf_dir)))


@query("op4_lm_score")
def op4_lm_score(spark, sf_dir):
    """Learned from the documents that are not held out; every document scored."""
    scored = lm_score.score(documents(spark, sf_dir), remainder(F.col("doc_id"), 10) != 0)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


@query("op5_minhash_near_dedup")
def op5_minhash_near_dedup(spark, sf_dir):
    return near_dedup.components(documents(spark, sf_dir), words=4, percent=80)


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir))


@query("op7_suffix_dedup")
def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), length=200)


@query("op8_line_dedup", sql=r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw,
         generate_subscripts(string_split(text, chr(10)), 1) AS idx FROM documents),
t AS (SELECT doc_id, source, idx, trim(raw, ' ') AS line FROM l),
b AS (SELECT line, min((doc_id, idx)) AS first FROM t WHERE length(line) >= 16
      GROUP BY line HAVING count(DISTINCT source) >= 5),
m AS (SELECT l.doc_id, l.idx, l.raw, b.line IS NOT NULL AND (l.doc_id, l.idx) <> b.first AS gone
      FROM l JOIN t USING (doc_id, idx) LEFT JOIN b ON t.line = b.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed_lines,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY idx) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
""")
def op8_line_dedup(spark, sf_dir):
    """Every document: its lines, how many went as cross-site boilerplate, sha256 of the rest."""
    kept = remove_boilerplate(documents(spark, sf_dir), counts=True)
    return kept.select("doc_id", "n_lines", "n_removed_lines",
                       F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query("op9_decontamination")
def op9_decontamination(spark, sf_dir):
    """Documents that hold a benchmark item, exact or edited."""
    return decontaminate.find_leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


@query("op10_quality_rules")
def op10_quality_rules(spark, sf_dir):
    return judge_documents(documents(spark, sf_dir))


@query("op11_phrase_mining", sql=r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS no
  FROM (SELECT lang, doc_id, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
t AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i
          FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(words) >= k))
  GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k >= 2),
cut AS (
  SELECT lang, phrase, a, words, unnest(range(1, k)) AS cut FROM c),
s AS (
  SELECT cut.lang, cut.phrase, a, cut, x.f AS l, y.f AS r, t.n,
         (1000::HUGEINT * a * t.n // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(words[1:cut], ' ')
  JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(words[cut + 1:], ' ')
  JOIN t ON t.lang = cut.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
g AS (SELECT DISTINCT x.lang, x.phrase FROM c x JOIN c y ON x.lang = y.lang AND y.k > x.k
      AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ') AND 100 * y.a >= 100 * x.a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
      FROM b WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM g))
SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= 2000
""")
def op11_phrase_mining(spark, sf_dir):
    """Each language's best 2000 collocations."""
    return collocations(documents(spark, sf_dir))


@query("op12_ranked_search", sql=r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS n, sum(n)::BIGINT AS l FROM d),
v AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * c.n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM v, c GROUP BY term, c.n),
m AS (SELECT doc_id, (100 - 50 + (50 * d.n * c.n) // c.l)::BIGINT AS m FROM d, c),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM q JOIN v USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
""")
def op12_ranked_search(spark, sf_dir):
    """The 50 documents that answer each benchmark item best."""
    return ranked_search.search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


@query("op13_toxicity")
def op13_toxicity(spark, sf_dir):
    """Learned from the labels of documents that are not held out; every document scored."""
    docs, held_out = documents(spark, sf_dir), remainder(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs, documents(spark, sf_dir, "labels"), ~held_out)
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score",
                        (F.col("score") >= toxicity.LIMIT).cast("int").alias("predicted"), "n_windows")
