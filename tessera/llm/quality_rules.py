"""Quality rules by distribution divergence, in built-in expressions only.

Each text becomes two histograms: characters by class (lower-case ASCII, space,
upper-case ASCII, digit, beyond ASCII, symbol, other) and common function words (all
other words are one more cell).  The language references are the same histograms summed
over every document of a language.  A document passes when the Jensen-Shannon distance
of each of its histograms to its reference stays within a limit.  Histograms of short
texts say little: below ``min_chars`` or ``min_words`` the respective test is not made.

One pass reads the texts; the reference is a sum of counts, so a hot language is
summed up before its rows are shuffled.

Nulls: a null text has no words (base rules fail it); a null language is measured
against the sum of all languages.  Ties do not arise.  Texts are read whole, at
any length; other columns, whatever their names, are ignored.  Repeated rows give repeated
results.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

from .common import SEPARATORS

# Frequent function words of English, French, German and Spanish.
COMMON_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "with",
    "de", "la", "le", "et", "les", "des", "en", "un", "que", "pour",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "ist",
    "el", "los", "y", "las", "por", "una", "para",
]
CHAR_CLASSES = ["lower", "space", "upper", "digit", "wide", "symbol", "other"]
SYMBOLS = "[#*$%&|<>]+"
#: a language table up to this many rows is broadcast
MAX_BROADCAST_LANGUAGES = 10_000


def _words(text: str) -> str:
    return f"array_remove(split({text}, r'{SEPARATORS}'), '')"


# Words in 8-word windows found twice or more.  ``transform(array(x), v -> ...)[0]`` binds
# x once; without it the optimizer could inline x into the inner lambda and work it out
# again for every element.  A window is the hash of its eight words.  When all windows
# differ the answer is 0; otherwise equal windows are neighbours after a sort, and each
# found one covers 8 words or as many as lie before the next found one.
REPEATED = """
transform(array(CASE WHEN size(words) < 8 THEN CAST(array() AS array<bigint>)
                ELSE transform(sequence(0, size(words) - 8), i -> xxhash64(slice(words, i + 1, 8))) END),
  w -> CASE WHEN size(w) = size(array_distinct(w)) THEN 0L ELSE
    transform(array(array_sort(transform(w, (h, i) -> struct(h AS h, i AS i)))),
      s -> transform(array(array_sort(transform(
             filter(s, (x, k) -> (k > 0 AND s[greatest(k - 1, 0)].h = x.h)
                              OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].h = x.h)),
             x -> x.i))),
        p -> aggregate(transform(p, (x, k) -> CASE WHEN k = size(p) - 1 THEN 8L
                                               ELSE least(8L, CAST(p[least(k + 1, size(p) - 1)] - x AS bigint)) END),
                       0L, (a, x) -> a + x))[0])[0] END)[0]
"""


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts and both histograms of every whole text."""
    df = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    left = "text"
    # each class is taken out of what the earlier ones left
    for name, pattern in [("lower", "[a-z]+"), ("space", SEPARATORS), ("upper", "[A-Z]+"), ("digit", "[0-9]+"),
                          ("wide", r"[^\x00-\x7F]+"), ("symbol", SYMBOLS)]:
        df = df.withColumn(f"_{name}", F.regexp_replace(left, pattern, ""))
        df = df.withColumn(f"n_{name}", F.length(left) - F.length(f"_{name}"))
        left = f"_{name}"
    df = df.withColumn("words", F.expr(_words("text")))
    df = df.withColumn("lines", F.expr(r"filter(split(text, '\n'), l -> l rlike r'[^\x20\x09-\x0D]')"))
    common = ", ".join(f"'{w}'" for w in COMMON_WORDS)
    df = df.withColumn("common", F.expr(f"filter(words, w -> w IN ({common}))"))
    return df.select(
        "doc_id", "lang",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.col("n_space")).cast("long").alias("word_chars"),
        F.col("n_symbol").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(REPEATED).alias("n_repeat_words"),
        F.array(*[F.col(f"n_{c}").cast("double") for c in CHAR_CLASSES[:-1]],
                F.length(left).cast("double")).alias("chars"),
        F.expr(f"transform(array(common), c -> concat(transform(array({common}), x -> "
               "CAST(size(filter(c, w -> w = x)) AS double)), "
               "array(CAST(size(words) - size(c) AS double))))[0]").alias("vocab"))


def references(feats: DataFrame) -> DataFrame:
    """Both histograms summed over all documents of a language; null language: over all."""
    sums = [F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(n)]).alias(f"ref_{c}")
            for c, n in (("chars", len(CHAR_CLASSES)), ("vocab", len(COMMON_WORDS) + 1))]
    return (feats.filter("lang IS NOT NULL").groupBy("lang").agg(*sums)
            .unionByName(feats.agg(*sums).withColumn("lang", F.lit(None).cast("string"))))


def js_distance(p: str, q: str):
    """Jensen-Shannon distance (base 2, 0 to 1) of two count arrays; 0 when either is empty."""
    total = "aggregate({0}, 0D, (a, x) -> a + x)"
    part = "CASE WHEN {0} > 0 THEN 0.5D * {0} * log2(2 * {0} / ({0} + {1})) ELSE 0D END"
    cell = part.format("x.a / n.p", "x.b / n.q"), part.format("x.b / n.q", "x.a / n.p")
    return F.expr(f"""
      transform(array(struct({total.format(p)} AS p, {total.format(q)} AS q)), n ->
        CASE WHEN n.p > 0 AND n.q > 0 THEN
          sqrt(greatest(0D, aggregate(zip_with({p}, {q}, (a, b) -> struct(a AS a, b AS b)), 0D,
                                      (s, x) -> s + {cell[0]} + {cell[1]})))
        ELSE 0D END)[0]""")


def judge_documents(docs: DataFrame, max_char_distance: float = 0.30, max_word_distance: float = 0.55,
                    min_chars: int = 200, min_words: int = 60) -> DataFrame:
    """doc_id, base counts, base_failed, char_distance, word_distance, kept."""
    feats = materialize(features(docs), "quality-features")
    refs = materialize(references(feats), "quality-references")
    # beyond the checked bound a plain join: AQE splits a language's rows over tasks
    refs = F.broadcast(refs) if refs.count() <= MAX_BROADCAST_LANGUAGES else refs
    r = refs.withColumnRenamed("lang", "ref_lang")
    df = feats.join(r, feats.lang.eqNullSafe(r.ref_lang), "left")
    df = (df.withColumn("char_distance", js_distance("chars", "ref_chars"))
            .withColumn("word_distance", js_distance("vocab", "ref_vocab"))
            .withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")))
    far = ((F.col("word_chars") >= min_chars) & (F.col("char_distance") > max_char_distance)) | (
        (F.col("n_words") >= min_words) & (F.col("word_distance") > max_word_distance))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                     (~F.col("base_failed") & ~far).alias("kept"),
                     F.round("char_distance", 6).alias("char_distance"),
                     F.round("word_distance", 6).alias("word_distance"))
