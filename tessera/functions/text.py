"""Scalar text functions as Spark column expressions.

Regexes avoid ASCII-only classes: Java's ``\\W`` and RE2's ``\\W`` drop accented
letters, so word characters are spelled ``[\\p{L}\\p{N}_]`` (Python's Unicode
``\\w``).  The same pattern text runs in DuckDB, which keeps oracles identical.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \s, spelled out so the same class runs in RE2 (DuckDB)
WS = r"[\t\n\x0B\f\r ]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c) -> Column:
    """Non-word -> space, '_' -> space, lone ASCII letters -> space, collapse spaces, lower.

    No trim, matching the original cleaning.  Runs of non-word characters and ``_`` become one
    space in one step, so lone letters stand between single spaces and nothing is left to collapse.
    """
    t = F.regexp_replace(_c(c).cast("string"), r"[^\p{L}\p{N}]+", " ")
    return F.lower(F.regexp_replace(t, " [a-zA-Z] ", " "))


def clean_words(c) -> Column:
    """The non-empty words of the cleaned text."""
    return F.array_remove(F.split(clean_text(c), " ", -1), "")


def first_clean_word(c) -> Column:
    """The first of :func:`clean_words` (empty if there is none), from the beginning of the text alone:
    the cleaning drops a lone letter only behind a non-word character, and never two in a row."""
    lone = r"(?:[^\p{L}\p{N}]+[a-zA-Z](?=[^\p{L}\p{N}]))?+"
    return F.lower(F.regexp_extract(_c(c).cast("string"), "^" + lone + r"[^\p{L}\p{N}]*([\p{L}\p{N}]+)", 1))


def collapse_ws(c) -> Column:
    """Whitespace runs -> one space, then trim."""
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def unescape_newlines(c) -> Column:
    """Literal backslash-n sequences -> real newlines."""
    return F.replace(_c(c), F.lit("\\n"), F.lit("\n"))


def code_tokens(c) -> Column:
    """Split on tab, space, '*', '(' and ')', keeping empty strings."""
    return F.split(_c(c), r"\t| |\*|\(|\)", -1)


def word_tokens(c, stop_words=()) -> Column:
    """Lower, split on ' ', drop empties and stop words."""
    toks = F.split(F.lower(_c(c)), " ", -1)
    stops = F.array(*[F.lit(s) for s in sorted(set(stop_words))]) if stop_words else None
    if stops is None:
        return F.filter(toks, lambda t: t != F.lit(""))
    return F.filter(toks, lambda t: (t != F.lit("")) & ~F.array_contains(stops, t))


def ngrams(tokens, n: int) -> Column:
    """Space-joined n-grams of a token array (empty when shorter than n).

    Built from ``n`` shifted slices zipped together: linear in the row length
    (a per-element ``slice`` inside a lambda would re-evaluate the array).
    """
    toks = _c(tokens)
    width = F.greatest(F.size(toks) - F.lit(n - 1), F.lit(0))
    if n == 1:
        return toks
    shifted = [F.slice(toks, j + 1, width).alias(f"g{j}") for j in range(n)]
    return F.transform(F.arrays_zip(*shifted), lambda z: F.concat_ws(" ", *[z[f"g{j}"] for j in range(n)]))


def char_count(c) -> Column:
    return F.char_length(_c(c))


def line_count(c) -> Column:
    return F.size(F.split(_c(c), "\n", -1))


def ari_parts(c):
    """(characters, words, sentences) as used by the automated readability index."""
    t = _c(c)
    chars = F.char_length(F.regexp_replace(t, r"[^\p{L}\p{N}]+", ""))
    words = F.size(F.array_remove(F.split(t, WS + "+", -1), ""))
    sents = F.greatest(F.size(F.filter(F.split(t, r"[.!?]+", -1), lambda s: F.trim(s) != F.lit(""))), F.lit(1))
    return chars, words, sents


def readability_ari(c) -> Column:
    """Automated readability index: 4.71*chars/words + 0.5*words/sentences - 21.43."""
    chars, words, sents = ari_parts(c)
    w = F.greatest(words, F.lit(1))
    return F.lit(4.71) * chars / w + F.lit(0.5) * w / sents - F.lit(21.43)


def title_of(c) -> Column:
    """Title out of ``'Last, Title. First'``: text after the first comma, up to the first dot."""
    after = F.try_element_at(F.split(_c(c), ",", -1), F.lit(2))
    return F.trim(F.try_element_at(F.split(after, r"\.", -1), F.lit(1)))


def first_letter_or(c, missing: str = "U") -> Column:
    return F.substring(F.coalesce(_c(c), F.lit(missing)), 1, 1)


def ticket_prefix(c, default: str = "XXX") -> Column:
    """Drop '.' and '/', split on whitespace, first token that is not all digits, else default."""
    t = F.regexp_replace(_c(c), r"[./]", "")
    toks = F.filter(F.split(F.trim(t), r"\s+", -1), lambda x: (x != F.lit("")) & ~x.rlike(r"^[0-9]+$"))
    return F.coalesce(F.try_element_at(toks, F.lit(1)), F.lit(default))


def file_stem(c) -> Column:
    """Name without its last extension, the parts before it joined by ``_``."""
    parts = F.split(_c(c), r"\.", -1)
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "_")).otherwise(_c(c))
