"""Shared derived frames used by several plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import ari_parts, clean_text, clean_words, first_clean_word, readability_ari
from tessera.operators.metrics import to_long
from tessera.operators.oof import oof_group_mean
from tessera.operators.splits import group_fold_table
from tessera.sources.tables import Tables

ESSAY_TARGETS = ["t_ari", "t_wlen", "t_loglen"]


def essay_frame(t: Tables) -> DataFrame:
    """Documents as scored essays: cleaned text plus three numeric targets."""
    chars, words, _ = ari_parts("text")
    return t.documents.select(
        "doc_id", "lang", "source", clean_text("text").alias("clean"),
        F.round(readability_ari("text"), 6).alias("t_ari"),
        F.round(chars / F.greatest(words, F.lit(1)), 6).alias("t_wlen"),
        F.round(F.log1p("n_chars"), 6).alias("t_loglen"))


def essay_long(t: Tables) -> DataFrame:
    e = essay_frame(t)
    return to_long(e, ["doc_id", "lang", "source"], ESSAY_TARGETS, pred_prefix=None)


def essay_folds(t: Tables, k: int, seed: int = 42) -> DataFrame:
    """The long essay table with group folds on ``source``.  The sources are read from the documents alone, not
    behind the targets, which would be worked out once more for them; the table of folds is written first, so
    the join knows its size and rows are not dealt by source."""
    from tessera.session import materialize
    folds = group_fold_table(t.documents.select("source"), "source", k=k, seed=seed)
    return essay_long(t).join(materialize(folds, "source_folds"), "source", "left")


def essay_oof(t: Tables, k: int = 5, seed: int = 42) -> DataFrame:
    """Long essay table with group folds on ``source`` and group-mean OOF by ``lang``."""
    from tessera.session import materialize
    long = materialize(essay_folds(t, k, seed), "essay_long")
    return oof_group_mean(long, "lang")


def cells_frame(t: Tables) -> DataFrame:
    """Conversations as notebooks: id, 8-hex cell id, cell type (user turns are
    markdown, others code), true position and source text."""
    from tessera.functions.hashing import hash_hex
    c = t.conversations
    return c.select(F.col("conv_id").alias("id"),
                    F.substring(hash_hex("cell", "conv_id", "turn"), 1, 8).alias("cell_id"),
                    F.when(F.col("role") == "user", F.lit("markdown")).otherwise(F.lit("code")).alias("cell_type"),
                    F.col("turn"), F.col("text").alias("source"))


def orders_frame(t: Tables) -> DataFrame:
    """(id, cell_order): the space-separated true order of each notebook."""
    from tessera.operators.ordering import ordered_list
    cells = cells_frame(t)
    return ordered_list(cells, "id", "turn", "cell_id", "items") \
        .select("id", F.array_join("items", " ").alias("cell_order"))


STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it",
              "of", "on", "or", "that", "the", "this", "to", "was", "with")


def doc_tokens(t: Tables) -> DataFrame:
    """(doc_id, tokens): non-empty words of the cleaned text."""
    return t.documents.select("doc_id", clean_words("text").alias("tokens"))


def line_first_words(t: Tables) -> DataFrame:
    """First cleaned word of every text line (the 'command' field of each instruction)."""
    lines = t.documents.select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.select(first_clean_word("line").alias("token")).where(F.col("token") != "")


def vocab_frame(t: Tables, k: int = 2000) -> DataFrame:
    from tessera.operators.vocab import build_vocab, top_tokens
    return build_vocab(top_tokens(doc_tokens(t), "tokens", k), line_first_words(t))


def encoded_docs(t: Tables, cut=None, specials: dict | None = None, with_vocab: bool = False):
    """(doc_id, input_ids) with the fitted vocabulary (no specials yet).  ``cut`` maps the
    token array to the part that is wanted, before anything is looked up."""
    from tessera.operators.vocab import build_vocab, encode, top_tokens
    from tessera.session import materialize
    toks = materialize(doc_tokens(t), "doc_tokens")
    vocab = build_vocab(top_tokens(toks, "tokens", 2000), line_first_words(t))
    part = toks if cut is None else toks.select("doc_id", cut(F.col("tokens")).alias("tokens"))
    enc = encode(part, "doc_id", "tokens", vocab, specials=specials)
    return (enc, vocab) if with_vocab else enc


def essay_long_folds(t: Tables, k: int = 5, seed: int = 42) -> DataFrame:
    """Long essay table (doc_id, lang, source, all_, target, y, kfold)."""
    from tessera.session import materialize
    long = essay_folds(t, k, seed).withColumn("all_", F.lit("all"))
    return materialize(long, "essay_long_folds")


RUNS = {"lang": "lang", "source": "source", "all": "all_"}


def run_predictions(t: Tables, k: int = 5, own_fold_only: bool = False) -> DataFrame:
    """Fold-model predictions of three group-mean regressors (runs): every row
    (doc_id, target, y, kfold, run, model_fold, pred)."""
    from tessera.operators.oof import fold_model_predictions
    long = essay_long_folds(t, k)
    out = None
    for run, g in RUNS.items():
        p = fold_model_predictions(long, g, k, own_fold_only=own_fold_only).select(
            "doc_id", "target", "y", "kfold", F.lit(run).alias("run"), "model_fold", "pred")
        out = p if out is None else out.unionByName(p)
    return out


def oof_runs(t: Tables, k: int = 5) -> DataFrame:
    """Out-of-fold predictions of each run: the model that did not see the row."""
    from tessera.operators.oof import oof_select
    from tessera.session import materialize
    o = oof_select(run_predictions(t, k, own_fold_only=True)).select("run", "doc_id", "target", "y", "pred")
    return materialize(o, "oof_runs")


def class_probs(t: Tables, k: int = 5) -> DataFrame:
    """15 binary models (3 groupings x k folds) scoring ``quality`` on labelled docs:
    (doc_id, y, run, grp, model_fold, p)."""
    from tessera.operators.oof import fold_model_predictions
    from tessera.operators.splits import group_fold_table
    d = t.documents.select("doc_id", "lang", "source")
    folds = group_fold_table(d, "source", k=k, seed=42)
    from tessera.session import materialize
    lab = (d.join(t.labels, "doc_id").join(folds, "source", "left")
           .select("doc_id", "lang", "source", F.lit("all").alias("all_"), F.lit("quality").alias("target"),
                   F.col("quality").cast("double").alias("y"), "kfold"))
    lab = materialize(lab, "labelled_folds")
    out = None
    for i, (run, g) in enumerate(RUNS.items()):
        p = fold_model_predictions(lab, g, k).select(
            "doc_id", "y", F.concat(F.lit(run + "_"), F.col("model_fold").cast("string")).alias("run"),
            F.lit(i).alias("grp"), "model_fold", F.col("pred").alias("p"))
        out = p if out is None else out.unionByName(p)
    return out
