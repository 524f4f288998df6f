"""Phrase mining, ranked search and toxicity against plain versions, and their odd inputs."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations, fp_tree, gru, hat_trie, ranked_search, toxicity
from tessera.llm.common import remainder

from .conftest import words

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- phrases ------------------------------------------------------------------

def brute_phrases(rows, least, longest, within, top):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(AZ)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    c = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, w), a in c.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i:i + k]] = max(longer[lang, w[i:i + k]], a)
    out = {}
    for (lang, w), a in c.items():
        if 100 * longer[lang, w] >= within * a:
            continue
        score, _, left, right = min((math.floor(Fraction(1000 * a * n[lang], f[lang, w[:k]] * f[lang, w[k:]])), k, f[lang, w[:k]], f[lang, w[k:]])
                                    for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right, n[lang]))
    return {(lang, i + 1, p.decode(), -a, left, right, total, -s)
            for lang, x in out.items() for i, (s, a, p, left, right, total) in enumerate(sorted(x)[:top])}


@pytest.fixture
def phrases(corpus):
    rng = random.Random(9)
    lines = [" ".join(rng.choice(["new york city", "New york", "of the", "a b a b", "red", "é u"]) for _ in range(9)) for _ in range(60)]
    rows = [(r[1], r[2]) for r in corpus] + [(rng.choice([". ", "\t", "\n", " ", "!"]).join(lines[i:i + 3]), rng.choice(["en", None, "und", "x'y"]))
                                             for i in range(58)]
    return rows + [("", "en"), (None, "en"), ("!!", "en")]


@pytest.mark.parametrize("within,trie_phrases,filter_bits", [(100, 800_000, 1 << 28), (60, 50, 1 << 28), (100, 50, 64)])
def test_collocations(spark, phrases, within, trie_phrases, filter_bits):
    df = spark.createDataFrame(phrases, "text string, lang string").repartition(5)
    got = collocations.collocations(df, least=4, within=within, top=30, trie_phrases=trie_phrases, filter_bits=filter_bits)
    want = brute_phrases(phrases, 4, 5, within, 30)
    rows = [tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(rows) == len(want) > 60 and set(rows) == want


def test_trie_counts_through_bursts_and_spills():
    rng = random.Random(2)
    trie, want, got = hat_trie.HatTrie(burst=3), Counter(), Counter()

    def take(leave):
        paths, rests, counts = trie.take(leave)
        if counts:
            for at, ids in hat_trie.columns(paths, rests):
                for i, p in zip(at.tolist(), zip(*[x.tolist() for x in ids])):
                    got[p] += counts[i]
    for turn in range(2000):
        p = tuple(rng.randrange(1, 2 ** 32 if turn % 50 == 0 else 6) for _ in range(rng.randrange(2, 6)))
        n = rng.randrange(1, 4)
        want[p] += n
        trie.add(p[0], hat_trie.pack([np.array([x]) for x in p[1:]]), [n])
        if turn % 400 == 399:
            take(trie.size // 2)
    take(0)
    assert got == want and trie.size == 0


# -- search -------------------------------------------------------------------

def brute_search(rows, items, top):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(i, Counter(term.findall((t or "").translate(AZ)))) for i, t in rows]
    n_docs, total = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        terms = set(term.findall((text or "").translate(AZ)))
        found = []
        for i, c in docs:
            m = 50 + 50 * sum(c.values()) * n_docs // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m))
                    for t in terms if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("tree_docs,block_words,top", [(8192, 200_000, 50), (40, 20, 5)])
def test_ranked_search(spark, corpus, tree_docs, block_words, top):
    rows = [(r[0], r[1]) for r in corpus] + [(None, corpus[5][1]), (7, corpus[5][1]), (4, corpus[4][1])]
    items = [(i, " ".join(corpus[i][1].split()[:12]).upper()) for i in (3, 17, 40)] + [(90, "the, the re ÉÉ"), (91, None), (92, "..."), (90, "he in"), (None, "ea")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, terms string").repartition(4)
    got = ranked_search.search(docs, spark.createDataFrame(items, "item_id long, text string"), top, block_words, tree_docs)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == brute_search(rows, items, top)


def test_search_of_nothing(spark, docs):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert ranked_search.search(docs.filter("doc_id < -1"), items).collect() == []
    assert ranked_search.search(docs, items.filter("item_id > 1")).collect() == []
    nulls = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert ranked_search.search(nulls, items).collect() == []


def test_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 12, 900)
    terms = np.concatenate([np.sort(rng.choice(40, s, replace=False, p=np.arange(40, 0, -1) / 820)) for s in sizes])
    tf, m, w = rng.integers(1, 9, len(terms)), rng.integers(50, 400, 900), np.arange(1, 41) * 50
    tree = fp_tree.Tree(np.arange(900), m, sizes, terms, tf, w)
    for k, below in enumerate(tree.children):  # children cover their parent
        if below:
            spans = sorted((tree.start[c], tree.end[c]) for c in below)
            assert spans[0][0] == tree.start[k] and spans[-1][1] == tree.end[k] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    exact = np.bincount(tree.doc, weights=tree.gain, minlength=900)
    total = np.bincount(tree.bound_node, weights=tree.bound_gain, minlength=len(tree.start))
    assert all(exact[a:b].max() <= total[k] for k, (a, b) in enumerate(zip(tree.start, tree.end)))
    wanted = np.array([3, 30, 38])
    mask = np.isin(np.arange(40), wanted)
    heap = []
    tree.search(wanted, mask, heap, 5)
    score = np.bincount(tree.doc, weights=tree.gain * mask[tree.terms], minlength=900)
    assert sorted(s for s, _ in heap) == sorted(np.sort(score)[-5:])


# -- toxicity -----------------------------------------------------------------

def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in gru.start(3, 2, rng).items()}
    table, places, y = rng.normal(size=(6, 3)), rng.integers(1, 6, (4, 5)), np.array([0, 1, 1, 0.0])
    table[0], places[0, 3:] = 0, 0

    def loss():
        x = gru.forward(p, table, places)
        return -(y * np.log(gru.sigmoid(x)) + (1 - y) * np.log(1 - gru.sigmoid(x))).sum()
    kept = {}
    grads, d_table = gru.backward(p, table, places, kept, gru.sigmoid(gru.forward(p, table, places, kept)) - y)
    for x, g in [*((p[k], grads[k]) for k in p), (table[1:], d_table[1:])]:
        at = tuple(rng.integers(0, s) for s in x.shape)
        old = x[at]
        x[at] = old + 0.01
        high = loss()
        x[at] = old - 0.01
        low = loss()
        x[at] = old
        assert (high - low) / 0.02 == pytest.approx(g[at], abs=2e-3)


def test_windows_cover_every_word():
    sizes = np.array([0, 1, 64, 65, 112, 113, 1000, 0])
    first, owner = toxicity.windows(sizes)
    begins = np.cumsum(sizes) - sizes
    for i, n in enumerate(sizes):
        spans = [(a - begins[i], min(n, a - begins[i] + toxicity.WINDOW)) for a in first[owner == i]]
        assert {k for a, b in spans for k in range(a, b)} == set(range(n))
        assert all(b - a == min(n, toxicity.WINDOW) for a, b in spans)


@pytest.fixture(scope="module")
def tox():
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(420):
        w = words(rng, rng.choice([30, 120, 300]))
        bad = i % 3 == 0
        if bad:
            at = rng.randrange(len(w) - 10)
            for k in range(0, 9, 3):
                w[at + k] = rng.choice(["idiot,", "Moron", "scum", "zorg" + rng.choice(["ab", "er", "ung", "ix"])])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark, tox):
    rows, labels = tox
    more = [(None, rows[0][1]), (3, None), (4, ""), (5, "!!"), rows[9], rows[9]]
    docs = spark.createDataFrame([(*r, 1.0, "q") for r in rows + more], "doc_id long, text string, score double, toxic string").repartition(3)
    marks = spark.createDataFrame(labels + [(0, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks, remainder(F.col("doc_id"), 3) != 1, steps=60)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + len(more) and all(0 <= r["score"] <= 1 for r in got)
    score = {r["doc_id"]: r["score"] for r in got if r["n_windows"]}
    import zlib
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(score[i] >= toxicity.LIMIT) == (i % 3 == 0) for i in held]) > 0.93
    assert sorted(r["score"] for r in got if not r["n_windows"]) == [0, 0, 0]
    same = [r["score"] for r in got if r["doc_id"] == 9]
    assert len(same) == 3 and len(set(same)) == 1
    assert [r["score"] for r in got if r["doc_id"] is None] == [score[0]]
    # a text's windows do not depend on its batch
    one, n = toxicity.score_texts(model, pa.array([rows[7][1] * 40]))
    two, _ = toxicity.score_texts(model, pa.array(["a b", rows[7][1] * 40, None]))
    assert n[0] > 5 and two[1] == pytest.approx(one[0], abs=1e-5)


def test_toxicity_of_nothing(spark, tox):
    docs = spark.createDataFrame(tox[0][:6], "doc_id long, text string")
    marks = spark.createDataFrame(tox[1], "doc_id long, toxic int")
    anyone = F.lit(True)
    assert toxicity.train(docs.filter("doc_id < 0"), marks, anyone) is None
    assert toxicity.train(docs, marks.filter("toxic = 0"), anyone) is None
    assert toxicity.score(docs.filter("doc_id < 0"), None).collect() == []
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}


def test_phrases_of_nothing(spark, docs):
    assert collocations.collocations(docs.filter("doc_id < -1")).collect() == []
    nulls = spark.createDataFrame([(None, None), ("a", "en")], "text string, lang string")
    assert collocations.collocations(nulls, least=1).collect() == []
