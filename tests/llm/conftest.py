import random

import pytest

SYLLABLES = {
    "en": "the th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as",
    "de": "ein sch der die und cht ung ich ge ver ber zu auf keit heit lich tz pf en er st ie",
}


def words(rng, n, lang="en"):
    parts = SYLLABLES[lang].split()
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source) with copies, near copies, shared passages, boilerplate
    lines, separators of every kind, empty and null texts."""
    rng = random.Random(3)
    rows, passage = [], " ".join(words(rng, 70))
    for i in range(120):
        lang = "de" if i % 3 == 0 else "en"
        lines = [" ".join(words(rng, rng.randint(5, 40), lang)) for _ in range(rng.randint(1, 8))]
        if i % 5 == 0:
            lines.insert(1, "This line stands on every single site.")
        if i % 7 == 0:
            lines.insert(len(lines) // 2, " ".join(words(rng, 3)) + " " + passage)
        rows.append([i, "\n".join(lines), lang, f"s{i % 9}"])
    for i in range(120, 150):  # copies, and copies with one word changed
        of = rows[i % 11][1]
        w = of.split(" ")
        if i % 2:
            w[rng.randrange(len(w))] = "changed"
        rows.append([i, " ".join(w), "en", f"s{i % 9}"])
    rows += [[150, "", "en", "s1"], [151, None, "en", "s2"], [152, "one\x0btwo\x0c three\t\r\n four ", None, None],
             [153, "12 34 !!", "en", "s3"], [154, "é" * 700, "fr", "s4"], [155, "aa bb " * 400, None, "s4"],
             [156, " ".join(words(rng, 4000)), "en", "s5"], [157, "\n\n  \n", "en", "s6"]]
    return [tuple(r) for r in rows]


@pytest.fixture
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string")


@pytest.fixture
def odd(spark, corpus):
    """Null ids, repeated rows, one id with two texts, and columns with names used inside."""
    more = [(None, corpus[3][1], "en", "s1"), (None, None, None, None), corpus[4], corpus[4], (5, "another text of five", "en", "s2")]
    rows = [(*r, i, "x", i, "y", 1.5, [1]) for i, r in enumerate([*corpus, *more])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, text_key long, key string, "
                                       "n long, gone string, score double, bands array<int>")
