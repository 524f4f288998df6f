"""Secret scan: three fixed patterns, and strings that primed zstandard cannot compress.

A candidate is a run of 12 or more characters without blanks, quotes, brackets, commas or
semicolons that has a digit and a letter and follows a sensitive word within 48 characters on its line, or
holds one itself; of an address with a password (``scheme://user:password@host``) the
password.  Its novelty is the compressed bytes that it adds, by a compressor primed with a
dictionary of code keywords, identifiers and usual placeholders and with the surrounding
text: text of the document, names and placeholders match what was seen before and add
little, random strings nearly their length.  Other occurrences of the candidate, and of a value it
assigns, are cut out of the surrounding text, so a secret that is given twice is as novel as
one given once.  Every base span's value is measured alike.  A candidate that touches no base
span is reported as ``novel`` at ``least`` bytes a character or more; base spans stay,
whatever theirs is.

A map over whole texts without a shuffle; surroundings are ``CONTEXT`` characters, so texts
of any length cost in proportion.  Positions are code points, ends exclusive.  A null text is
empty; empty texts have no spans; repeated rows give repeated results; spans that start
together are ordered by kind; a null doc_id passes through; other columns, whatever their
names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_rows
from .common import spread

# The patterns of the three base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ["assign", "access", "hex", "novel"]

ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SENSITIVE = re.compile(r"key|secret|token|passw|pwd|auth|cred|bearer|private|access|signature", re.I | re.A)
CANDIDATE = re.compile(r"""[^\s"'`<>(){}\[\],;]{12,}""")
ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@]*:([^\s@/]{6,})@")
EDGES = ".:!?=&|-"
REACH, CONTEXT = 48, 512

# What candidates are primed with: keywords, identifiers, placeholders.
DICTIONARY = """
import from class def return self public private static final void string int float bool true false null None
function const let var export default async await new this throw try catch except finally while for if else elif
username user_name user_id account_id client_id client_secret access_key secret_key access_token refresh_token
api_key apikey api_secret private_key public_key password passwd token secret credential authorization bearer
signature session_id request_id config settings environment production development localhost example.com
your_api_key_here your-secret-key my_secret_password changeme placeholder example EXAMPLE dummy sample test
xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXXXXXXXXXX 00000000000000000000000000000000
1234567890123456789012345678901234567890 0123456789abcdef0123456789abcdef abcdefghijklmnopqrstuvwxyz
ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 aaaaaaaaaaaaaaaaaaaa -----BEGIN PRIVATE KEY----- -----END PRIVATE KEY-----
Manager Handler Factory Service Controller Provider Settings Account Client Server User Request Response Session
Config Context Builder Listener Repository Exception Element Document Component Template Resource Registry Helper
docs documentation authentication reference guide index.html images static assets src lib bin usr local node_modules
getInstance initialize connection_string database_url http https www getElementById addEventListener
"""


def novelty(before: str, candidate: str, after: str) -> float:
    """Bytes that a character of ``candidate`` adds to its surroundings: its compressed size by
    a compressor that has just seen the dictionary and them."""
    import zstandard

    raw = lambda s: s.encode("utf-8", "surrogatepass")
    seen = zstandard.ZstdCompressionDict(raw(DICTIONARY + before + after), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=19, dict_data=seen, write_content_size=False, write_checksum=False, write_dict_id=False)
    return (len(press.compress(raw(candidate))) - len(press.compress(b""))) / len(candidate)


def without(text: str, start: int, end: int, parts: list[str]) -> str:
    """``text[start:end]`` less the occurrences of ``parts``, those cut by its ends too."""
    gone = []
    for part in parts:
        at = text.find(part, max(0, start - len(part) + 1), end + len(part) - 1)
        while at >= 0:
            gone.append((at, at + len(part)))
            at = text.find(part, at + 1, end + len(part) - 1)
    out = []
    for a, b in sorted(gone):
        out.append(text[start:max(start, min(a, end))])
        start = max(start, b)
    return "".join(out) + text[start:end]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three base kinds."""
    spans = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a run of 24 lies within one word of that length
    if any(len(w) >= 24 for w in text.split()):
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return spans


def measured(text: str, at: int, end: int) -> float:
    """Novelty of ``text[at:end]`` amid its surroundings."""
    c = text[at:end]
    parts = [c, *(x for x in re.split("[=:]", c) if 8 <= len(x) < len(c))]
    before = without(text, max(0, at - CONTEXT), at, parts)
    return novelty(before, c, without(text, end, min(len(text), end + CONTEXT), parts))


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the strings in a sensitive context."""
    if not any(len(w) >= 12 and (any(x.isdigit() for x in w) or "://" in w) for w in text.split()):
        return []
    out = []
    for m in CANDIDATE.finditer(text):
        at, end = m.start(), m.end()
        while at < end and text[at] in EDGES:
            at += 1
        while end > at and text[end - 1] in EDGES:
            end -= 1
        if address := ADDRESS.match(text, at, end):
            out.append(address.span(1))
            continue
        c = text[at:end]
        line = text.rfind("\n", 0, at) + 1
        found = SENSITIVE.search(text, max(line, at - REACH), at)
        if not found and (inner := SENSITIVE.search(c)) and (cut := re.search("[=:]", c[inner.end():])):
            at += inner.end() + cut.end()  # the value that the word is given
            c, found = text[at:end], inner
        if found and len(c) >= 12 and any(x.isdigit() for x in c) and any(x.isalpha() for x in c):
            out.append((at, end))
    return out


def strangers(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
    """(start, end, novelty) of the candidates that touch no base span; those that do are
    measured as the span."""
    return [(at, end, measured(text, at, end)) for at, end in candidates(text)
            if not any(a < end and at < b for a, _, b in base)]


def novel_spans(text: str, base: list[tuple[int, int, int]], least: float) -> list[tuple[int, int, int]]:
    return [(at, 3, end) for at, end, new in strangers(text, base) if new >= least]


def scan(text: str, least: float) -> tuple[list[tuple], int]:
    """(start, kind number, end, novelty) of all spans in order, and how many strings were measured."""
    base = base_spans(text)
    values = [ASSIGN.match(text, a, b).start(2) if k == 0 else a for a, k, b in base]
    out = [(a, k, b, round(measured(text, v, b), 4)) for (a, k, b), v in zip(base, values)]
    others = strangers(text, base)
    out += [(at, 3, end, round(new, 4)) for at, end, new in others if new >= least]
    return sorted(out), len(base) + len(others)


def find_secrets(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, base, novelty) in order of start and kind, and
    n_measured: the strings whose novelty was measured."""
    def run(texts):
        out, measures = [], []
        for text in texts:
            found, n = scan(text or "", least)
            out.append([{"kind": KINDS[k], "start": a, "end": b, "base": k < 3, "novelty": x} for a, k, b, x in found])
            measures.append(n)
        return {"spans": out, "n_measured": measures}

    kind = dict(docs.dtypes)["doc_id"]
    return map_rows(spread(docs.select("doc_id", "text")), run, ["text"],
                    f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint, base: boolean, "
                    "novelty: double>>, n_measured long")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the base spans, all spans as text, and what novelty says of them."""
    joined = "array_join(transform({0}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    of = lambda k: F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}")
    return found.select(
        "doc_id", *[of(k) for k in KINDS],
        F.sha2(F.expr(joined.format("filter(spans, s -> s.base)")).cast("binary"), 256).alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"), "n_measured",
        F.array_max(F.transform("spans", lambda x: x["novelty"])).alias("most_novel"))
