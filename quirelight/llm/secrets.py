"""Secret scans: fixed patterns, and password guess cost of values that stand in a credential context.

Patterns (spans are whole matches, leftmost first, not overlapping within a kind): ``assign``, a name
such as password or token with a value; ``access``, an access key id; ``hex``, a long hex run.

The method adds ``guess``: what follows a credential name and a separator is a value, and the bits an
attacker must guess to find it are those of its cheapest segmentation into dictionary words (also
reversed, or with signs for letters), dates, repeats, keyboard walks and brute-force spans, found by
dynamic programming over all cuts. A value of at least ``LEAST_BITS`` is a secret; ``changeme``,
``01.01.2020`` or ``certificate`` is not. Base spans stay as they are.

The dictionary is a parameter, commonest word first. By default it is a short list of common passwords,
then the whole words of two public tokenizers' vocabularies in their order (some 50,000 of many
languages), which are read where the tokenizers lie and sent to the tasks once.

Defined cases: a null text is empty and has no spans; repeated rows are scanned each; a null doc_id is
kept; offsets count code points; a value is scored whole, however long it is; of spans at one place the
kinds stand as listed; columns other than doc_id and text are left out of spans and kept in redacted
documents; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import itertools
import json
import math
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import read
from .rows import numbered
from .textbytes import giving_back

#: The base patterns.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "guess")

CONTEXT = re.compile(
    r"""(?i:pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|bearer|(?:api|access|private|secret|auth)[_-]?key)"""
    r"""["']?[\x20\t]*(?:[:=]>?|->)[\x20\t]*(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"',;<>(){}]+))""", re.ASCII)
#: Letters of a dictionary word that are looked up at most; longer ones count by their parts.
LONGEST_WORD = 24
#: 10**8 guesses, beyond which a password counts as hard to guess.
LEAST_BITS = math.log2(1e8)

#: Common passwords and words in them, commonest first.
WORDS = (
    "password qwerty dragon monkey letmein football iloveyou admin welcome login princess sunshine master "
    "shadow superman michael baseball batman trustno charlie jordan hunter soccer summer winter spring autumn "
    "secret test testing guest root user default changeme example sample demo hello freedom whatever starwars "
    "computer internet server system service account public private access token pass passwd key value none null "
    "true false your here insert replace placeholder dummy foo bar baz temp temporary company office love money "
    "january february march april may june july august september october november december monday friday sunday"
).split()

#: Signs that stand for letters; two lists, as some stand for either of two.
SIGNS = (str.maketrans("@4310$57!", "aaeiossti"), str.maketrans("@4310$57!+", "aaelosstit"))

#: The rows of a keyboard, and the runs that are typed like one.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
RUNS = ("abcdefghijklmnopqrstuvwxyz",)

DATE = re.compile(r"(?:19|20)\d\d(?:([-./_]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])([-./_]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")
REPEAT = re.compile(r"(.{1,4}?)\1{2,}", re.DOTALL)
_SIZES = ((re.compile("[a-z]"), 26), (re.compile("[A-Z]"), 26), (re.compile("[0-9]"), 10), (re.compile("[^A-Za-z0-9]"), 33))


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


@lru_cache(4)
def dictionary(ranked: str, word_ends: str) -> tuple[str, ...]:
    """Common passwords, then the words of three letters and more of a ranked byte vocabulary (those that follow a blank)
    and of one that marks ends of words, dealt in turn."""
    with open(ranked, "rb") as lines:
        pieces = [base64.b64decode(line.split()[0]).decode("utf-8", "ignore") for line in lines if line.strip()]
    with open(word_ends, encoding="utf-8") as text:
        ids = json.load(text)["model"]["vocab"]
    one = [p[1:].lower() for p in pieces if p[:1] == " "]
    two = [w[:-4] for w in sorted(ids, key=ids.get) if w.endswith("</w>")]
    mixed = (w for pair in itertools.zip_longest(one, two, fillvalue="") for w in pair)
    return tuple(dict.fromkeys([*WORDS, *(w for w in mixed if len(w) >= 3 and w.isalpha())]))


def ranks_of(words: Sequence[str] | None) -> dict[str, int]:
    return {w: i for i, w in reversed(list(enumerate(dictionary(*vocabulary_paths()) if words is None else words)))}


@lru_cache(1)
def _beside() -> dict[str, str]:
    """Keys beside each key: left, right, and the two above and below it."""
    near: dict[str, str] = {}
    for row in (*ROWS, *RUNS):
        for a, b in zip(row, row[1:]):
            near[a], near[b] = near.get(a, "") + b, near.get(b, "") + a
    for upper, lower in zip(ROWS, ROWS[1:]):
        for i, key in enumerate(lower):
            for other in upper[i + (upper is ROWS[0]):i + 2 + (upper is ROWS[0])]:
                near[key], near[other] = near[key] + other, near[other] + key
    return near


def _walks(value: str) -> Iterator[tuple[int, int, float]]:
    near, low, start, turns, step = _beside(), value.lower(), 0, 0, 0
    for i in range(1, len(low) + 1):
        if i < len(low) and low[i] in near.get(low[i - 1], ""):
            now = ord(low[i]) - ord(low[i - 1])
            turns, step = turns + (i - 1 > start and now != step and abs(now) + abs(step) == 2), now
            continue
        if i - start >= 3:
            yield start, i, math.log2(len(near)) + math.log2(i - start) + 2.3 * (1 + turns)
        start, turns, step = i, 0, 0


def _matches(value: str, ranks: dict[str, int], brute: float) -> Iterator[tuple[int, int, float]]:
    """(start, end, bits) of the words, dates, repeats and walks in a value."""
    low, longest = value.lower(), min(40, max(map(len, ranks), default=0)) if len(ranks) < 1_000 else LONGEST_WORD
    spelled = [low, *dict.fromkeys(v for t in SIGNS if (v := low.translate(t)) != low)] if len(low) == len(value) else [value]
    for i in range(len(value)):
        for j in range(i + 3, min(len(value), i + longest) + 1):
            best = math.inf
            for k, text in enumerate(spelled):
                part = text[i:j]
                signs = 1 + len({c for c, d in zip(low[i:j], part) if c != d}) if k else 0
                if k and signs == 1:
                    continue
                for word, extra in ((part, signs), (part[::-1], signs + 1)):
                    if (rank := ranks.get(word)) is not None:
                        best = min(best, math.log2(rank + 1) + extra)
            if best < math.inf:
                capitals = sum(c.isupper() for c in value[i:j])
                cased = 0.0 if not capitals else 1.0 if capitals == j - i or capitals == 1 and value[i].isupper() else math.log2(math.comb(j - i, capitals)) + 1
                yield i, j, best + cased
    for i in range(len(value)):
        if m := DATE.match(value, i):
            yield i, m.end(), math.log2(150) + (math.log2(365) + (2 if m[1] or m[2] else 0) if m.end() - i > 4 else 0)
    for m in REPEAT.finditer(value):
        yield m.start(), m.end(), len(m[1]) * brute + math.log2((m.end() - m.start()) / len(m[1]))
    yield from _walks(value)


def guess_bits(value: str, ranks: dict[str, int] | None = None) -> float:
    """Bits of the cheapest segmentation; each segment beyond the first adds one."""
    if not value:
        return 0.0
    if ranks is None:
        ranks = ranks_of(None)
    brute = math.log2(sum(n for kind, n in _SIZES if kind.search(value)))
    ending: dict[int, list[tuple[int, float]]] = {}
    for i, j, bits in _matches(value, ranks, brute):
        ending.setdefault(j, []).append((i, bits))
    # whole[j]: cheapest way to guess the first j characters; open_[j]: the same, ending in brute force
    whole, open_ = [0.0], [math.inf]
    for j in range(1, len(value) + 1):
        cut = lambda i: whole[i] + (i > 0)
        open_.append(brute + min(open_[j - 1], cut(j - 1)))
        whole.append(min([open_[j], *(cut(i) + bits for i, bits in ending.get(j, ()))]))
    return whole[-1]


def scan(text: str, ranks: dict[str, int] | None = None, least_bits: float = LEAST_BITS) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, bits) by start, then kind; bits only for ``guess``."""
    found = [("assign", m.start(), m.end(), None) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    for m in CONTEXT.finditer(text):
        start, end = m.span(m.lastindex)
        while m.lastindex == 3 and end > start and text[end - 1] in ".!?:":
            end -= 1
        if (bits := guess_bits(text[start:end], ranks)) >= least_bits:
            found.append(("guess", start, end, bits))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str, spans: list[tuple[str, int, int, float | None]], mark: str = "[secret]") -> str:
    """The text with each stretch that spans cover replaced by one mark."""
    out, at = [], 0
    for _, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind string, start int, end int, bits double>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("bits", pa.float64())]))


def find_secrets(docs: DataFrame, words: Sequence[str] | None = None, least_bits: float = LEAST_BITS, redacted: bool = False) -> DataFrame:
    """doc_id and spans of docs(doc_id, text), with redacted also the text without its secrets. words: the dictionary, commonest first."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks_of(words))  # some 50,000 words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column("text").to_pylist()]
                spans = [scan(t, sent.value, least_bits) for t in texts]
                columns = [part.column("doc_id"), pa.array([[dict(zip(("kind", "start", "end", "bits"), s)) for s in x] for x in spans], _ARROW_SPANS)]
                if redacted:
                    columns.append(pa.array([redact(t, s) if s else t for t, s in zip(texts, spans)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "spans", "text"][:len(columns)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(giving_back(run), f"doc_id long, spans {SPANS}" + (", text string" if redacted else ""))


def redacted_documents(docs: DataFrame, words: Sequence[str] | None = None, least_bits: float = LEAST_BITS) -> DataFrame:
    """docs with the secrets in column text replaced by a mark, all other columns as they are; a null text stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks_of(words))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                texts = part.column(at).to_pylist()
                new = [t and (redact(t, s) if (s := scan(t, sent.value, least_bits)) else t) for t in texts]
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    rows = numbered(docs)
    return rows.mapInArrow(giving_back(run), rows.schema).toDF(*docs.columns)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents."""
    found = find_secrets(read(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, KINDS[:3]), F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"), count("guess"),
    )
