"""The part of a page that a hit shows: the window of tokens that holds most of a query's phrases, marked.

Runs in Python over the few rows a search returns. Windows begin where a phrase does, or at a sentence
before it; a window scores 1,000 for each phrase it holds and 1 for each further occurrence, and 100 more
(120 at the top of the page) if it begins a sentence. The first best one wins.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import MARKS, fold_word
from . import query as qy

_TOKEN = re.compile(rf"[^\W_](?:[^\W_]|[{MARKS}])*")
SIZE = 24


def _occurrences(tokens: Sequence[str], phrases: Sequence[qy.Phrase]) -> list[tuple[int, int, int]]:
    """(begin, phrase, tokens) of each occurrence, by begin and phrase."""
    out = []
    for p, phrase in enumerate(phrases):
        n = len(phrase.tokens)
        for i in range(len(tokens) - n + 1 if n else 0):
            last = tokens[i + n - 1].startswith(phrase.tokens[-1]) if phrase.prefix else tokens[i + n - 1] == phrase.tokens[-1]
            if last and tuple(tokens[i:i + n - 1]) == phrase.tokens[:-1] and (i == 0 or not phrase.first):
                out.append((i, p, n))
    return sorted(out)


def _window(found: Sequence[tuple[int, int, int]], begin: int, size: int) -> tuple[int, list[tuple[int, int, int]]]:
    inside = [f for f in found if begin <= f[0] < begin + size]
    phrases = {p for _, p, _ in inside}
    return 1_000 * len(phrases) + len(inside) - len(phrases), inside


def snippet(text: str | None, phrases: Sequence[qy.Phrase], size: int = SIZE, marks: tuple[str, str] = ("[", "]"), gap: str = " … ") -> str:
    """The window of a page's text, phrases in marks, on one line."""
    text = text or ""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    tokens = [fold_word(text[a:b]) for a, b in spans]
    n, found = len(tokens), _occurrences(tokens, [p for p in phrases if p.column in (None, "text")])
    # a sentence begins at the first token, and at one that follows a full stop or colon and white space
    opens = [i for i, (a, _) in enumerate(spans) if i == 0 or (before := text[:a].rstrip(" \t\n\r")) != text[:a] and before.endswith((".", ":"))]
    best, start = 0, 0
    for at, _, _ in found:
        score, inside = _window(found, at, size)
        if score > best:
            middle = inside[0][0] - int((size - (inside[-1][0] + inside[-1][2] - inside[0][0])) / 2)
            best, start = score, max(0, min(middle, n - size))
        if n > size:
            sentence = max((o for o in opens if o <= at), default=opens[0])
            score = _window(found, sentence, size)[0] + (120 if sentence == 0 else 100)
            if sentence < at and score > best:
                best, start = score, sentence
    end = start + size
    joined: list[list[int]] = []
    for at, _, k in found:
        if joined and at < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], at + k)
        else:
            joined.append([at, at + k])
    out, at = gap if start else "", spans[start][0] if start else 0
    for a, b in joined:
        a, b = max(a, start), min(b, end, n)
        if a < b:
            out += text[at:spans[a][0]] + marks[0] + text[spans[a][0]:spans[b - 1][1]] + marks[1]
            at = spans[b - 1][1]
    out += text[at:] if end >= n else text[at:spans[end - 1][1]] + gap
    return " ".join(out.split())


def snippet_column(text: Column, node, size: int = SIZE) -> Column:
    """``snippet`` of a column for one query's tree (of ``query.read``)."""
    phrases = qy.phrases(node)

    @F.pandas_udf("string")
    def shown(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet(t, phrases, size))

    return shown(text)
