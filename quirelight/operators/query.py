"""Search queries as text: notation, expressions, and the tree a plan is made from. Plain Python on one string."""

from __future__ import annotations

import re
from dataclasses import dataclass

OPERATORS = ("AND", "OR", "NOT")
NOTATION = "{}[]<>|:"


class QueryError(ValueError):
    """The text is not a valid expression."""


@dataclass(frozen=True)
class Phrase:
    """Tokens that follow each other; with prefix, the last is the beginning of a token."""

    tokens: tuple[str, ...]
    prefix: bool = False
    column: str | None = None
    first: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass(frozen=True)
class Without:
    left: object
    right: object


def _searchable(text: str) -> bool:
    return any(c.isalnum() for c in text)


def terms(query: str | None) -> list[str]:
    """Runs of letters and digits of two or more, but for the operators; case is kept."""
    return [w for w in re.findall(r"[^\W_]+", query or "") if len(w) >= 2 and w not in OPERATORS]


def is_bare_term(query: str | None) -> bool:
    text = (query or "").strip()
    return bool(text) and not any(c in NOTATION or c.isspace() or c in '"*' for c in text)


def mnemonics(query: str | None) -> list[str]:
    """Distinct terms in command case: capitals, then small letters; units in Hz are not."""
    return list(dict.fromkeys(w for w in terms(query) if re.fullmatch("[A-Z]{2,}[a-z]+", w) and not w.endswith("Hz")))


def looks_like_expression(query: str) -> bool:
    """Whether the text is meant as an expression: a star, NEAR(, or an operator with a word on both sides."""
    words = query.split()
    return "*" in query or any(w.startswith("NEAR(") for w in words) or any(w in OPERATORS for w in words[1:-1])


def _quoted(term: str) -> str:
    return '"' + term.replace('"', '""') + '"'


def expand_notation(term: str) -> str | None:
    """One term of command notation as an expression, or None if nothing in it can be searched.

    Levels between colons must all be present; braces and brackets hold alternatives, divided by bars
    or, inside them, commas; what stands in angle brackets is a placeholder and goes.
    """
    if not any(c in NOTATION for c in term):
        return _quoted(term) if _searchable(term) else None
    levels: list[list[str]] = [[]]
    grouped, word = False, ""
    for piece in re.findall(r"<[^>]*>?|[{}\[\]|:,]|[^<{}\[\]|:,]+", term):
        if piece[0] == "<":
            continue
        if piece == "," and not grouped or piece not in "{}[]|:,":
            word += piece
            continue
        if _searchable(word):
            levels[-1].append(word.strip())
        word = ""
        if piece in "{}[]:":
            levels.append([])
            grouped = piece in "{[" or grouped and piece == ":"
    if _searchable(word):
        levels[-1].append(word.strip())
    parts = [_quoted(x[0]) if len(x) == 1 else "(" + " OR ".join(map(_quoted, x)) + ")" for x in levels if x]
    return " AND ".join(parts) or None


def _split(query: str) -> list[str]:
    """Words between white space; what stands in quotes stays together."""
    out, word, inside = [], "", False
    for c in query + " ":
        if c == '"':
            inside = not inside
        elif c.isspace() and not inside:
            out.append(word.strip())
            word = ""
        else:
            word += c
    return [w for w in [*out, word.strip()] if _searchable(w)]


def prepare(query: str | None, literal: bool = False) -> str | None:
    """The expression that a typed query stands for; None if there is nothing to search for."""
    if not query or not query.strip():
        return None
    if not literal and looks_like_expression(query):
        return query
    return " AND ".join(p for t in _split(query) if (p := expand_notation(t))) or None


_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|(NEAR)\s*\(|([():+*,^])|([^\s"():+*,^{}\[\]<>|&;=!?.\'/\\~@#$%-]+))')


class _Parser:
    def __init__(self, text: str, tokenise) -> None:
        self.items: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"unexpected {text[at:].strip()[:1]!r}")
            at = m.end()
            if m[1] is not None:
                self.items.append(("phrase", m[1].replace('""', '"')))
            elif m[2]:
                self.items.append(("near", "NEAR"))
            elif m[3]:
                self.items.append((m[3], m[3]))
            else:
                self.items.append((m[4] if m[4] in OPERATORS else "word", m[4]))
        self.at, self.tokenise = 0, tokenise

    def peek(self, *kinds: str) -> bool:
        return self.at < len(self.items) and self.items[self.at][0] in kinds

    def take(self, *kinds: str) -> str:
        if not self.peek(*kinds):
            raise QueryError(f"expected {' or '.join(kinds)}")
        self.at += 1
        return self.items[self.at - 1][1]

    def either(self):
        node = self.both()
        while self.peek("OR"):
            self.take("OR")
            node = Either(node, self.both())
        return node

    def both(self):
        node = self.without()
        while self.peek("AND"):
            self.take("AND")
            node = Both(node, self.without())
        return node

    def without(self):
        node = self.several()
        while self.peek("NOT"):
            self.take("NOT")
            node = Without(node, self.several())
        return node

    def several(self):
        """Phrases side by side, all of which must be present."""
        node = self.one()
        while self.peek("phrase", "word", "near", "^") and not isinstance(node, (Either, Without)):
            node = Both(node, self.one())
        return node

    def one(self):
        if self.peek("("):
            self.take("(")
            node = self.either()
            self.take(")")
            return node
        if self.peek("near"):
            self.take("near")
            phrases = []
            while not self.peek(")", ","):
                phrases.append(self.phrase())
            distance = 10
            if self.peek(","):
                self.take(",")
                distance = int(self.take("word"))
            self.take(")")
            return Near(tuple(phrases), distance)
        column = None
        if self.peek("word") and self.at + 1 < len(self.items) and self.items[self.at + 1][0] == ":":
            column = self.take("word")
            self.take(":")
        return self.phrase(column)

    def phrase(self, column: str | None = None) -> Phrase:
        first = bool(self.peek("^") and self.take("^"))
        found = list(self.tokenise(self.take("phrase", "word")))
        while self.peek("+"):
            self.take("+")
            found += self.tokenise(self.take("phrase", "word"))
        prefix = bool(self.peek("*") and self.take("*"))
        return Phrase(tuple(found), prefix, column, first)


def default_tokenise(text: str) -> list[str]:
    from ..functions.text import fold_word

    return re.findall(r"[^\W_]+", fold_word(text))


def parse(expression: str, tokenise=default_tokenise):
    """The tree of an expression: NOT binds before AND before OR; phrases side by side must all be present."""
    parser = _Parser(expression, tokenise)
    node = parser.either()
    if parser.at < len(parser.items):
        raise QueryError(f"unexpected {parser.items[parser.at][1]!r}")
    return node


def read(query: str | None, tokenise=default_tokenise) -> tuple[object | None, str | None]:
    """(tree or None, note): an expression that cannot be parsed is read as ordinary words, with a note."""
    text = prepare(query)
    if text is None:
        return None, None
    try:
        return parse(text, tokenise), None
    except QueryError:
        again = prepare(query, literal=True)
        if again is None or again == text:
            raise
        return parse(again, tokenise), "not a valid search expression; read as ordinary words"


def phrases(node) -> list[Phrase]:
    """All phrases that add to a score: those on the right of NOT do not."""
    if isinstance(node, Phrase):
        return [node]
    if isinstance(node, Near):
        return list(node.phrases)
    if isinstance(node, Without):
        return phrases(node.left)
    return phrases(node.left) + phrases(node.right)
