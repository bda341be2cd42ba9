"""The query language: lexer, parser, and a compiler that turns a query into one DataFrame plan."""

from __future__ import annotations

import re
from dataclasses import dataclass


class QuerySyntaxError(ValueError):
    def __init__(self, message: str, position: int):
        super().__init__(f"{message} at position {position}")
        self.position = position


class QueryTimeout(RuntimeError):
    pass


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Phrase:
    text: str


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    child: object


@dataclass(frozen=True)
class Typed:
    """EXACT:, FUZZY:, PHONETIC:, PREFIX:, COMPOUND: or REGEX: with its value."""

    kind: str
    text: str


@dataclass(frozen=True)
class InField:
    name: str
    child: object


@dataclass(frozen=True)
class Scored:
    child: object
    operator: str
    value: float


@dataclass(frozen=True)
class InLanguage:
    name: str
    child: object


KINDS = ("EXACT", "FUZZY", "PHONETIC", "PREFIX", "COMPOUND", "REGEX")
KEYWORDS = ("AND", "OR", "NOT", "SCORE", "LANG", *KINDS)
_TOKEN = re.compile(r"""(?P<string>"[^"]*"|'[^']*')|(?P<open>"|')|(?P<op>>=|<=|>|<)|(?P<number>[0-9.]+)|(?P<word>[^\W\d_](?:[^\W_]|_|-(?=\w))*|_\w*)|(?P<mark>[():])""")


def unwrap(query: str) -> str | None:
    """What is inside fql(...); None if the text is not of that form."""
    text = query.strip()
    return text[4:-1].strip() if text.startswith("fql(") and text.endswith(")") else None


def lex(text: str) -> list[tuple[str, str, int]]:
    """(kind, value, position); characters that begin no token are skipped."""
    out = []
    for m in _TOKEN.finditer(text):
        kind, value = m.lastgroup, m[0]
        if kind == "open":
            raise QuerySyntaxError("unterminated string", m.start())
        if kind == "word" and value.upper() in KEYWORDS:
            kind, value = "key", value.upper()
        out.append((kind, value[1:-1] if kind == "string" else value, m.start()))
    return [*out, ("end", "", len(text))]


class Parser:
    """NOT binds closer than AND, AND closer than OR; all to the left. A NOT B is A AND NOT B."""

    def __init__(self, text: str):
        self.tokens, self.at = lex(text), 0

    def parse(self):
        if self.tokens[0][0] == "end":
            raise QuerySyntaxError("empty query", 0)
        out = self._or()
        if self._kind() != "end":
            raise QuerySyntaxError(f"unexpected {self._value()!r}", self.tokens[self.at][2])
        return out

    def _kind(self) -> str:
        return self.tokens[self.at][0]

    def _value(self) -> str:
        return self.tokens[self.at][1]

    def _take(self, kind: str, value: str | None = None) -> bool:
        hit = self._kind() == kind and (value is None or self._value() == value)
        self.at += hit
        return hit

    def _need(self, kind: str, value: str | None = None) -> str:
        got = self._value()
        if not self._take(kind, value):
            raise QuerySyntaxError(f"expected {value or kind}, found {got or 'the end'!r}", self.tokens[self.at][2])
        return got

    def _or(self):
        out = self._and()
        while self._take("key", "OR"):
            out = Or(out, self._and())
        return out

    def _and(self):
        out = self._not()
        while True:
            if self._take("key", "AND"):
                out = And(out, self._not())
            elif self._kind() == "key" and self._value() == "NOT":
                out = And(out, self._not())
            else:
                return out

    def _not(self):
        return Not(self._scored()) if self._take("key", "NOT") else self._scored()

    def _scored(self):
        out = self._primary()
        while self._take("key", "SCORE"):
            op = self._need("op")
            at, raw = self.tokens[self.at][2], self._need("number")
            try:
                value = float(raw)
            except ValueError:
                raise QuerySyntaxError("not a number", at) from None
            if not 0 <= value <= 1:
                raise QuerySyntaxError("a score lies between 0 and 1", at)
            out = Scored(out, op, value)
        return out

    def _primary(self):
        kind, value, at = self.tokens[self.at]
        if self._take("mark", "("):
            out = self._or()
            self._need("mark", ")")
            return out
        if kind == "key" and value in KINDS:
            self.at += 1
            self._need("mark", ":")
            if self._kind() not in ("string", "word", "number"):
                raise QuerySyntaxError("expected a value", self.tokens[self.at][2])
            text = self._value()
            self.at += 1
            return Typed(value.lower(), text)
        if self._take("key", "LANG"):
            self._need("mark", ":")
            return InLanguage(self._need("word").lower(), self._primary())
        if self._take("string"):
            return Phrase(value)
        if kind == "word":
            self.at += 1
            return InField(value, self._primary()) if self._take("mark", ":") else Term(value)
        if kind == "number" and self._take("number"):
            return Term(value)
        raise QuerySyntaxError(f"unexpected {value or 'end'!r}", at)


def parse(text: str):
    return Parser(text).parse()
