"""Query strings and clauses: lexer, parser and the programmatic builder.

    query  := clause*
    clause := ['+' | '-'] [field ':'] term ('~' digits | '^' digits)*

Clauses are parted by white space or hyphens. A backslash takes the next
character literally; * in a term stands for any number of characters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from enum import Enum, Flag

from lexweave.functions.patterns import Pattern
from lexweave.functions.text import SEPARATOR
from lexweave.operators.pipeline import Pipeline


class Presence(Enum):
    OPTIONAL = "optional"
    REQUIRED = "required"
    PROHIBITED = "prohibited"


class Wildcard(Flag):
    NONE = 0
    LEADING = 1
    TRAILING = 2
    BOTH = 3


class LexemeType(Enum):
    TERM = "term"
    FIELD = "field"
    EDIT_DISTANCE = "edit distance"
    BOOST = "boost"
    PRESENCE = "presence"


@dataclass(frozen=True)
class Lexeme:
    type: LexemeType
    value: str
    start: int
    end: int


class QueryParseError(ValueError):
    """A query string that isn't well formed; ``start`` and ``end`` tell where."""

    def __init__(self, message: str, start: int, end: int):
        super().__init__(message)
        self.start, self.end = start, end


def lex(text: str) -> list[Lexeme]:
    out: list[Lexeme] = []
    word: list[str] = []
    start = at = 0

    def close(kind: LexemeType, end: int) -> None:
        nonlocal word
        if word:
            out.append(Lexeme(kind, "".join(word), start, end))
        word = []

    while at < len(text):
        c = text[at]
        if not word and c != "\\":
            start = at
        if c == "\\" and at + 1 < len(text):
            if not word:
                start = at
            word.append(text[at + 1])
            at += 2
            continue
        if c == ":" and word:
            close(LexemeType.FIELD, at)
        elif c in "~^":
            close(LexemeType.TERM, at)
            digits = re.compile(r"[0-9]*").match(text, at + 1)
            out.append(Lexeme(LexemeType.EDIT_DISTANCE if c == "~" else LexemeType.BOOST, digits[0], at + 1, digits.end()))
            at = digits.end()
            continue
        elif c in "+-" and not word:
            out.append(Lexeme(LexemeType.PRESENCE, c, at, at + 1))
        elif re.match(SEPARATOR, c):
            close(LexemeType.TERM, at)
        else:
            word.append(c)
        at += 1
    close(LexemeType.TERM, len(text))
    return out


@dataclass(frozen=True)
class Clause:
    term: str = ""
    boost: float = 1.0
    edit_distance: int = 0
    use_pipeline: bool = True
    wildcard: Wildcard = Wildcard.NONE
    presence: Presence = Presence.OPTIONAL
    fields: tuple[str, ...] = ()

    def __post_init__(self):
        term = self.term
        if self.wildcard & Wildcard.LEADING and not term.startswith("*"):
            term = "*" + term
        if self.wildcard & Wildcard.TRAILING and not term.endswith("*"):
            term += "*"
        object.__setattr__(self, "term", term)

    def with_(self, **changes) -> Clause:
        """A copy with some values changed; ``fields`` are added to those there are."""
        if "fields" in changes:
            changes["fields"] = self.fields + tuple(changes["fields"])
        return replace(self, **changes)

    def patterns(self, pipeline: Pipeline) -> list[Pattern]:
        """What the clause looks for in the vocabulary, once for each term that the pipeline makes of its term."""
        terms = pipeline.run_string(self.term) if self.use_pipeline else [self.term]
        return [Pattern(self.with_(term=t).term, self.edit_distance) for t in terms]


@dataclass
class Query:
    all_fields: list[str]
    clauses: list[Clause] = field(default_factory=list)

    def add_clause(self, clause: Clause) -> Query:
        if unknown := [f for f in clause.fields if f not in self.all_fields]:
            raise ValueError(f"the index has no field {unknown[0]!r}")
        self.clauses.append(clause if clause.fields else clause.with_(fields=self.all_fields))
        return self

    def add_term(self, term: str, boost: float = 1.0, edit_distance: int = 0, use_pipeline: bool = True, wildcard: Wildcard = Wildcard.NONE, presence: Presence = Presence.OPTIONAL, fields: Iterable[str] = ()) -> Query:
        return self.add_clause(Clause(term, boost, edit_distance, use_pipeline, wildcard, presence, tuple(fields)))

    def add_terms(self, terms: Iterable[str], **options) -> Query:
        for t in terms:
            self.add_term(t, **options)
        return self

    @property
    def is_negated(self) -> bool:
        return all(c.presence is Presence.PROHIBITED for c in self.clauses)


PRESENCE = {"+": Presence.REQUIRED, "-": Presence.PROHIBITED}


def parse(text: str, fields: Iterable[str]) -> Query:
    query = Query(list(fields))
    lexemes = lex(text)
    at = 0

    def expect(kinds: tuple[LexemeType, ...], last: Lexeme, what: str) -> Lexeme:
        if at >= len(lexemes):
            raise QueryParseError(f"expected {what} after {last.value!r}, found nothing", last.start, last.end)
        if lexemes[at].type not in kinds:
            raise QueryParseError(f"expected {what}, found {lexemes[at].type.value} {lexemes[at].value!r}", lexemes[at].start, lexemes[at].end)
        return lexemes[at]

    while at < len(lexemes):
        here, clause = lexemes[at], Clause()
        if here.type is LexemeType.PRESENCE:
            clause = clause.with_(presence=PRESENCE[here.value])
            at += 1
            here = expect((LexemeType.FIELD, LexemeType.TERM), here, "a field or a term")
        if here.type is LexemeType.FIELD:
            if here.value not in query.all_fields:
                raise QueryParseError(f"the index has no field {here.value!r}; it has {', '.join(query.all_fields)}", here.start, here.end)
            clause = clause.with_(fields=(here.value,))
            at += 1
            here = expect((LexemeType.TERM,), here, "a term")
        here = expect((LexemeType.TERM,), here, "a field or a term")
        clause = clause.with_(term=here.value.lower(), use_pipeline="*" not in here.value)
        at += 1
        while at < len(lexemes) and lexemes[at].type in (LexemeType.EDIT_DISTANCE, LexemeType.BOOST):
            here = lexemes[at]
            if not here.value:
                raise QueryParseError(f"the {here.type.value} must be a whole number", here.start, here.end)
            clause = clause.with_(edit_distance=int(here.value)) if here.type is LexemeType.EDIT_DISTANCE else clause.with_(boost=float(here.value))
            at += 1
        query.add_clause(clause)
    return query


def build(fields: Iterable[str], make: Callable[[Query], object]) -> Query:
    query = Query(list(fields))
    make(query)
    return query
