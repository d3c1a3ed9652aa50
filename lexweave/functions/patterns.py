"""Predicates over the vocabulary: exact, wildcard and edit-distance terms.

A pattern compiles to a Column predicate, so expanding a term is a filter of the
vocabulary: equality and prefixes reach the Parquet scan, the rest is a
regular expression. Edit distances whose regular expression would get too
long run a matcher in a vectorised function.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANY = "\0"
MOST_ALTERNATIVES = 1500


@lru_cache(maxsize=4096)
def edits(rest: str, k: int) -> frozenset[str]:
    """All texts within k edits of ``rest``, ANY standing for any character.

    Edits go from left to right. After two neighbours change places the one moved
    back stays at the head of the rest and can be edited again; a deletion takes the head only.
    """
    if not rest and not k:
        return frozenset([""])
    out = {""} if not rest else {rest[0] + p for p in edits(rest[1:], k)}
    if k:
        out |= {ANY + p for p in edits(rest, k - 1)}
        if rest:
            out |= edits(rest[1:], k - 1) | {ANY + p for p in edits(rest[1:], k - 1)}
        if len(rest) > 1:
            out |= {rest[1] + p for p in edits(rest[0] + rest[2:], k - 1)}
    return frozenset(out)


def within(pattern: str, k: int, word: str) -> bool:
    """The same by following all states at once; a * in the pattern is any one character."""
    states = {(pattern, k)}

    def closed(new: set[tuple[str, int]]) -> set[tuple[str, int]]:
        todo = list(new)
        while todo:
            s, left = todo.pop()
            if s and left and (nxt := (s[1:], left - 1)) not in new:
                new.add(nxt)
                todo.append(nxt)
        return new

    states = closed(states)
    for ch in word:
        step = set()
        for s, left in states:
            if s and s[0] in (ch, "*"):
                step.add((s[1:], left))
            if left:
                step.add((s, left - 1))
                if s:
                    step.add((s[1:], left - 1))
                if len(s) > 1 and s[1] in (ch, "*"):
                    step.add((s[0] + s[2:], left - 1))
        states = closed(step)
    return any(not s for s, _ in states)


@dataclass(frozen=True)
class Pattern:
    """What a query term matches."""

    text: str
    distance: int = 0

    @property
    def exact(self) -> bool:
        return not self.distance and "*" not in self.text

    @property
    def prefix(self) -> str:
        """What every match begins with."""
        return "" if self.distance else self.text.partition("*")[0]

    def pushed(self, term: Column) -> Column | None:
        """A predicate that every match meets and that a Parquet scan can use; None if there is none."""
        if self.exact:
            return term == F.lit(self.text)
        return term.startswith(self.prefix) if self.prefix else None

    @property
    def regex(self) -> str | None:
        """A regular expression for the whole word, None where it would be too long."""
        if not self.distance:
            return "(?s)^" + ".*".join(re.escape(p) for p in re.split(r"\*+", self.text)) + "$"
        found = edits(self.text.replace("*", ANY), self.distance) if len(self.text) ** self.distance <= 8 * MOST_ALTERNATIVES else ()
        if not found or len(found) > MOST_ALTERNATIVES:
            return None
        return "(?s)^(?:" + "|".join(sorted("".join("." if c == ANY else re.escape(c) for c in p) for p in found)) + ")$"

    def matches(self, word: str) -> bool:
        if self.distance:
            return bool(word) and within(self.text, self.distance, word)
        return word == self.text if self.exact else re.match(self.regex, word) is not None

    def column(self, term: Column) -> Column:
        if self.exact:
            return term == F.lit(self.text)
        if not self.distance and "*" not in self.text[:-1]:
            return term.startswith(self.text[:-1])
        text, distance = self.text, self.distance
        if self.regex and not distance:
            return term.startswith(self.prefix) & term.rlike(self.regex) if self.prefix else term.rlike(self.regex)
        near = F.length(term).between(len(text) - distance, len(text) + distance)  # an edit changes the length by one at most
        if self.regex:
            return near & term.rlike(self.regex)

        @F.pandas_udf(T.BooleanType())
        def match(words: pd.Series) -> pd.Series:
            return words.map(lambda w: within(text, distance, w))

        return near & match(term)


class TokenSet:
    """A set of words on the driver, for small vocabularies; ``intersect`` also filters a vocabulary DataFrame."""

    def __init__(self, words: Iterable[str] = ()):
        self.words = sorted(set(words))

    def __iter__(self):
        return iter(self.words)

    def __contains__(self, word: str) -> bool:
        at = bisect_left(self.words, word)
        return at < len(self.words) and self.words[at] == word

    def any(self) -> bool:
        return bool(self.words)

    def intersect(self, pattern: Pattern) -> TokenSet:
        return TokenSet(w for w in self.words if pattern.matches(w))

    @staticmethod
    def expand(vocabulary: DataFrame, pattern: Pattern, term_col: str = "term") -> DataFrame:
        return vocabulary.where(pattern.column(F.col(term_col)))
