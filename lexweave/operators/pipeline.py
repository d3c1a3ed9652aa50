"""Analysis pipelines: named steps from one token to none, one or several.

A step has a Column form, for DataFrames of tokens, and a plain form, for the
few tokens of a query. Steps are looked up by name in a registry, so a stored
index can name its pipeline.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.functions.stemmer import stem, stem_column


@dataclass(frozen=True)
class Step:
    """``column``: token column to token column (null or empty: dropped), or to an array of tokens if ``many``.

    ``plain``: one token to a list. ``frame``, if given, takes the whole token
    DataFrame instead (columns doc_ref, field, token, token_index, ...), for steps that look at
    neighbours or write metadata.
    """

    name: str
    column: Callable[[Column], Column] | None
    plain: Callable[[str], list[str]]
    many: bool = False
    frame: Callable[[DataFrame], DataFrame] | None = None
    #: Steps that only drop tokens: what is kept.
    kept: Callable[[Column], Column] | None = None
    #: Whether the step is known to run in Python workers.
    python: bool = False

    def apply(self, tokens: DataFrame, col: str = "token") -> DataFrame:
        if self.frame:
            out = self.frame(tokens)
        elif self.many:
            out = tokens.withColumn(col, F.explode(self.column(F.col(col))))
        elif self.kept:
            out = tokens.where(self.kept(F.col(col)))
        else:  # behind a generator the optimizer doesn't compute the token again in each filter that follows
            out = tokens.withColumn(col, F.explode(F.array(self.column(F.col(col)))))
        return out.where(F.col(col) != "")


def scalar(name: str, column: Callable[[Column], Column], plain: Callable[[str], str], python: bool = False) -> Step:
    return Step(name, column, lambda t: [plain(t)], python=python)


def keep_if(name: str, column: Callable[[Column], Column], plain: Callable[[str], bool]) -> Step:
    return Step(name, lambda c: F.when(column(c), c), lambda t: [t] if plain(t) else [], kept=column)


def expand(name: str, column: Callable[[Column], Column], plain: Callable[[str], list[str]]) -> Step:
    return Step(name, column, plain, many=True)


def stop_word_filter(words: Iterable[str], name: str = "stopWordFilter") -> Step:
    dropped = {w.lower() for w in words}
    return keep_if(name, lambda c: ~F.lower(c).isin(sorted(dropped)), lambda t: t.lower() not in dropped)


TRIMMER = scalar("trimmer", X.trim, X.trim_text)
STOP_WORDS = stop_word_filter(X.STOP_WORDS)
STEMMER = scalar("stemmer", stem_column, stem, python=True)


class Registry(dict[str, Step]):
    """Steps by name; the built-in ones are always there."""

    def __init__(self, steps: Iterable[Step] = ()):
        super().__init__()
        for s in (TRIMMER, STOP_WORDS, STEMMER):
            self[s.name] = s
        for s in steps:
            self.register(s)

    def register(self, step: Step) -> None:
        if self.get(step.name, step) is not step:
            raise ValueError(f"a step named {step.name!r} is registered already")
        self[step.name] = step


class Pipeline:
    """An ordered list of steps."""

    def __init__(self, *steps: Step):
        self.steps = list(steps)

    @classmethod
    def load(cls, names: Iterable[str], registry: Registry | None = None) -> Pipeline:
        known = registry or Registry()
        out = cls()
        for name in names:
            if name not in known:
                raise ValueError(f"no step named {name!r} is registered")
            out.add(known[name])
        return out

    def save(self) -> list[str]:
        return [s.name for s in self.steps]

    def add(self, *steps: Step) -> Pipeline:
        self.steps += steps
        return self

    def _place(self, anchor: Step) -> int:
        if anchor not in self.steps:
            raise ValueError(f"the pipeline has no step {anchor.name!r}")
        return self.steps.index(anchor)

    def after(self, anchor: Step, step: Step) -> Pipeline:
        self.steps.insert(self._place(anchor) + 1, step)
        return self

    def before(self, anchor: Step, step: Step) -> Pipeline:
        self.steps.insert(self._place(anchor), step)
        return self

    def remove(self, step: Step) -> Pipeline:
        self.steps = [s for s in self.steps if s is not step]
        return self

    def reset(self) -> Pipeline:
        self.steps = []
        return self

    def run(self, tokens: DataFrame) -> DataFrame:
        for step in self.steps:
            tokens = tokens.transform(step.apply)
        return tokens

    @property
    def python(self) -> bool:
        return any(s.python or s.frame for s in self.steps)

    def run_string(self, token: str) -> list[str]:
        out = [token]
        for step in self.steps:
            out = [t for x in out for t in step.plain(x) if t]
        return out


def indexing() -> Pipeline:
    return Pipeline(TRIMMER, STOP_WORDS, STEMMER)


def searching() -> Pipeline:
    return Pipeline(STEMMER)
