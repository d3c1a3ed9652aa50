"""Vectors: sparse ones on the driver, columns of (index, value) or plain arrays in DataFrames."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class SparseVector:
    """Values by increasing index."""

    def __init__(self, *pairs: tuple[int, float]):
        self.index: list[int] = []
        self.value: list[float] = []
        for i, v in pairs:
            self.insert(i, v)

    def __len__(self) -> int:
        return len(self.index)

    def insert(self, index: int, value: float) -> None:
        def twice(_: float, __: float) -> float:
            raise ValueError(f"index {index} is there already")

        self.upsert(index, value, twice)

    def upsert(self, index: int, value: float, merge: Callable[[float, float], float]) -> None:
        at = bisect_left(self.index, index)
        if at < len(self.index) and self.index[at] == index:
            self.value[at] = merge(self.value[at], value)
        else:
            self.index.insert(at, index)
            self.value.insert(at, value)

    def magnitude(self) -> float:
        return math.sqrt(sum(v * v for v in self.value))

    def dot(self, other: SparseVector) -> float:
        mine = dict(zip(self.index, self.value, strict=True))
        return sum(mine.get(i, 0.0) * v for i, v in zip(other.index, other.value, strict=True))

    def similarity(self, other: SparseVector) -> float:
        """The dot product over this vector's magnitude; the other's isn't used."""
        size = self.magnitude()
        return self.dot(other) / size if size else 0.0

    def to_array(self) -> list[float]:
        return list(self.value)

    def flat(self) -> list[float]:
        return [x for pair in zip(self.index, self.value, strict=True) for x in pair]


def magnitude(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def similarity(q: Column, d: Column) -> Column:
    size = magnitude(q)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(q, d) / size)


def flat(pairs: Column) -> Column:
    """[index, value, index, value, ...] of an array of (index, value)."""
    return F.flatten(F.transform(pairs, lambda p: F.array(p["index"].cast("double"), p["value"])))


def upserted(a: Column, b: Column) -> Column:
    """Two arrays of (index, value) as one by index, values of an index that both have added."""
    summed = F.map_zip_with(F.map_from_entries(a), F.map_from_entries(b), lambda _, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
    return F.transform(F.array_sort(F.map_entries(summed)), lambda e: F.struct(e["key"].alias("index"), e["value"].alias("value")))
