"""Set algebra over keys, with the empty and the universal set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeySet:
    """A set of keys in a one-column DataFrame; ``keys`` None is the universal set."""

    keys: DataFrame | None

    @classmethod
    def complete(cls) -> KeySet:
        return cls(None)

    @classmethod
    def of(cls, df: DataFrame, col: str) -> KeySet:
        return cls(df.select(F.col(col).alias("key")).distinct())

    @classmethod
    def empty(cls, like: DataFrame, col: str) -> KeySet:
        return cls(like.select(F.col(col).alias("key")).where(F.lit(False)))

    def union(self, other: KeySet) -> KeySet:
        if self.keys is None or other.keys is None:
            return KeySet(None)
        return KeySet(self.keys.union(other.keys).distinct())

    def intersect(self, other: KeySet) -> KeySet:
        if self.keys is None:
            return other
        if other.keys is None:
            return self
        return KeySet(self.keys.intersect(other.keys))

    def contains(self, df: DataFrame, col: str | Column) -> DataFrame:
        """The rows of ``df`` whose key is in the set."""
        return self._joined(df, col, "left_semi") if self.keys is not None else df

    def lacks(self, df: DataFrame, col: str | Column) -> DataFrame:
        """The rows of ``df`` whose key isn't in the set."""
        return self._joined(df, col, "left_anti") if self.keys is not None else df.where(F.lit(False))

    def _joined(self, df: DataFrame, col: str | Column, how: str) -> DataFrame:
        key = df[col] if isinstance(col, str) else col
        return df.join(self.keys.withColumnRenamed("key", "_key"), key == F.col("_key"), how)
