import math

import pytest
from pyspark.sql import functions as F

from lexweave.functions import vectors as V
from lexweave.operators.sets import KeySet


def keys(s):
    return sorted(r["key"] for r in s.keys.collect())


def test_sets(spark):
    a, b = (KeySet.of(spark.createDataFrame([(x,) for x in xs], "k string"), "k") for xs in ("aab", "bc"))
    none, every = KeySet.empty(a.keys, "key"), KeySet.complete()
    assert keys(a.union(b)) == ["a", "b", "c"] and keys(a.intersect(b)) == ["b"]
    assert keys(a.union(none)) == ["a", "b"] and keys(a.intersect(none)) == []
    assert a.union(every).keys is None and every.union(a).keys is None
    assert keys(a.intersect(every)) == ["a", "b"] == keys(every.intersect(a))
    rows = spark.createDataFrame([("a",), ("c",)], "x string")
    assert [r["x"] for r in a.contains(rows, "x").collect()] == ["a"] and [r["x"] for r in a.lacks(rows, "x").collect()] == ["c"]
    assert every.contains(rows, "x").count() == 2 and every.lacks(rows, "x").count() == 0


def test_sparse_vector():
    v = V.SparseVector((0, 4), (1, 5), (2, 6))
    assert v.magnitude() == pytest.approx(math.sqrt(77))
    assert V.SparseVector((0, 1), (1, 3), (2, -5)).dot(V.SparseVector((0, 4), (1, -2), (2, -1))) == 3
    w = V.SparseVector((5, 1))
    w.insert(2, 7)
    w.upsert(5, 2, lambda a, b: a + b)
    assert w.flat() == [2, 7, 5, 3] and w.to_array() == [7, 3] and len(w) == 2
    with pytest.raises(ValueError, match="already"):
        w.insert(2, 1)
    assert V.SparseVector().similarity(v) == 0 and v.similarity(v) == pytest.approx(math.sqrt(77))


def test_vector_columns(spark):
    r = spark.sql("SELECT array(4D, 5D, 6D) a, array(1D, 3D, -5D) b, array(4D, -2D, -1D) c, array(0D) z, array(named_struct('index', 2, 'value', 0.5D)) p").select(
        V.magnitude(F.col("a")).alias("m"), V.dot(F.col("b"), F.col("c")).alias("d"), V.similarity(F.col("z"), F.col("z")).alias("s"), V.flat(F.col("p")).alias("f")
    )
    m, d, s, f = r.first()
    assert m == pytest.approx(math.sqrt(77)) and d == 3 and s == 0 and f == [2.0, 0.5]
