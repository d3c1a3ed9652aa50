import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lexweave.functions.patterns import Pattern, TokenSet, within


@pytest.mark.parametrize(("pattern", "word"), [("foo*", "foo"), ("*ab*", "acbaabab"), ("a*ba*b", "acbaabab"), ("*ff", "f" * 70), ("*", "x"), ("f**o", "foo")])
def test_wildcard(pattern, word):
    assert Pattern(pattern).matches(word)


def test_wildcard_no_match():
    assert not Pattern("b*").matches("abc")
    assert not Pattern("a.c").matches("abc")


@pytest.mark.parametrize("word", "ar br ba bbar baar barr bara abr bra bar cur".replace("cur", "").split())
def test_one_edit(word):
    assert Pattern("bar", 1).matches(word)


@pytest.mark.parametrize(("a", "k", "b", "expected"), [("car", 1, "foo", False), ("abc", 2, "abcxx", True), ("abc", 2, "axx", True), ("abc", 2, "a", True), ("abc", 2, "bca", True), ("ab", 2, "bca", True), ("abc", 2, "ca", False)])
def test_edits(a, k, b, expected):
    assert Pattern(a, k).matches(b) is expected


def test_regex_equals_matcher():
    rng = random.Random(5)
    words = ["".join(w) for n in range(1, 5) for w in itertools.product("abc", repeat=n)]
    for _ in range(60):
        p, k = rng.choice(words), rng.choice([1, 2, 3])
        found = re.compile(Pattern(p, k).regex)
        for w in rng.sample(words, 60):
            assert bool(found.match(w)) == within(p, k, w), (p, k, w)


def test_star_in_an_edited_term_is_one_character():
    assert Pattern("b*r", 1).matches("bar")
    assert not Pattern("b*r", 1).matches("baaaar")


def test_columns(spark):
    words = spark.createDataFrame([(w,) for w in ["plant", "plumb", "plan", "a+b", "waterplants"]], "term string")
    for p in (Pattern("plant"), Pattern("pl*"), Pattern("*ant"), Pattern("a+*"), Pattern("plont", 1), Pattern("waterplantsxyzabc", 7)):
        got = {r["term"] for r in TokenSet.expand(words, p).collect()}
        assert got == {r["term"] for r in words.collect() if p.matches(r["term"])}


def test_prefixes_are_pushed_down(spark, tmp_path):
    spark.createDataFrame([("plant",)], "term string").write.parquet(str(tmp_path / "v"))
    for p in (Pattern("plant"), Pattern("pl*")):
        plan = spark.read.parquet(str(tmp_path / "v")).where(p.column(F.col("term")))._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [IsNotNull(term), " in plan


def test_token_set():
    s = TokenSet(["foo", "bar", "foo"])
    assert list(s) == ["bar", "foo"] and s.any() and "bar" in s
    assert list(s.intersect(Pattern("f*"))) == ["foo"]
    assert not TokenSet().any()
