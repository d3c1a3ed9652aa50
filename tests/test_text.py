import datetime
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.functions import text as X
from lexweave.functions.stemmer import stem, stem_column

STEMS = {
    "consign": "consign", "consigned": "consign", "consignment": "consign", "consistency": "consist", "consolatory": "consolatori", "constance": "constanc",
    "conspirators": "conspir", "constant": "constant", "knackeries": "knackeri", "kneaded": "knead", "knitting": "knit", "knives": "knive", "knightly": "knightli",
    "ties": "ti", "caresses": "caress", "sky": "ski", "cry": "cri", "say": "say", "by": "by", "agreed": "agre", "feed": "feed", "hopping": "hop", "falling": "fall", "hissing": "hiss",
    "filing": "file", "happy": "happi", "relational": "relat", "adoption": "adopt", "rate": "rate", "controll": "control", "roll": "roll", "yelling": "yell", "youth": "youth",
}


@pytest.mark.parametrize(("word", "expected"), STEMS.items())
def test_stem(word, expected):
    assert stem(word) == expected


def test_stem_column_equals_stem(spark):
    rows = spark.createDataFrame([(w,) for w in STEMS] + [(None,)], "w string")
    assert {r["w"]: r["s"] for r in rows.select("w", stem_column("w").alias("s")).collect()} == STEMS | {None: None}


@pytest.mark.parametrize(
    ("text", "expected"),
    [("foo-bar", ["foo", "bar"]), ("foo - bar", ["foo", "bar"]), (" Foo bar", ["foo", "bar"]), ("", []), ("it's a　TEST", ["it's", "a", "test"]), ("a\x85b\x0bc", ["a", "b", "c"])],
)
def test_tokens(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(X.tokens(F.col("t")).alias("x"), X.placed_tokens()("t").alias("p")).first()
    assert got["x"] == expected == [p["token"] for p in got["p"]] == [t for t, _, _ in X.tokenize(text)]


def test_places():
    assert X.tokenize(" foo bar") == [("foo", 1, 3), ("bar", 5, 3)]


def test_places_by_columns(spark):
    texts = ["", " -", None, "\n", "ab-\U0001f33f  \u0130x\u3000\u2028y\x85z\xa0 " * 1000, "ΟΔΟΣ ΟΔΟΣ", *(" ".join(["Wörd-X"] * n) + "-" * (n % 3) for n in (1, 2, 500))]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.placed_tokens()(F.col("t")).alias("p"))
    assert {r["i"]: r["p"] and [tuple(p) for p in r["p"]] for r in found.coalesce(1).collect()} == {i: t and X.tokenize(t) for i, t in enumerate(texts)} | {0: []}


def test_places_hold_no_object_a_token():
    text = "some words " * 100_000
    for run in range(2):  # the first one imports
        tracemalloc.start()
        X.places(pa.array([text, "x", text]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert peak < 40 * 400_000


def test_array_tokens(spark):
    assert spark.sql("SELECT array('Foo', null, 'b c') AS a").select(X.array_tokens(F.col("a")).alias("x")).first()["x"] == ["Foo", "", "b c"]


@pytest.mark.parametrize(("token", "expected"), [("«año»", "año"), ("l'été", "l'été"), ("¿qué?!", "qué"), ("(3.14)", "3.14"), ("٣٤%", "٣٤"), ("_x_;", "_x_"), ("𝒳𝒴…", "𝒳𝒴"), ("👍ok👍", "ok"), ("—", "")])
def test_trim(spark, token, expected):
    assert X.trim_text(token) == expected
    assert spark.range(1).select(X.trim(F.lit(token)).alias("x")).first()["x"] == expected


def test_stop_words(spark):
    rows = spark.createDataFrame([(w,) for w in "Would yet YOU a Äpfel 7 thee across river-bank".split()], "w string")
    assert [r["w"] for r in rows.where(~X.is_stop_word(F.col("w"))).collect()] == ["Äpfel", "7", "thee", "river-bank"]
    assert len(X.STOP_WORDS) == 119


def test_dates_numbers_booleans(spark):
    when = datetime.datetime(2013, 1, 1, 12)
    got = spark.createDataFrame([(when, 41, False)], "d timestamp, n int, b boolean").select(X.as_text(F.col("d"), T.TimestampType()).alias("d"), X.as_text(F.col("n"), T.IntegerType()).alias("n"), X.as_text(F.col("b"), T.BooleanType()).alias("b")).first()
    assert tuple(got) == ("Tue Jan 01 2013 12:00:00 GMT+0000", "41", "false")
