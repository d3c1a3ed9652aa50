import time

import pytest
from pyspark import InheritableThread
from pyspark.sql import functions as F

from lexweave.operators.index import FieldSpec, build_index
from lexweave.operators.pipeline import TRIMMER, Pipeline
from lexweave.plans.query import Presence, Wildcard
from lexweave.plans.search import Index
from tests.corpus import GREEN, green_index, results

CASES = {
    "professor": [("b", 1.648), ("c", 1.388)],
    "scarlett": [("c", 4.888)],
    "foo": [],
    "fellow candlestick": [("a", 12.419624)],
    "week foo": [("c", 9.141)],
    "fellow candlestick foo bar green plant fellow": [("a", 10.499475), ("b", 1.169044), ("c", 0.841349)],
    "candlestick green": [("a", 7.223096), ("b", 0.919946), ("c", 0.694379)],
    "water": [("c", 4.38), ("b", 0.508)],
    "title:plant": [("b", 0.144)],
    "title:candlestick": [],
    "candle*": [("a", 8.782)],
    "pl*": [("b", 2.534271), ("c", 1.759282)],
    "*ant": [("b", 1.792), ("c", 1.244)],
    "pl*nt": [("b", 1.792), ("c", 1.244)],
    "p*t": [("b", 1.792), ("c", 1.244)],
    "plont~1": [("b", 1.792), ("c", 1.244)],
    "plint~2": [("b", 1.792), ("c", 1.244)],
    "foo~1": [],
    "scarlett candlestick^5": [("a", 8.611459), ("c", 0.958616)],
    "plant^0": [("b", 0.0), ("c", 0.0)],
    "-green": [],
    "-candlestick green": [("b", 1.301), ("c", 0.982)],
    "-qwertyuiop": [("a", 0.0), ("b", 0.0), ("c", 0.0)],
    "-plant": [("a", 0.0)],
    "-title:plant plumb": [("c", 1.244)],
    "+candlestick green": [("a", 7.223096)],
    "+mustard +plant": [],
    "+qwertyuiop green": [],
    "+title:plant green": [("b", 1.402823)],
    "+title:plant +green": [("b", 1.402823)],
    "+title:plant +body:study": [("b", 5.946)],
    "+title:plant +body:qwertyuiop": [],
    "+plant green -office": [("b", 2.187081)],
    "study": [("b", 5.802), ("a", 4.208)],
    "": [("a", 0.0), ("b", 0.0), ("c", 0.0)],
    "green.": [],
    "the": [],
}


@pytest.fixture(scope="module")
def index(spark):
    return green_index(spark).cache()


def test_fixture_queries(index):
    found = {}
    for r in index.search_many(dict(zip(map(str, range(len(CASES))), CASES, strict=True))).collect():
        found.setdefault(int(r["query_id"]), []).append((r["doc_ref"], round(r["score"], 6)))
    for i, (text, expected) in enumerate(CASES.items()):
        assert sorted(found.get(i, []), key=lambda x: (-x[1], x[0])) == expected, text


def test_single_query_is_ordered(index):
    assert results(index.search("candlestick green")) == CASES["candlestick green"]
    assert results(index.search("candlestick green", limit=1)) == CASES["candlestick green"][:1]


def test_document_boost(spark):
    i = green_index(spark, 1.0, 1.0, boost=F.when(F.col("id") == "c", 10.0).otherwise(1.0)).cache()
    assert results(i.search("plumb")) == [("c", 1.244), ("b", 0.309)]
    assert results(i.search("green study^10")) == [("b", 0.590057), ("a", 0.441398), ("c", 0.097713)]


def test_programmatic(index):
    assert results(index.query(lambda q: q.add_term("study"))) == [("b", 5.802), ("a", 4.208)]
    assert results(index.query(lambda q: q.add_term("study", use_pipeline=False))) == []
    ahead = index.query(lambda q: q.add_term("pl", boost=100).add_term("pl", use_pipeline=False, wildcard=Wildcard.TRAILING).add_term("pl", edit_distance=1))
    assert results(ahead) == [("b", 2.534271), ("c", 1.759282)]
    with pytest.raises(ValueError, match="no field"):
        index.query(lambda q: q.add_term("x", fields=["nowhere"]))


def test_match_data(index):
    got = {r["doc_ref"]: r["match_data"] for r in index.search("pl*", match_data=True).collect()}
    assert {d: {t: set(f) for t, f in m.items()} for d, m in got.items()} == {"b": {"plant": {"title", "body"}, "plumb": {"title", "body"}}, "c": {"plant": {"body"}, "plumb": {"body"}}}
    (r,) = index.search("+title:plant +body:study", match_data=True).collect()
    assert set(r["match_data"]) == {"studi", "plant"}


def test_positions(spark):
    df = spark.createDataFrame([("me", None, "I am developer.")], "id string, title string, body string")
    i = Index(build_index(df, "id", [FieldSpec("title", 2), FieldSpec("body")], metadata=["position", "index"]))
    (r,) = i.search("developer", match_data=True).collect()
    found = r["match_data"]["develop"]["body"]
    assert [tuple(p) for p in found["position"]] == [(5, 10)] and found["index"] == [2]


def test_weights(index):
    got = {(r["field"], r["doc_ref"], r["term"]): r["weight"] for r in index.tables.postings.collect()}
    assert got["title", "a", "mr"] == 0.409 and got["body", "a", "mr"] == 5.982 and got["body", "c", "week"] == 9.141 and got["title", "c", "help"] == 1.06
    assert len(got) == 5 + 10 + 3 + 5 + 3 + 11


def test_two_required_one_missing(spark):
    df = spark.createDataFrame([("0001", "Wonderland", "Alice"), ("0002", "Sponge", "Bob")], "ref string, lastname string, firstname string")
    i = Index(build_index(df, "ref", ["ref", FieldSpec("lastname", 3), FieldSpec("firstname", 2)]))
    assert results(i.search("+Alice +abc")) == []


def test_nested_field_and_custom_separator(spark):
    df = spark.createDataFrame([("1", {"name": "bob"}, "constructor(this,is,special)")], "id string, person map<string,string>, title string")
    i = Index(build_index(df, "id", [FieldSpec("name", value=F.col("person")["name"])], pipeline=Pipeline()))
    assert [r["term"] for r in i.tables.terms.collect()] == ["bob"]
    j = build_index(df, "id", ["title"], separator=r"[^\w]", pipeline=Pipeline())
    assert {(r["term"], r["tf"]) for r in j.postings.collect()} == {("constructor", 1), ("this", 1), ("is", 1), ("special", 1)}


def test_empty_corpus_and_empty_fields(spark):
    df = spark.createDataFrame([], "id string, title string, body string")
    i = Index(build_index(df, "id", ["title", "body"]))
    assert results(i.search("foo")) == [] and results(i.search("")) == []
    one = Index(build_index(spark.createDataFrame([("1", "the", None)], "id string, title string, body string"), "id", ["title", "body"]))
    assert results(one.search("-x")) == [("1", 0.0)]
    assert {r["field"]: r["avg_length"] for r in one.tables.field_stats.collect()} == {"title": 0.0, "body": None}


def test_many_required_clauses_span_masks(spark):
    words = [f"w{i}x" for i in range(70)]
    df = spark.createDataFrame([("1", " ".join(words)), ("2", " ".join(words[:-1]))], "id string, body string")
    i = Index(build_index(df, "id", ["body"]))
    assert [d for d, _ in results(i.query(lambda q: q.add_terms(words, presence=Presence.REQUIRED)))] == ["1"]


def test_bad_fields(spark):
    df = spark.createDataFrame(GREEN, "id string, title string, body string, n int")
    for bad in ("", "a/b"):
        with pytest.raises(ValueError, match="name a field"):
            FieldSpec(bad)
    with pytest.raises(ValueError, match="twice"):
        build_index(df, "id", ["title", "title"])
    with pytest.raises(ValueError, match="unique"):
        build_index(df.union(df), "id", ["title"], check_refs=True)


def test_b_is_clamped(spark):
    df = spark.createDataFrame(GREEN, "id string, title string, body string, n int")
    low, zero = (sorted(map(tuple, build_index(df, "id", ["body"], b=b).postings.select("term", "doc_ref", "weight").collect())) for b in (-3, 0))
    assert low == zero


def test_array_fields_keep_their_elements(spark):
    rows = [("a", ["New York", "San-Jose", None, ""], "New York"), ("b", [], "San-Jose"), ("c", None, None)]
    df = spark.createDataFrame(rows, "id string, tags array<string>, body string")
    tables = build_index(df, "id", ["tags", "body"], pipeline=Pipeline(TRIMMER), search_pipeline=Pipeline())
    got = {(r["term"], r["field"], r["doc_ref"]) for r in tables.postings.collect()}
    assert got == {("New York", "tags", "a"), ("San-Jose", "tags", "a"), ("new", "body", "a"), ("york", "body", "a"), ("san", "body", "b"), ("jose", "body", "b")}
    assert {(r["doc_ref"], r["field"]): r["length"] for r in tables.field_lengths.collect()} == {("a", "tags"): 2, ("b", "tags"): 0, ("a", "body"): 2, ("b", "body"): 2}
    placed = build_index(df, "id", ["tags", "body"], pipeline=Pipeline(TRIMMER), search_pipeline=Pipeline(), metadata=["position"])
    assert {r["term"]: [tuple(p) for p in r["metadata"]["position"]] for r in placed.postings.where("doc_ref = 'a'").collect()} == {"New York": [(None, None)], "San-Jose": [(None, None)], "new": [(0, 3)], "york": [(4, 4)]}


def test_a_search_can_be_cancelled(spark):
    index = green_index(spark)
    failed = []

    def run():
        with index.cancellable("late"):
            try:
                slow = F.udf(lambda x: (time.sleep(40), x)[1], "string")
                index.search("plant").select(slow("doc_ref")).collect()
            except Exception as e:
                failed.append(str(e))

    thread = InheritableThread(target=run)
    began = time.time()
    thread.start()
    while thread.is_alive() and time.time() - began < 30:
        time.sleep(1)
        index.cancel("late")
    thread.join(60)
    assert len(failed) == 1 and "cancel" in failed[0].lower() and time.time() - began < 35
    with index.cancellable("idle"):
        assert results(index.search("plant"))


def test_tokens_are_shuffled_once(spark):
    tables = green_index(spark).tables
    plan = tables.counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(doc_ref" in plan and "Window" in plan
    with tables.holding() as held:
        assert held.counted.storageLevel.useDisk
        assert "InMemoryTableScan" in held.field_lengths._jdf.queryExecution().executedPlan().toString()
    assert not tables.counted.storageLevel.useDisk
