import io
import json
import math
import re

import pytest
from pyspark.sql import functions as F

from lexweave.operators.index import FieldSpec, build_index, field_ref, parse_field_ref
from lexweave.operators.pipeline import Pipeline, Step
from lexweave.plans.search import Index
from lexweave.sources.json_index import from_json, load_json, load_json_lines, load_json_pieces, save_json, save_json_lines, save_json_pieces, to_json
from lexweave.sources.store import TABLES, IndexStore, open_index, save_index
from tests.corpus import GREEN, SCRIPT, green_index, results

#: Fixed value: the interchange text of the four-document corpus.
VECTORS = (
    '[["title/a",[0,0.545,1,0.083,2,0.545,3,0.545,4,0.545]],["body/a",[0,0.845,1,0.128,2,0.584,3,0.584,4,0.584,5,0.584,6,1.015,7,1.015,8,1.015,9,1.015]],'
    '["title/b",[10,0.357,11,0.693,12,0.357]],["body/b",[1,0.126,5,0.826,10,0.425,12,0.425,13,0.425]],["title/c",[13,0.357,14,0.693,15,1.204]],'
    '["body/c",[1,0.093,10,0.314,11,0.61,12,0.314,13,0.314,14,0.61,16,1.059,17,1.059,18,1.059,19,1.059,20,1.059]],["title/d",[21,0.953]],["body/d",[21,0.826,22,1.435,23,1.435,24,1.435,25,1.435]]]'
)


@pytest.fixture(scope="module")
def text(spark):
    return to_json(green_index(spark, 1.0, 1.0, rows=[*GREEN, SCRIPT]))


def test_json_layout(text):
    assert text.startswith('{"version":"2.3.9","fields":["title","body"],"fieldVectors":' + VECTORS + ',"invertedIndex":[["__proto__",{"_index":24,"title":{},"body":{"d":{}}}],["away",')
    assert text.endswith('["week",{"_index":20,"title":{},"body":{"c":{}}}]],"pipeline":["stemmer"]}')


def test_digits_and_underscores(spark):
    df = spark.createDataFrame([("underscore", "_", 0), ("zero", "0", 1), ("all the things", "0 _", 2)], "id string, title string, o int")
    got = to_json(Index(build_index(df, "id", ["title"], order=F.col("o"))))
    assert got == (
        '{"version":"2.3.9","fields":["title"],"fieldVectors":[["title/underscore",[0,0.524]],["title/zero",[1,0.524]],["title/all the things",[0,0.39,1,0.39]]],'
        '"invertedIndex":[["0",{"_index":1,"title":{"zero":{},"all the things":{}}}],["_",{"_index":0,"title":{"underscore":{},"all the things":{}}}]],"pipeline":["stemmer"]}'
    )


def test_json_round_trip(spark, text):
    again = from_json(spark, text)
    assert to_json(again) == text
    assert results(again.search("professor")) == results(green_index(spark, 1.0, 1.0, rows=[*GREEN, SCRIPT]).search("professor"))
    out = io.StringIO()
    save_json(again, out)
    assert to_json(load_json(spark, io.StringIO(out.getvalue()))) == text


def test_json_positions_round_trip(spark):
    df = spark.createDataFrame([("me", "I am developer.")], "id string, body string")
    got = to_json(Index(build_index(df, "id", ["body"], metadata=["position"])))
    assert '"body":{"me":{"position":[[5,10]]}}' in got
    assert to_json(from_json(spark, got)) == got


def test_json_pieces_round_trip(spark, tmp_path, monkeypatch):
    rows = [*GREEN, SCRIPT, ('q"/\\u00e9\n', 'say "plant"', "a\\b \U0001f33f study", 3)]
    index = green_index(spark, rows=rows, metadata=["position"])
    want = to_json(index)
    monkeypatch.setattr("lexweave.sources.json_index.to_json", None)
    monkeypatch.setattr("lexweave.sources.json_index.from_json", None)
    save_json_pieces(index, str(tmp_path / "pieces"))
    pieces = spark.read.json(str(tmp_path / "pieces"))
    assert pieces.where("section = 3 and part = 1").count() == index.tables.postings.count()
    again = load_json_pieces(spark, str(tmp_path / "pieces"))
    assert to_json(again) == want == json.dumps(json.loads(want), ensure_ascii=False, separators=(",", ":"))
    spark.read.json(str(tmp_path / "pieces")).where("section < 4").write.json(str(tmp_path / "short"))
    with pytest.raises(ValueError, match="piece"):
        load_json_pieces(spark, str(tmp_path / "short"))


def test_json_query_collects_no_table(spark, monkeypatch):
    from lexweave import queries
    from pyspark.sql.classic.dataframe import DataFrame

    took = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: took.append(collect(df)) or took[-1])
    queries.queries()["index_roundtrip_json"](spark, "/root/testdata/sf0.001")
    assert max(map(len, took), default=0) <= 3


def test_json_order_version_and_sections(spark, text):
    data = json.loads(text)
    shuffled = data | {"invertedIndex": data["invertedIndex"][::-1]}
    assert to_json(from_json(spark, json.dumps(shuffled))) == text
    with pytest.warns(UserWarning, match="version"):
        from_json(spark, json.dumps(data | {"version": "1.0.0"}))
    for section in ("fields", "fieldVectors", "invertedIndex", "pipeline"):
        with pytest.raises(ValueError, match=section):
            from_json(spark, json.dumps({k: v for k, v in data.items() if k != section}))


def test_parquet_bundle(spark, tmp_path):
    path = str(tmp_path / "bundle")
    save_index(green_index(spark), path)
    again = open_index(spark, path)
    assert results(again.search("+plant green -office")) == [("b", 2.187081)]
    save_index(green_index(spark, 1.0, 1.0), path)
    assert results(open_index(spark, path).search("professor")) != [("b", 1.648), ("c", 1.388)]


def test_json_lines_round_trip(spark, tmp_path):
    index = green_index(spark, metadata=["position"])
    save_json_lines(index.tables, str(tmp_path / "lines"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "lines" / "postings")).collect()]
    assert len(lines) == index.tables.postings.count() and {x["term"] for x in lines} >= {"plant", "green"}
    again = load_json_lines(spark, str(tmp_path / "lines"))
    assert results(again.search("+plant green -office")) == [("b", 2.187081)]
    assert to_json(again) == to_json(index)


def test_store_entries(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "s"))
    with pytest.raises(FileNotFoundError):
        store.table("terms")
    store.save(green_index(spark).tables)
    assert store.fields() == ["title", "body"]
    store.add_field("extra")
    assert store.fields() == ["title", "body", "extra"]
    assert store.remove_field("extra") and not store.remove_field("extra")
    assert {r["term"] for r in store.vector("title", "b").collect()} == {"plumb", "water", "plant"}
    assert store.vector_keys("title").count() == 3 and store.vector_keys().count() == 6
    store.put_vector("title", "b", spark.createDataFrame([("tree", 2, 0.5)], "term string, tf int, weight double"))
    assert [(r["term"], r["tf"]) for r in store.vector("title", "b").collect()] == [("tree", 2)]
    assert results(store.open().search("tree")) == [("b", 0.5)]
    assert store.remove_vector("title", "b") and not store.remove_vector("title", "b")
    store.put_entry("zebra", spark.createDataFrame([("body", "a", 1, 0.25)], "field string, doc_ref string, tf int, weight double"), 1.5)
    assert [(r["doc_ref"], r["weight"]) for r in store.entry("zebra").collect()] == [("a", 0.25)]
    assert [r["term"] for r in store.vocabulary("ze").collect()] == ["zebra"]
    assert results(store.open().search("zebra")) == [("a", 0.25)]
    assert [r["weight"] for r in store.vector("body", "a").where("term = 'zebra'").collect()] == [0.25]
    store.put_entry("yak", spark.createDataFrame([("body", "a", 1, 0.5), ("body", "b", 1, 0.5)], "field string, doc_ref string, tf int, weight double"))
    (r,) = store.table("terms").where("term = 'yak'").collect()
    assert r["df"] == 2 and r["idf"] == pytest.approx(math.log(1 + 1.5 / 2.5))


def test_changes_take_effect_at_once_or_not_at_all(spark, tmp_path, monkeypatch):
    store = IndexStore(spark, str(tmp_path / "s"))
    store.save(green_index(spark).tables)
    before = {t: store.table(t).count() for t in (*TABLES, "vectors")}
    old = store.open()
    original = IndexStore._write

    def failing(self, table, df):
        if table == "field_lengths":
            raise OSError("disk full")
        return original(self, table, df)

    monkeypatch.setattr(IndexStore, "_write", failing)
    with pytest.raises(OSError):
        store.remove_vector("title", "b")
    monkeypatch.undo()
    assert {t: store.table(t).count() for t in (*TABLES, "vectors")} == before
    assert store.remove_vector("title", "b") and store.table("postings").count() < before["postings"]
    assert old.tables.postings.count() == before["postings"], "readers of the old state aren't disturbed"
    assert store.vacuum() > 0 and store.vacuum() == 0
    assert results(store.open().search("plant")) and store.open().tables.postings.count() == store.table("vectors").count()


def scans(df):
    """PushedFilters of every scan in a plan, by the columns it reads."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [(re.search(r"ReadSchema: struct<([^>]*)>", x)[1], re.search(r"PushedFilters: \[(.*?)\], Read", x)[1]) for x in plan.splitlines() if "FileScan parquet" in x and "term:string" in x]


@pytest.mark.parametrize(
    ("query", "filters", "least"),
    [
        ("plant", "EqualTo(term,plant)", 2), ("plant green", "In(term, [green,plant])", 2), ("pl*", "StringStartsWith(term,pl)", 2), ("green pl*t", "Or(EqualTo(term,green),StringStartsWith(term,pl))", 2),
        ("*ant", "EqualTo(term,plant)", 1), ("plont~1 *een", "In(term, [green,plant])", 1), ("zzz*", "StringStartsWith(term,zzz)", 2),
    ],
)
def test_searches_read_the_terms_they_need(spark, tmp_path_factory, query, filters, least):
    path = str(tmp_path_factory.getbasetemp() / "pruned")
    store = IndexStore(spark, path)
    if not store._versions("meta"):
        store.save(green_index(spark).tables)
    df = store.open().search(query)
    found = scans(df)
    assert len(found) >= least and all(filters in f for _, f in found), found
    assert any("weight" in c for c, _ in found)
    assert results(df) == results(green_index(spark).search(query))


def test_single_entries_reach_the_scan(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "p"))
    store.save(green_index(spark).tables)
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,plant)]" in store.entry("plant")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(field,title), EqualTo(doc_ref,b)" in store.vector("title", "b")._jdf.queryExecution().executedPlan().toString()


def test_metadata_of_any_type_is_stored(spark, tmp_path):
    kind = "struct<page:int,box:array<double>>"
    note = Step("note", None, lambda t: [t], frame=lambda df: df.withColumn("note", F.struct(F.col("token_index").alias("page"), F.array(F.lit(0.5)).alias("box"))))
    df = spark.createDataFrame([("x", "green plant")], "id string, body string")
    save_index(Index(build_index(df, "id", ["body"], pipeline=Pipeline(note), search_pipeline=Pipeline(), metadata=["note"])), str(tmp_path / "m"))
    again = open_index(spark, str(tmp_path / "m"))
    assert again.tables.postings.schema["metadata"].dataType.simpleString() == f"struct<note:array<{kind}>>"
    (r,) = again.search("plant", match_data=True).collect()
    assert r["match_data"]["plant"]["body"]["note"][0].asDict() == {"page": 1, "box": [0.5]}


def test_field_references():
    assert parse_field_ref("title/http://example.com/123") == ("title", "http://example.com/123")
    assert field_ref("title", "a/b") == "title/a/b"
    with pytest.raises(ValueError, match="no field reference"):
        parse_field_ref("title")


def test_stream(spark, tmp_path):
    from lexweave.streaming.append import DocumentStream

    source = str(tmp_path / "in")
    spark.createDataFrame(GREEN[:2], "id string, title string, body string, n int").write.parquet(source)
    stream = DocumentStream(spark, str(tmp_path / "docs"))
    schema = spark.read.parquet(source).schema
    stream.start(spark.readStream.schema(schema).parquet(source), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame(GREEN[2:], "id string, title string, body string, n int").write.mode("append").parquet(source)
    stream.start(spark.readStream.schema(schema).parquet(source), str(tmp_path / "cp")).awaitTermination()
    index = stream.index("id", [FieldSpec("title"), FieldSpec("body", 10.0)])
    assert results(index.search("plant")) == [("b", 1.792), ("c", 1.244)]
