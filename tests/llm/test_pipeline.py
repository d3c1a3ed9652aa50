import os
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from lexweave.llm import langid, ngram_join, packing, quality, queries
from tests.llm import test_ngram_join, test_quality
from tests.llm.odd import docs, none

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@needs_data
def test_stages(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    done = table
    counts = [table.count()]
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, done, DATA).persist()
        counts.append(done.count())
        if name != "packing":
            assert done.schema.names == table.schema.names
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    assert {r["doc_id"] for r in done.select("doc_id").distinct().collect()} <= {r["doc_id"] for r in table.select("doc_id").collect()}


@needs_data
def test_stages_agree_with_their_operators(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r["doc_id"] for r in langid.keep_identified(spark, table, DATA).collect()}
    judged = langid.op4_language_id(spark, DATA).collect()
    assert kept == {r["doc_id"] for r in judged if r["lang_pred"] != "und" and not r["ambiguous"]}
    drawn = {r["doc_id"] for r in quality.keep_selected(spark, table, DATA).collect()}
    assert drawn == {r["doc_id"] for r in quality.op10_quality(spark, DATA).collect() if r["selected"]}
    firsts = {r["doc_id"] for r in ngram_join.keep_first(spark, table, DATA).collect()}
    assert firsts == {r["doc_id"] for r in ngram_join.op2_near_duplicates(spark, DATA).collect() if r["doc_id"] == r["component_id"]}


def test_run_equals_brute_force(spark, tmp_path):
    """Language by the query's judgement (held against brute force in its own tests), then draw, links and packing by definition."""
    rng = np.random.default_rng(12)
    words = {"en": "the and of that with this for are was not".split(), "de": "der und die nicht mit das ist war ein zu".split()}
    rows = []
    for i in range(160):
        lang = "en" if i % 3 else "de"
        own = [*words[lang], *(f"{'junk' if i % 5 == 0 else 'fine'}{lang}{k}" for k in range(12))]
        rows.append((i, " ".join(rng.choice(own, int(rng.integers(8, 60)))), lang))
    rows += [(200 + i, rows[i][1] + (" MORE" if i % 8 else ""), rows[i][2]) for i in range(0, 60, 4)]
    rows += [(300, None, "en"), (301, "12 34", "en"), (302, " ".join(words["en"] + words["de"]), None), (303, " ".join(["the and of"] * 4000), "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i % 5 != 0)) for i in range(0, 160, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    judged = {r["doc_id"] for r in langid.op4_language_id(spark, str(tmp_path)).collect() if r["lang_pred"] != "und" and not r["ambiguous"]}
    texts = [(i, t) for i, t, _ in rows if i in judged]
    learn = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5]
    drawn, _ = test_quality.brute(texts, learn, sum(y for _, y in learn) / len(learn))
    texts = [x for x in texts if x[0] in drawn]
    first = {i for i, _, component, _ in test_ngram_join.brute(texts) if i == component}
    assert len(rows) > len(judged) > len(drawn) > len(first) > 40
    size = {i: len(t.split()) for i, t in texts if i in first}
    bins = defaultdict(list)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for r in got:
        bins[r["bin_id"], r["bin_capacity"]].append((r["bin_offset"], r["n_tokens"]))
        size[r["doc_id"]] -= r["n_tokens"]
    assert {r["doc_id"] for r in got} == first and set(size.values()) == {0}
    for (_, capacity), held in bins.items():
        end = 0
        for offset, n in sorted(held):
            assert offset == end
            end += n
        assert capacity == min(c for c in packing.LENGTHS if c >= end)


def test_odd_tables(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, 1), (8, 1), (10, 0), (None, 1), (3, None)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns
    none(spark).write.parquet(str(tmp_path / "e" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "e" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "e")).count() == 0


@needs_data
@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, DATA)
    assert df.columns == [d[0] for d in cur.description]
    assert {tuple(r) for r in df.collect()} == set(cur.fetchall())
