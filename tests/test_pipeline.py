import pytest
from pyspark.sql import functions as F

from lexweave.operators.pipeline import STEMMER, STOP_WORDS, TRIMMER, Pipeline, Registry, Step, expand, indexing, keep_if, scalar

UPPER = scalar("upper", F.upper, str.upper)
TWICE = expand("twice", lambda c: F.array(c, F.concat(c, F.lit("!"))), lambda t: [t, t + "!"])
SHORT = keep_if("short", lambda c: F.length(c) < 4, lambda t: len(t) < 4)


def test_order_and_editing():
    p = Pipeline(TRIMMER).add(STEMMER).before(STEMMER, STOP_WORDS).after(TRIMMER, UPPER)
    assert p.save() == ["trimmer", "upper", "stopWordFilter", "stemmer"]
    assert p.remove(UPPER).remove(UPPER).save() == ["trimmer", "stopWordFilter", "stemmer"]
    for place in (p.after, p.before):
        with pytest.raises(ValueError, match="no step"):
            place(UPPER, SHORT)
    assert p.reset().save() == []


def test_registry():
    r = Registry([UPPER])
    r.register(UPPER)
    assert Pipeline.load(["upper", "stemmer"], r).save() == ["upper", "stemmer"]
    with pytest.raises(ValueError, match="registered already"):
        r.register(scalar("upper", F.lower, str.lower))
    with pytest.raises(ValueError, match="no step named"):
        Pipeline.load(["nothing"])


@pytest.mark.parametrize("steps", [(TRIMMER, STOP_WORDS, STEMMER), (UPPER, TWICE), (SHORT, TWICE, UPPER), (TWICE, TRIMMER), ()])
def test_column_and_plain_forms_agree(spark, steps):
    words = ["the", "plants", "running.", "...", "a", "Öl!", "it's"]
    p = Pipeline(*steps)
    rows = p.run(spark.createDataFrame([(w, w) for w in words], "source string, token string"))
    got = {}
    for r in rows.collect():
        got.setdefault(r["source"], []).append(r["token"])
    assert got == {w: p.run_string(w) for w in words if p.run_string(w)}


def test_frame_step(spark):
    first = Step("first", None, lambda t: [t], frame=lambda df: df.where("token_index = 0"))
    rows = spark.createDataFrame([("a", 0), ("b", 1)], "token string, token_index int")
    assert [r["token"] for r in Pipeline(first).run(rows).collect()] == ["a"]


def test_default_steps():
    assert indexing().save() == ["trimmer", "stopWordFilter", "stemmer"]


def test_tokens_are_trimmed_once_and_texts_shuffled(spark):
    from lexweave import queries

    def plan(name):
        return queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()

    for name in ("stop_word_filter", "pipeline_expanding"):
        found = plan(name)
        assert found.count("regexp_replace(") == 1, found
        assert found.count("Exchange hashpartitioning(doc_ref#") == 1 == found.count("Exchange hashpartitioning")
    assert "Window" not in plan("search_single")
