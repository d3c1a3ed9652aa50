import re

import pytest

from lexweave.llm import licenses
from tests.llm.odd import docs, none


def shingles(text):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute(texts, templates):
    out = {}
    for k, text in enumerate(texts):
        own = shingles(text or "")
        for name, t in templates:
            t = shingles(t)
            want = set(t)
            starts = {p - o for p, s in enumerate(own) for o, x in enumerate(t) if s == x}
            slack = len(t) + licenses.STEP
            best = max((len(want & set(own[max(0, a - slack) : a + len(t) + slack])) / len(want) for a in starts), default=0)
            if best >= 0.75:
                out[k, name] = round(best, 4)
    return out


def cases():
    filler = " ".join(f"filler{i}" for i in range(300))
    full = dict(licenses.TEMPLATES)
    out = []
    for _, t in licenses.TEMPLATES:
        w = t.split()
        out += [t, f"{filler} {t.upper()} {filler}", " ".join(w[: int(len(w) * 0.9)]), " ".join(w[: len(w) // 2]), f"x y {t}"]
        if len(w) > 30:
            out.append(" ".join([*w[:20], "changed", *w[21:]]))
    out.append(f"{full['MIT']} {filler} {full['Apache-2.0']}\n{full['MIT-notice']}")
    return [*out, None, "", "license", filler]


def test_equals_brute_force(spark):
    texts = cases()
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["license"]): round(r["containment"], 4) for r in got} == brute(texts, licenses.TEMPLATES)


def test_places_and_short_templates(spark):
    df = spark.createDataFrame([(1, "one two three Released under the MIT License. four"), (2, "Beerware")], "doc_id long, text string")
    got = licenses.scan(df, [("MIT", "Released under the MIT License."), ("beer", "beerware"), ("empty", "...")]).collect()
    assert {(r["doc_id"], r["license"], r["first_word"]) for r in got} >= {(2, "beer", 0)}
    assert {r["license"] for r in got if r["doc_id"] == 1} == {"MIT"}


def test_native_plan(spark):
    plan = licenses.scan(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "BroadcastHashJoin" in plan


def test_odd_rows_and_bounds(spark):
    assert licenses.scan(docs(spark)).count() == 0
    assert licenses.scan(none(spark)).count() == 0
    with pytest.raises(ValueError, match="templates"):
        licenses.scan(none(spark), [("x", "y")] * (licenses.MOST_TEMPLATES + 1))
