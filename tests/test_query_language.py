import pytest

from lexweave.operators.pipeline import Pipeline, searching
from lexweave.plans.query import Clause, LexemeType, Presence, Query, QueryParseError, Wildcard, lex, parse

T, F, E, B, P = LexemeType.TERM, LexemeType.FIELD, LexemeType.EDIT_DISTANCE, LexemeType.BOOST, LexemeType.PRESENCE


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("foo", [(T, "foo", 0, 3)]),
        ("foo-bar", [(T, "foo", 0, 3), (T, "bar", 4, 7)]),
        (r"foo\:bar", [(T, "foo:bar", 0, 8)]),
        ("foo bar", [(T, "foo", 0, 3), (T, "bar", 4, 7)]),
        ("foo    bar", [(T, "foo", 0, 3), (T, "bar", 7, 10)]),
        ("+foo +bar", [(P, "+", 0, 1), (T, "foo", 1, 4), (P, "+", 5, 6), (T, "bar", 6, 9)]),
        ("foo - bar", [(T, "foo", 0, 3), (P, "-", 4, 5), (T, "bar", 6, 9)]),
        ("title:foo", [(F, "title", 0, 5), (T, "foo", 6, 9)]),
        ("foo~2", [(T, "foo", 0, 3), (E, "2", 4, 5)]),
        ("foo^10 b", [(T, "foo", 0, 3), (B, "10", 4, 6), (T, "b", 7, 8)]),
        ("title:foo^10~5", [(F, "title", 0, 5), (T, "foo", 6, 9), (B, "10", 10, 12), (E, "5", 13, 14)]),
        ("foo^2.5", [(T, "foo", 0, 3), (B, "2", 4, 5), (T, ".5", 5, 7)]),
        ("foo+bar", [(T, "foo+bar", 0, 7)]),
    ],
)
def test_lexemes(text, expected):
    assert [(x.type, x.value, x.start, x.end) for x in lex(text)] == expected


def clauses(text):
    return parse(text, ["title", "body"]).clauses


def test_defaults():
    (c,) = clauses("FOO")
    assert c == Clause("foo", fields=("title", "body")) and c.boost == 1 and c.edit_distance == 0 and c.use_pipeline


def test_modifiers():
    (c,) = clauses("+title:foo~2^6")
    assert (c.fields, c.edit_distance, c.boost, c.presence) == (("title",), 2, 6, Presence.REQUIRED)
    assert [x.presence for x in clauses("a -b")] == [Presence.OPTIONAL, Presence.PROHIBITED]
    assert not clauses("fo*")[0].use_pipeline


@pytest.mark.parametrize("text", ["unknown:foo", "title:", "+", "foo~a", "~2", "foo^a", "^2", "title:+foo", "+ +a", "unknown-field:plant", "Title:foo"])
def test_errors(text):
    with pytest.raises(QueryParseError) as e:
        clauses(text)
    assert 0 <= e.value.start <= e.value.end <= len(text)


def test_negated():
    assert parse("", ["a"]).is_negated and parse("-x -y", ["a"]).is_negated and not parse("-x y", ["a"]).is_negated


def test_wildcards_are_put_once():
    assert Clause("fo", wildcard=Wildcard.BOTH).term == "*fo*"
    assert Clause("*fo*", wildcard=Wildcard.BOTH).term == "*fo*"
    (p,) = Clause("plants", wildcard=Wildcard.TRAILING).patterns(searching())
    assert p.text == "plants*" or p.text == "plant*"


def test_builder():
    q = Query(["title", "body"]).add_terms(["a", "b"], boost=3).add_clause(Clause("c", fields=("title",)))
    assert [c.fields for c in q.clauses] == [("title", "body"), ("title", "body"), ("title",)]
    with pytest.raises(ValueError, match="no field"):
        q.add_term("x", fields=["nowhere"])
    assert Clause("x", fields=("a",)).with_(fields=("a",)).fields == ("a", "a")


def test_empty_pipeline_result_is_no_pattern():
    from lexweave.operators.pipeline import STOP_WORDS

    assert Clause("the").patterns(Pipeline(STOP_WORDS)) == []
