"""The engine's registered queries over the given tables, and the DuckDB SQL each equals.

Stemming is off in most of them; where it is on, the SQL follows the published steps. Scores are rounded to
six digits on both sides, as sums of doubles depend on their order.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.functions import vectors as V
from lexweave.functions.patterns import Pattern
from lexweave.functions.stemmer import STEP2, STEP3, STEP4, stem, stem_column
from lexweave.operators.index import FieldSpec, build_index, documents, field_texts, tokenized, with_term_ids
from lexweave.operators.pipeline import STOP_WORDS, TRIMMER, Pipeline, expand
from lexweave.operators.sets import KeySet
from lexweave.plans.query import Presence, Query, Wildcard
from lexweave.plans.search import Index, search_many
from lexweave.sources.json_index import load_json_lines, load_json_pieces, save_json_lines, save_json_pieces
from lexweave.sources.store import IndexStore

PLAIN = (TRIMMER, STOP_WORDS)
PART_FIELDS = (FieldSpec("p_name"), FieldSpec("p_type"), FieldSpec("p_brand"))
Make = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Make] = {}
_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Make], Make]:
    def keep(f: Make) -> Make:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


# -- SQL shared by many -----------------------------------------------------

_SEP = r"[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}-]"
_EDGE = r"^[^\pL\p{Nd}_]+|[^\pL\p{Nd}_]+$"
_STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def _porter_ctes(words: str) -> str:
    """Table stems (word, stem) of a table of words, step by step: h tables add each word's shape, consonants and vowels."""

    def shaped(name: str, source: str, columns: str = "") -> str:
        y = "x IN ('a', 'e', 'i', 'o', 'u') OR (x = 'y' AND ends_with(a, 'c'))"
        return f"{name} AS (SELECT word, w{columns}, list_reduce(list_prepend('', string_split(w, '')), lambda a, x: a || CASE WHEN {y} THEN 'v' ELSE 'c' END) AS sh FROM {source})"

    def before(n: int) -> str:
        return f"left(sh, length(sh) - {n})"

    def m(shape: str) -> str:
        return f"len(regexp_extract_all({shape}, 'v+c+'))"

    def ends(s: str) -> str:
        return f"ends_with(w, '{s}') AND length(w) > {len(s)}"

    def cut(n: int) -> str:
        return f"left(w, length(w) - {n})"

    def by_length(suffixes) -> list[str]:
        return sorted(suffixes, key=len, reverse=True)

    def replaced(name: str, source: str, pairs: dict[str, str]) -> str:
        cases = " ".join(f"WHEN {ends(s)} THEN CASE WHEN {m(before(len(s)))} > 0 THEN {cut(len(s))} || '{pairs[s]}' ELSE w END" for s in by_length(pairs))
        return f"{name} AS (SELECT word, CASE {cases} ELSE w END AS w FROM {source})"

    short = "regexp_full_match({0}, 'c+vc') AND right({1}, 1) NOT IN ('w', 'x', 'y')"
    past = " ".join(f"WHEN {ends(s)} THEN CASE WHEN contains({before(len(s))}, 'v') THEN {{{len(s)}}} ELSE {{0}} END" for s in ("ed", "ing"))
    past_w = past.replace("{2}", cut(2)).replace("{3}", cut(3)).replace("{0}", "w")
    past_c = past.replace("{2}", "true").replace("{3}", "true").replace("{0}", "false")
    stripped = " ".join(f"WHEN {ends(s)} THEN CASE WHEN {m(before(len(s)))} > 1 THEN {cut(len(s))} ELSE w END" for s in by_length(STEP4))
    return ",\n".join(
        [
            f"p0 AS (SELECT word, CASE WHEN starts_with(word, 'y') THEN 'Y' || substr(word, 2) ELSE word END AS w FROM {words})",
            f"p1 AS (SELECT word, CASE WHEN ({ends('sses')}) OR ({ends('ies')}) THEN {cut(2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') AND length(w) > 2 THEN {cut(1)} ELSE w END AS w FROM p0)",
            shaped("h1", "p1"),
            f"p2 AS (SELECT word, CASE WHEN {ends('eed')} THEN CASE WHEN {m(before(3))} > 0 THEN {cut(1)} ELSE w END {past_w} ELSE w END AS w, CASE WHEN {ends('eed')} THEN false {past_c} ELSE false END AS cut FROM h1)",
            shaped("h2", "p2", ", cut"),
            "p3 AS (SELECT word, CASE WHEN NOT cut THEN w WHEN ends_with(w, 'at') OR ends_with(w, 'bl') OR ends_with(w, 'iz') THEN w || 'e' "
            f"WHEN length(w) > 1 AND right(w, 1) = left(right(w, 2), 1) AND right(w, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'y', 'l', 's', 'z') THEN {cut(1)} WHEN {short.format('sh', 'w')} THEN w || 'e' ELSE w END AS w FROM h2)",
            f"p4 AS (SELECT word, CASE WHEN length(w) > 2 AND ends_with(w, 'y') AND left(right(w, 2), 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN {cut(1)} || 'i' ELSE w END AS w FROM p3)",
            shaped("h4", "p4"),
            replaced("p5", "h4", STEP2),
            shaped("h5", "p5"),
            replaced("p6", "h5", STEP3),
            shaped("h6", "p6"),
            f"p7 AS (SELECT word, CASE {stripped} WHEN (ends_with(w, 'sion') OR ends_with(w, 'tion')) AND length(w) > 4 AND {m(before(3))} > 1 THEN {cut(3)} ELSE w END AS w FROM h6)",
            shaped("h7", "p7"),
            f"p8 AS (SELECT word, CASE WHEN ends_with(w, 'e') AND length(w) > 1 AND ({m(before(1))} > 1 OR ({m(before(1))} = 1 AND NOT ({short.format(before(1), cut(1))}))) THEN {cut(1)} ELSE w END AS w FROM h7)",
            shaped("h8", "p8"),
            f"p9 AS (SELECT word, CASE WHEN ends_with(w, 'll') AND {m('sh')} > 1 THEN {cut(1)} ELSE w END AS w FROM h8)",
            "stems AS (SELECT word, CASE WHEN length(word) < 3 THEN word WHEN starts_with(word, 'y') THEN 'y' || substr(w, 2) ELSE w END AS stem FROM p9)",
        ]
    )


def _ctes(fields: list[tuple[str, str, float]], table_name: str, key: str, doc_boost: str = "1.0", stemmed: bool = False) -> str:
    """Tables t (tokens), postings (with weights), len, st, terms over (field, expression, boost)."""
    plain = "plain" if stemmed else "kept"
    stems = ",\nwords AS (SELECT DISTINCT term AS word FROM plain),\n" + _porter_ctes("words") + ",\nkept AS (SELECT doc_ref, field, stem AS term FROM plain JOIN stems ON word = term WHERE stem <> '')" if stemmed else ""
    texts = " UNION ALL ".join(f"SELECT CAST({key} AS VARCHAR) AS doc_ref, '{f}' AS field, CAST({e} AS VARCHAR) AS text FROM {table_name}" for f, e, _ in fields)
    boosts = ", ".join(f"('{f}', CAST({b} AS DOUBLE))" for f, _, b in fields)
    return f"""
texts AS (SELECT * FROM ({texts}) WHERE text IS NOT NULL),
raw AS (SELECT doc_ref, field, unnest(regexp_split_to_array(lower(text), '{_SEP}')) AS piece FROM texts),
t AS (SELECT doc_ref, field, regexp_replace(piece, '{_EDGE}', '', 'g') AS term FROM raw WHERE piece <> ''),
{plain} AS (SELECT * FROM t WHERE term <> '' AND lower(term) NOT IN ({_STOPS})){stems},
tf AS (SELECT doc_ref, field, term, count(*) AS tf FROM kept GROUP BY ALL),
len AS (SELECT x.doc_ref, x.field, coalesce(l.length, 0) AS length FROM (SELECT doc_ref, field FROM texts) x LEFT JOIN (SELECT doc_ref, field, count(*) AS length FROM kept GROUP BY ALL) l USING (doc_ref, field)),
st AS (SELECT field, avg(length) AS avg_length FROM len GROUP BY field),
nd AS (SELECT count(DISTINCT {key}) AS n FROM {table_name}),
terms AS (SELECT term, count(*) AS df, ln(1 + abs(((SELECT n FROM nd) - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM tf GROUP BY term),
fb(field, boost) AS (VALUES {boosts}),
db AS (SELECT CAST({key} AS VARCHAR) AS doc_ref, CAST({doc_boost} AS DOUBLE) AS boost FROM {table_name}),
postings AS (SELECT term, field, doc_ref, tf, round_even(idf * (2.2 * tf) / (1.2 * (0.25 + 0.75 * (length / avg_length)) + tf) * (fb.boost * db.boost) * 1000, 0) / 1000 AS weight
  FROM tf JOIN terms USING (term) JOIN len USING (doc_ref, field) JOIN st USING (field) JOIN fb USING (field) JOIN db USING (doc_ref))"""


_PART = _ctes([("p_name", "p_name", 1), ("p_type", "p_type", 1), ("p_brand", "p_brand", 1)], "part", "p_partkey")
_DOCS = _ctes([("text", "text", 1)], "documents", "doc_id")
_STEMMED = _ctes([("text", "text", 1)], "documents", "doc_id", stemmed=True)


def _search_sql(ctes: str, clauses: list[tuple[str, list[str], float, str]]) -> str:
    """SQL of a search. Clauses: (condition on term, fields, boost, optional | required | prohibited)."""
    units = " UNION ALL ".join(
        f"SELECT {i} AS c, term, '{f}' AS field, CAST({b} AS DOUBLE) AS boost, '{p}' AS presence FROM terms WHERE {cond}" for i, (cond, scope, b, p) in enumerate(clauses) for f in scope
    )
    need = sum(p == "required" for *_, p in clauses)
    return f"""WITH {ctes},
u AS ({units}),
q AS (SELECT field, term, sum(boost) AS boost FROM u WHERE presence <> 'prohibited' GROUP BY ALL),
norm AS (SELECT field, sqrt(sum(boost * boost)) AS norm FROM q GROUP BY field),
s AS (SELECT doc_ref, sum(CASE WHEN norm > 0 THEN weight * boost / norm ELSE 0 END) AS score FROM postings JOIN q USING (term, field) JOIN norm USING (field) GROUP BY doc_ref),
bad AS (SELECT DISTINCT doc_ref FROM postings JOIN u USING (term, field) WHERE presence = 'prohibited'),
req AS (SELECT doc_ref, count(DISTINCT c) AS met FROM postings JOIN u USING (term, field) WHERE presence = 'required' GROUP BY doc_ref)
SELECT s.doc_ref, round(s.score, 6) AS score FROM s LEFT JOIN req USING (doc_ref)
WHERE coalesce(req.met, 0) = {need} AND s.doc_ref NOT IN (SELECT doc_ref FROM bad)"""


_ALL = ["p_name", "p_type", "p_brand"]


def _is(term: str) -> str:
    return f"term = '{term}'"


# -- indexes over the tables ------------------------------------------------


def part_index(spark: SparkSession, sf_dir: str, boosts: tuple[float, float, float] = (1, 1, 1), **options) -> Index:
    fields = [FieldSpec(f.name, b) for f, b in zip(PART_FIELDS, boosts, strict=True)]
    return Index(build_index(table(spark, sf_dir, "part"), "p_partkey", fields, pipeline=Pipeline(*PLAIN), search_pipeline=Pipeline(), **options))


def document_index(spark: SparkSession, sf_dir: str, **options) -> Index:
    return Index(build_index(table(spark, sf_dir, "documents"), "doc_id", [FieldSpec("text")], **{"pipeline": Pipeline(*PLAIN), "search_pipeline": Pipeline()} | options))


def document_tokens(spark: SparkSession, sf_dir: str, places: bool = False, by_document: bool = False) -> DataFrame:
    """``by_document``: texts are shuffled by their document, so that grouping tokens by it shuffles none."""
    fields = [FieldSpec("text")]
    texts = field_texts(documents(table(spark, sf_dir, "documents"), "doc_id", fields), fields)
    return tokenized(texts.repartition("doc_ref") if by_document else texts, places=places)


def _scores(df: DataFrame) -> DataFrame:
    return df.select("doc_ref", F.round("score", 6).alias("score"))


def _part_search(spark: SparkSession, sf_dir: str, text, **options) -> DataFrame:
    index = part_index(spark, sf_dir, **options)
    return _scores(search_many(index.tables, {"": text}))


# -- analysis ---------------------------------------------------------------


@query(f"SELECT CAST(doc_id AS VARCHAR) AS doc_ref, CAST(i - 1 AS INTEGER) AS token_index, p[i] AS token FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{_SEP}'), lambda x: x <> '') AS p FROM documents))")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_tokens(spark, sf_dir).select("doc_ref", "token_index", "token")


@query(
    f"""WITH c AS (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents),
s AS (SELECT doc_id, i, regexp_full_match(text[i], '{_SEP}') AS sep, text[i] AS ch FROM c),
g AS (SELECT *, sum(CASE WHEN sep THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM s)
SELECT CAST(doc_id AS VARCHAR) AS doc_ref, string_agg(lower(ch), '' ORDER BY i) AS token, CAST(min(i) - 1 AS INTEGER) AS start, CAST(count(*) AS INTEGER) AS length FROM g WHERE NOT sep GROUP BY doc_id, grp"""
)
def token_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_tokens(spark, sf_dir, places=True).select("doc_ref", "token", "start", "length")


@query(f"WITH {_DOCS} SELECT doc_ref, term AS token, count(*) AS n FROM t GROUP BY ALL")
def trim_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_tokens(spark, sf_dir, by_document=True).select("doc_ref", X.trim(F.col("token")).alias("token")).groupBy("doc_ref", "token").agg(F.count("*").alias("n"))


@query(f"WITH {_DOCS} SELECT doc_ref, term AS token, count(*) AS n FROM kept GROUP BY ALL")
def stop_word_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Pipeline(*PLAIN).run(document_tokens(spark, sf_dir, by_document=True)).groupBy("doc_ref", "token").agg(F.count("*").alias("n"))


@query(f"WITH {_STEMMED} SELECT word, stem FROM stems")
def stem_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = Pipeline(*PLAIN).run(document_tokens(spark, sf_dir)).select(F.col("token").alias("word")).distinct()
    return words.select("word", stem_column("word").alias("stem"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS doc_ref, strftime(o_orderdate, '%a %b %d %Y %H:%M:%S') || ' GMT+0000' AS token FROM orders")
def date_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").cast("string").alias("doc_ref"), X.as_text(F.col("o_orderdate"), orders.schema["o_orderdate"].dataType).alias("token"))


# -- statistics -------------------------------------------------------------


@query(f"WITH {_PART} SELECT doc_ref, field, term, CAST(tf AS INTEGER) AS tf FROM tf")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_index(spark, sf_dir).tables.postings.select("doc_ref", "field", "term", "tf")


@query(f"WITH {_PART} SELECT doc_ref, field, length FROM len")
def field_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_index(spark, sf_dir).tables.field_lengths.select("doc_ref", "field", "length")


@query(f"WITH {_PART} SELECT field, round(avg_length, 6) AS avg_length FROM st")
def avg_field_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_index(spark, sf_dir).tables.field_stats.select("field", F.round("avg_length", 6).alias("avg_length"))


@query(f"WITH {_PART} SELECT term, df FROM terms")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_index(spark, sf_dir).tables.terms.select("term", "df")


@query(f"WITH {_DOCS} SELECT term FROM terms")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).tables.vocabulary()


@query(f"WITH {_DOCS} SELECT term, round(idf, 6) AS idf FROM terms")
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).tables.terms.select("term", F.round("idf", 6).alias("idf"))


@query(f"WITH {_DOCS} SELECT term, doc_ref, round(weight, 3) AS weight FROM postings")
def bm25_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).tables.postings.select("term", "doc_ref", F.round("weight", 3).alias("weight"))


@query(f"WITH {_PART} SELECT term, field, doc_ref, round(weight, 3) AS weight FROM postings")
def bm25_weights_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_index(spark, sf_dir).tables.postings.select("term", "field", "doc_ref", F.round("weight", 3).alias("weight"))


# -- search -----------------------------------------------------------------


@query(_search_sql(_DOCS, [(_is("thble"), ["text"], 1, "optional")]))
def search_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(search_many(document_index(spark, sf_dir).tables, {"": "thble"}))


@query(_search_sql(_DOCS, [(_is(t), ["text"], 1, "optional") for t in ("thble", "queles", "und")]))
def search_documents_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(search_many(document_index(spark, sf_dir).tables, {"": "thble queles und"}))


def _registered_part(name: str, text, clauses: list[tuple[str, list[str], float, str]], boosts: tuple[float, float, float] = (1, 1, 1), part: str | None = None, doc_boost: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _part_search(spark, sf_dir, text, boosts=boosts, boost=F.expr(doc_boost) if doc_boost else None)

    _QUERIES[name] = run
    _SQL[name] = _search_sql(part or _PART, clauses)


_BOOSTED = _ctes([("p_name", "p_name", 1), ("p_type", "p_type", 10), ("p_brand", "p_brand", 5)], "part", "p_partkey")
_DOC_BOOSTED = _ctes([("p_name", "p_name", 1), ("p_type", "p_type", 1), ("p_brand", "p_brand", 1)], "part", "p_partkey", "CASE WHEN p_size > 25 THEN 10.0 ELSE 1.0 END")


def _register(words: tuple[str, ...]) -> None:
    a, b, c, d = words
    o, r, p = "optional", "required", "prohibited"
    _registered_part("search_multi_or", f"{a} {b}", [(_is(a), _ALL, 1, o), (_is(b), _ALL, 1, o)])
    _registered_part("search_field_scoped", f"p_type:{c}", [(_is(c), ["p_type"], 1, o)])
    _registered_part("search_term_boost", f"{a} {c}^5", [(_is(a), _ALL, 1, o), (_is(c), _ALL, 5, o)])
    _registered_part("search_zero_boost", f"{a}^0 {c}", [(_is(a), _ALL, 0, o), (_is(c), _ALL, 1, o)])
    _registered_part("search_field_boost", f"{a} {c}", [(_is(a), _ALL, 1, o), (_is(c), _ALL, 1, o)], (1, 10, 5), _BOOSTED)
    _registered_part("search_doc_boost", f"{a} {c}", [(_is(a), _ALL, 1, o), (_is(c), _ALL, 1, o)], part=_DOC_BOOSTED, doc_boost="CASE WHEN p_size > 25 THEN 10.0 ELSE 1.0 END")
    _registered_part("search_required", f"+{a} {c}", [(_is(a), _ALL, 1, r), (_is(c), _ALL, 1, o)])
    _registered_part("search_two_required", f"+{a} +{c}", [(_is(a), _ALL, 1, r), (_is(c), _ALL, 1, r)])
    _registered_part("search_required_missing", f"+{a} +nowhereatall", [(_is(a), _ALL, 1, r), (_is("nowhereatall"), _ALL, 1, r)])
    _registered_part("search_prohibited", f"{a} -{c}", [(_is(a), _ALL, 1, o), (_is(c), _ALL, 1, p)])
    _registered_part("search_mixed_presence", f"+p_type:{c} {a} -{d}", [(_is(c), ["p_type"], 1, r), (_is(a), _ALL, 1, o), (_is(d), _ALL, 1, p)])
    _registered_part("search_wildcard_trailing", f"{a[:2]}*", [(f"starts_with(term, '{a[:2]}')", _ALL, 1, o)])
    _registered_part("search_wildcard_leading", f"*{a[-3:]}", [(f"ends_with(term, '{a[-3:]}')", _ALL, 1, o)])
    _registered_part("search_wildcard_contained", f"{c[0]}*{c[-1]}", [(f"regexp_full_match(term, '{c[0]}.*{c[-1]}')", _ALL, 1, o)])
    _registered_part("search_fuzzy_1", f"{a[:-1]}x~1", [(f"damerau_levenshtein(term, '{a[:-1]}x') <= 1", _ALL, 1, o)])
    _registered_part("search_fuzzy_2", f"{c[:-2]}xx~2", [(f"regexp_full_match(term, '{Pattern(c[:-2] + 'xx', 2).regex[5:-1]}')", _ALL, 1, o)])


_register(("small", "ring", "large", "hot"))


@query(f"WITH {_PART}, bad AS (SELECT DISTINCT doc_ref FROM postings WHERE term = 'large') SELECT DISTINCT doc_ref, CAST(0 AS DOUBLE) AS score FROM len WHERE doc_ref NOT IN (SELECT doc_ref FROM bad)")
def search_negated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_search(spark, sf_dir, "-large")


@query(f"WITH {_PART} SELECT DISTINCT doc_ref, CAST(0 AS DOUBLE) AS score FROM len")
def search_empty_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_search(spark, sf_dir, "")


@query(_search_sql(_PART, [("term = 'rid'", _ALL, 100, "optional"), ("starts_with(term, 'rid')", _ALL, 10, "optional"), ("damerau_levenshtein(term, 'rid') <= 1", _ALL, 1, "optional")]))
def search_typeahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    def ask(q: Query) -> None:
        q.add_term("rid", boost=100).add_term("rid", boost=10, use_pipeline=False, wildcard=Wildcard.TRAILING).add_term("rid", edit_distance=1)

    return _part_search(spark, sf_dir, ask)


@query(_search_sql(_PART, [("term = 'small'", ["p_name", "p_type"], 2, "required"), ("term = 'large'", ["p_type"], 1, "optional")]))
def search_programmatic(spark: SparkSession, sf_dir: str) -> DataFrame:
    def ask(q: Query) -> None:
        q.add_term("small", boost=2, presence=Presence.REQUIRED, fields=["p_name", "p_type"]).add_term("large", fields=["p_type"])

    return _part_search(spark, sf_dir, ask)


@query(f"WITH {_PART} SELECT doc_ref, term, field FROM postings WHERE starts_with(term, 's')")
def match_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search_many(part_index(spark, sf_dir).tables, {"": "s*"}, match_data=True)
    return found.select("doc_ref", F.explode("match_data").alias("term", "fields")).select("doc_ref", "term", F.explode(F.map_keys("fields")).alias("field"))


@query(
    f"""WITH r AS (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{_SEP}'), lambda x: x <> '') AS p FROM documents))
SELECT CAST(doc_id AS VARCHAR) AS doc_ref, string_agg(CAST(i - 1 AS VARCHAR), ',' ORDER BY i) AS places FROM r WHERE regexp_replace(p[i], '{_EDGE}', '', 'g') = 'thble' GROUP BY doc_id"""
)
def match_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = document_index(spark, sf_dir, metadata=["index"]).tables
    found = search_many(tables, {"": "thble"}, match_data=True)
    return found.select("doc_ref", F.concat_ws(",", F.element_at(F.element_at("match_data", "thble"), "text")["index"].cast("array<string>")).alias("places"))


@query(f"SELECT * FROM ({_search_sql(_DOCS, [(_is('thble'), ['text'], 1, 'optional')])}) ORDER BY score DESC, doc_ref LIMIT 20")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _scores(search_many(document_index(spark, sf_dir).tables, {"": "thble"}))
    return found.orderBy(F.desc("score"), "doc_ref").limit(20)


def _many_sql() -> str:
    parts = []
    for name, text in MANY.items():
        clauses = [(_is(t), _ALL, 1, "optional") for t in text.split()]
        parts.append(f"SELECT '{name}' AS query_id, * FROM ({_search_sql(_PART, clauses)})")
    return " UNION ALL ".join(parts)


MANY = {"a": "small ring", "b": "gear", "c": "red nowhereatall"}


@query(_many_sql())
def search_many_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search_many(part_index(spark, sf_dir).tables, MANY)
    return found.select("query_id", "doc_ref", F.round("score", 6).alias("score"))


@query(_search_sql(_STEMMED, [(f"regexp_full_match(term, '{Pattern(stem('ention'), 1).regex[5:-1]}')", ["text"], 1, "optional"), (_is(stem("thble")), ["text"], 1, "prohibited")]))
def search_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = Index(build_index(table(spark, sf_dir, "documents"), "doc_id", [FieldSpec("text")]))
    return _scores(search_many(index.tables, {"": "ention~1 -thble"}))


# -- sets and vectors -------------------------------------------------------


@query("SELECT c_custkey AS key FROM customer UNION SELECT o_custkey FROM orders")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KeySet.of(table(spark, sf_dir, "customer"), "c_custkey").union(KeySet.of(table(spark, sf_dir, "orders"), "o_custkey")).keys


@query("SELECT c_custkey AS key FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KeySet.of(table(spark, sf_dir, "customer"), "c_custkey").intersect(KeySet.of(table(spark, sf_dir, "orders"), "o_custkey")).keys


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def set_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KeySet.of(table(spark, sf_dir, "orders"), "o_custkey").contains(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def set_lacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KeySet.of(table(spark, sf_dir, "supplier"), "s_suppkey").lacks(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "c_name")


_PROBE = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"


def _with_probe(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    e = table(spark, sf_dir, "embeddings")
    first = e.agg(F.min_by("embedding", "vec_id").alias("probe")).scalar()
    return e, first


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS magnitude FROM embeddings")
def vector_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.magnitude(F.col("embedding")), 5).alias("magnitude"))


@query(f"SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST({_PROBE} AS DOUBLE[])), 5) AS dot FROM embeddings")
def vector_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, probe = _with_probe(spark, sf_dir)
    return e.select("vec_id", "embedding", probe.alias("probe")).select("vec_id", F.round(V.dot(F.col("embedding"), F.col("probe")), 5).alias("dot"))


@query(f"SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), p) / sqrt(list_dot_product(p, p)), 5) AS similarity FROM embeddings, (SELECT CAST({_PROBE} AS DOUBLE[]) AS p)")
def vector_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, probe = _with_probe(spark, sf_dir)
    return e.select("vec_id", "embedding", probe.alias("probe")).select("vec_id", F.round(V.similarity(F.col("probe"), F.col("embedding")), 5).alias("similarity"))


@query(f"WITH {_PART} SELECT field, doc_ref, count(tf) AS entries, round(coalesce(sum(weight), 0), 6) AS total FROM len LEFT JOIN postings USING (field, doc_ref) GROUP BY field, doc_ref")
def field_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = with_term_ids(part_index(spark, sf_dir).tables).field_vectors()
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x["value"])
    return vectors.select("field", "doc_ref", F.size("vector").cast("long").alias("entries"), F.round(total, 6).alias("total"))


@query("SELECT vec_id, CAST(2 * len(embedding) AS BIGINT) AS entries, CAST(len(embedding) * (len(embedding) - 1) / 2 AS DOUBLE) + round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings")
def vector_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.transform("embedding", lambda v, i: F.struct(i.alias("index"), v.cast("double").alias("value")))
    flat = table(spark, sf_dir, "embeddings").select("vec_id", V.flat(pairs).alias("flat"))
    even, odd = F.filter("flat", lambda _, i: i % 2 == 0), F.filter("flat", lambda _, i: i % 2 == 1)
    index, value = (F.aggregate(x, F.lit(0.0), lambda a, v: a + v) for x in (even, odd))
    return flat.select("vec_id", F.size("flat").cast("long").alias("entries"), (index + F.round(value, 4)).alias("total"))


@query("SELECT k, i, round(sum(v), 2) AS v FROM (SELECT l_orderkey AS k, l_linenumber AS i, CAST(l_quantity AS DOUBLE) AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber + 2, CAST(l_tax AS DOUBLE) FROM lineitem) GROUP BY k, i")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.collect_list(F.struct((F.col("l_linenumber") + n).alias("index"), F.col(c).cast("double").alias("value"))).alias(c) for n, c in ((0, "l_quantity"), (2, "l_tax")))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("l_quantity"), F.sum("l_tax").alias("l_tax"))
    rows = lines.groupBy(F.col("l_orderkey").alias("k")).agg(a, b)
    return rows.select("k", F.explode(V.upserted(F.col("l_quantity"), F.col("l_tax"))).alias("e")).select("k", F.col("e.index").alias("i"), F.round("e.value", 2).alias("v"))


_FIRST = " UNION ALL ".join(f"SELECT p_partkey AS o, {i} AS f, {f} AS text FROM part" for i, f in enumerate(_ALL))


@query(
    f"""WITH r AS (SELECT o, f, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT o, f, list_filter(regexp_split_to_array(lower(text), '{_SEP}'), lambda x: x <> '') AS p FROM ({_FIRST}))),
k AS (SELECT o * 1000 + f * 100 + i AS place, regexp_replace(p[i], '{_EDGE}', '', 'g') AS term FROM r)
SELECT term, CAST(row_number() OVER (ORDER BY min(place)) - 1 AS INTEGER) AS term_index FROM k WHERE term <> '' AND lower(term) NOT IN ({_STOPS}) GROUP BY term"""
)
def term_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_term_ids(part_index(spark, sf_dir, order=F.col("p_partkey")).tables).terms.select("term", "term_index")


# -- analysis of one's own --------------------------------------------------


def _token_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_ref", "token").agg(F.count("*").alias("n"))


@query(_SQL["stop_word_filter"])
def pipeline_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_counts(Pipeline.load(["trimmer", "stopWordFilter"]).run(document_tokens(spark, sf_dir, by_document=True)))


@query(f"WITH {_DOCS}, e AS (SELECT doc_ref, unnest([term, left(term, 2)]) AS token FROM t WHERE term <> '') SELECT doc_ref, token, count(*) AS n FROM e GROUP BY ALL")
def pipeline_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step that gives several tokens for one, put behind the trimmer."""
    short = expand("short", lambda c: F.array(c, F.left(c, F.lit(2))), lambda t: [t, t[:2]])
    return _token_counts(Pipeline(TRIMMER).after(TRIMMER, short).run(document_tokens(spark, sf_dir, by_document=True)))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_ref, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[.,]')) AS token FROM documents) WHERE token <> '' GROUP BY ALL")
def tokenize_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [FieldSpec("text")]
    texts = field_texts(documents(table(spark, sf_dir, "documents"), "doc_id", fields), fields)
    return _token_counts(tokenized(texts, separator="[.,]"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_ref, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS token FROM documents) GROUP BY ALL")
def tokenize_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [FieldSpec("text")]
    texts = field_texts(documents(table(spark, sf_dir, "documents"), "doc_id", fields), fields)
    return _token_counts(tokenized(texts, tokenizer=lambda c: F.regexp_extract_all(c, F.lit("[A-Z][a-z]+"), F.lit(0))))


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS doc_ref, regexp_replace(v, '{_EDGE}', '', 'g') AS term, CAST(count(*) AS INTEGER) AS tf FROM (SELECT p_partkey, unnest([p_type, p_brand, p_type]) AS v FROM part) GROUP BY ALL")
def array_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = FieldSpec("tags", value=F.array("p_type", "p_brand", "p_type"))
    index = build_index(table(spark, sf_dir, "part"), "p_partkey", [tags], pipeline=Pipeline(TRIMMER), search_pipeline=Pipeline())
    return index.postings.select("doc_ref", "term", "tf")


@query(f"WITH {_PART} SELECT doc_ref, term, tf FROM postings WHERE field = 'p_name'")
def nested_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.struct(F.struct("p_name").alias("inner")).alias("outer"))
    index = build_index(parts, "p_partkey", [FieldSpec("name", value=F.col("outer.inner.p_name"))], pipeline=Pipeline(*PLAIN), search_pipeline=Pipeline())
    return index.postings.select("doc_ref", "term", "tf")


@query("SELECT r_name AS name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL SELECT n_name FROM nation")
def set_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universal set: neutral where sets are intersected, absorbing where they are united."""
    region, nation = (table(spark, sf_dir, t) for t in ("region", "nation"))
    used = KeySet.of(nation, "n_regionkey")
    some = KeySet.complete().intersect(used).contains(region, "r_regionkey").select(F.col("r_name").alias("name"))
    return some.unionByName(used.union(KeySet.complete()).contains(nation, "n_regionkey").select(F.col("n_name").alias("name")))


# -- storing ----------------------------------------------------------------


def _scratch(spark: SparkSession) -> str:
    """A folder of its own among those that driver and executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/lexweave-{uuid.uuid4().hex}"


@query(_SQL["bm25_weights_fields"])
def index_roundtrip_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = IndexStore(spark, _scratch(spark))
    store.save(part_index(spark, sf_dir).tables)
    return store.open().tables.postings.select("term", "field", "doc_ref", F.round("weight", 3).alias("weight"))


@query(_SQL["bm25_weights_fields"])
def index_roundtrip_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    save_json_pieces(part_index(spark, sf_dir), path)
    return load_json_pieces(spark, path).tables.postings.select("term", "field", "doc_ref", F.round("weight", 3).alias("weight"))


@query(_SQL["bm25_weights_fields"])
def index_roundtrip_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    save_json_lines(part_index(spark, sf_dir).tables, path)
    return load_json_lines(spark, path).tables.postings.select("term", "field", "doc_ref", F.round("weight", 3).alias("weight"))


@query(_search_sql(_PART, [(_is("gizmo"), _ALL, 1, "optional"), ("starts_with(term, 's')", _ALL, 2, "optional"), (_is("large"), _ALL, 1, "prohibited")]))
def search_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = IndexStore(spark, _scratch(spark))
    store.save(part_index(spark, sf_dir).tables)
    return _scores(store.open().search("gizmo s*^2 -large"))


@query(_search_sql(_PART, [("term LIKE '%ed'", _ALL, 1, "optional"), (_is("gizmo"), _ALL, 1, "required")]))
def search_stored_ending(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = IndexStore(spark, _scratch(spark))
    store.save(part_index(spark, sf_dir).tables)
    return _scores(store.open().search("*ed +gizmo"))


@query(
    f"""WITH {_PART}, e AS (SELECT field, doc_ref, term, tf, weight FROM postings WHERE NOT (field = 'p_name' AND doc_ref = '7') AND term <> 'gizmo'
UNION ALL VALUES ('p_name', '7', 'quite', 2, 0.5), ('p_name', '7', 'new', 1, 0.25), ('p_type', '9', 'gizmo', 3, 0.75))
SELECT field, doc_ref, count(*) AS entries, CAST(sum(tf) AS BIGINT) AS tokens, round(sum(weight), 3) AS total FROM e GROUP BY ALL"""
)
def store_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = IndexStore(spark, _scratch(spark))
    store.save(part_index(spark, sf_dir).tables)
    store.put_vector("p_name", "7", spark.createDataFrame([("quite", 2, 0.5), ("new", 1, 0.25)], "term string, tf int, weight double"))
    store.put_entry("gizmo", spark.createDataFrame([("p_type", "9", 3, 0.75)], "field string, doc_ref string, tf int, weight double"))
    kept = store.table("vectors").groupBy("field", "doc_ref").agg(F.count("*").alias("entries"), F.sum("tf").alias("tokens"), F.round(F.sum("weight"), 3).alias("total"))
    return kept


@query("SELECT field FROM (VALUES ('p_name'), ('p_brand'), ('extra')) v(field)")
def store_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = IndexStore(spark, _scratch(spark))
    store.save(part_index(spark, sf_dir).tables)
    store.add_field("extra")
    store.remove_field("p_type")
    return store.table("field_stats").select("field")


@query(f"WITH {_PART} SELECT term, field, doc_ref, round(weight, 3) AS weight FROM postings WHERE term = 'gizmo'")
def store_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = IndexStore(spark, _scratch(spark))
    store.save(part_index(spark, sf_dir).tables)
    return store.entry("gizmo").select("term", "field", "doc_ref", F.round("weight", 3).alias("weight"))


@query(f"WITH {_PART} SELECT term FROM terms WHERE starts_with(term, 's')")
def store_vocabulary_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = IndexStore(spark, _scratch(spark))
    store.save(part_index(spark, sf_dir).tables)
    return store.vocabulary("s")


def queries() -> dict[str, Make]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
