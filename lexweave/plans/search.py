"""Search: queries compile to one DataFrame plan over an index's tables.

1. Clauses become patterns ("units"); exact terms are a join with the
   vocabulary's term column, all others predicates of one vocabulary scan.
   Where every pattern is exact or has a prefix, both scans, of the vocabulary and of the postings,
   are filtered by these. Else, if the tables are stored, the vocabulary is
   looked into first, and up to MOST_TERMS terms found there take its place and filter the postings.
2. The expanded terms, in every field of their clause, make the query vectors
   and their norms, also where no document has them.
3. Postings join them once on (term, field). One aggregation by document gives
   the score, which required clauses were met (bits of a mask), and whether a
   prohibited one was.
4. Ordering is by score, then reference.

Several queries run in the same plan, told apart by query_id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.patterns import Pattern
from lexweave.operators.index import IndexTables, literal_rows
from lexweave.plans.query import Presence, Query, build, parse

BITS = 62
MOST_TERMS = 2000


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _pushed(patterns: Sequence[Pattern]) -> Column | None:
    """A filter on term that loses no match of the patterns; None if some pattern begins with anything."""
    term = F.col("term")
    exact = sorted({p.text for p in patterns if p.exact})
    begun = [p.pushed(term) for p in patterns if not p.exact]
    if any(c is None for c in begun):
        return None
    return _any([*([term.isin(exact)] if exact else []), *begun]) if exact or begun else F.lit(False)


def _matches(vocabulary: DataFrame, exact: Sequence[tuple[int, Pattern]], other: Sequence[tuple[int, Pattern]]) -> DataFrame:
    """(term, unit) of every term that a pattern matches."""
    found = vocabulary.join(F.broadcast(literal_rows(vocabulary.sparkSession, [(u, p.text) for u, p in exact], "unit int, term string")), "term").select("term", "unit")
    if other:
        hits = F.array(*(F.when(p.column(F.col("term")), F.lit(u)) for u, p in other))
        found = found.unionByName(vocabulary.select("term", F.explode(F.array_compact(hits)).alias("unit")))
    return found


def _expanded(tables: IndexTables, queries: Mapping[str, Query]) -> tuple[DataFrame, dict[str, int], int, Column | None]:
    """(query_id, term, field, boost, mask0.., prohibited, wanted) summed over units; required clauses by query; number of masks; a filter on term for the postings."""
    spark = tables.terms.sparkSession
    exact, other, scopes, required = [], [], [], Counter()
    for q, query in queries.items():
        for clause in query.clauses:
            bit = required[q] if clause.presence is Presence.REQUIRED else -1
            required[q] += clause.presence is Presence.REQUIRED
            for pattern in clause.patterns(tables.search_pipeline):
                unit = len(exact) + len(other)
                (exact if pattern.exact else other).append((unit, pattern))
                prohibited = clause.presence is Presence.PROHIBITED
                for name, times in Counter(clause.fields).items():
                    scopes.append((q, unit, name, 0.0 if prohibited else clause.boost * times, bit, prohibited))
    masks = max(1, -(-max(required.values(), default=0) // BITS))
    patterns = [p for _, p in exact + other]
    vocabulary, pushed = tables.vocabulary(), _pushed(patterns)
    found = _matches(vocabulary if pushed is None else vocabulary.where(pushed), exact, other)
    if pushed is None and tables.stored:
        hits = found.limit(MOST_TERMS + 1).collect()
        if len(hits) <= MOST_TERMS:
            found = literal_rows(spark, [tuple(h) for h in hits], "term string, unit int")
            pushed = F.col("term").isin(sorted({h["term"] for h in hits})) if hits else F.lit(False)
    elif pushed is None and all(p.exact or p.regex for p in patterns):
        pushed = _any([p.column(F.col("term")) for p in patterns])
    scope = literal_rows(spark, scopes, "query_id string, unit int, field string, boost double, bit int, prohibited boolean")
    bits = [F.bit_or(F.when((F.col("bit") >= m * BITS) & (F.col("bit") < (m + 1) * BITS), F.expr(f"shiftleft(1L, bit - {m * BITS})")).otherwise(F.lit(0).cast("long"))).alias(f"mask{m}") for m in range(masks)]
    summed = found.join(F.broadcast(scope), "unit").groupBy("query_id", "field", "term").agg(
        F.sum("boost").alias("boost"), *bits, F.max("prohibited").alias("prohibited"), F.max(~F.col("prohibited")).alias("wanted")
    )
    return summed, {q: required[q] for q in queries}, masks, pushed


def search_many(tables: IndexTables, queries: Mapping[str, str | Query | Callable[[Query], object]], match_data: bool = False) -> DataFrame:
    """query_id, doc_ref, score and, if asked for, match_data of every query's results, unordered."""
    spark = tables.terms.sparkSession
    parsed = {q: x if isinstance(x, Query) else parse(x, tables.fields) if isinstance(x, str) else build(tables.fields, x) for q, x in queries.items()}
    for query in parsed.values():
        if unknown := [f for c in query.clauses for f in c.fields if f not in tables.fields]:
            raise ValueError(f"the index has no field {unknown[0]!r}")
    expanded, required, masks, pushed = _expanded(tables, parsed)
    names = [f"mask{m}" for m in range(masks)]
    norms = expanded.where("wanted").groupBy("query_id", "field").agg(F.sqrt(F.sum(F.col("boost") * F.col("boost"))).alias("norm"))
    vectors = expanded.join(F.broadcast(norms), ["query_id", "field"], "left").select("query_id", "field", "term", F.when(F.col("norm") > 0, F.col("boost") / F.col("norm")).otherwise(F.lit(0.0)).alias("q"), *names, "prohibited", "wanted")
    postings = tables.postings if pushed is None else tables.postings_where(pushed)
    rows = postings.join(vectors, ["term", "field"])
    measures = [F.sum(F.col("weight") * F.col("q")).alias("score"), *(F.bit_or(n).alias(n) for n in names), F.max("prohibited").alias("prohibited"), F.max("wanted").alias("wanted")]
    if match_data:
        measures.append(F.collect_list(F.when(F.col("wanted"), F.struct("term", "field", "metadata"))).alias("found"))
    by_doc = rows.groupBy("query_id", "doc_ref").agg(*measures)
    needs = literal_rows(spark, [(q, bool(parsed[q].is_negated), *(((1 << max(0, min(BITS, n - m * BITS))) - 1) for m in range(masks))) for q, n in required.items()], ", ".join(["query_id string, negated boolean", *(f"need{m} long" for m in range(masks))]))
    met = by_doc.join(F.broadcast(needs), "query_id")
    ok = F.col("wanted") & ~F.col("prohibited")
    for m in range(masks):
        ok = ok & (F.col(f"mask{m}") == F.col(f"need{m}"))
    out = met.where(ok & ~F.col("negated")).select("query_id", "doc_ref", "score", *([_match_data().alias("match_data")] if match_data else []))
    negated = [q for q, x in parsed.items() if x.is_negated]
    if negated:
        every = tables.field_lengths.select("doc_ref").distinct().select("doc_ref", F.explode(F.array(*map(F.lit, negated))).alias("query_id"))
        left = every.join(by_doc.where("prohibited").select("query_id", "doc_ref"), ["query_id", "doc_ref"], "left_anti").select("query_id", "doc_ref", F.lit(0.0).alias("score"))
        if match_data:
            left = left.withColumn("match_data", F.lit(None).cast(out.schema["match_data"].dataType))
        out = out.unionByName(left)
    return out


def _match_data():
    """Map of term to map of field to metadata. A map column can't hold doubles of a key: (term, field) is unique in a document."""
    terms = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["term"])))
    fields = F.transform(terms, lambda t: F.map_from_entries(F.transform(F.filter("found", lambda x: x["term"] == t), lambda x: F.struct(x["field"], x["metadata"]))))
    return F.map_from_arrays(terms, fields)


def search(tables: IndexTables, query: str | Query | Callable[[Query], object], match_data: bool = False, limit: int | None = None) -> DataFrame:
    """doc_ref, score and, if asked for, match_data, best first."""
    found = search_many(tables, {"": query}, match_data).drop("query_id").orderBy(F.desc("score"), "doc_ref")
    return found.limit(limit) if limit is not None else found


class Index:
    """An index to search; its tables are DataFrames."""

    def __init__(self, tables: IndexTables):
        self.tables = tables

    @property
    def fields(self) -> list[str]:
        return self.tables.fields

    @property
    def spark(self) -> SparkSession:
        return self.tables.terms.sparkSession

    def cache(self) -> Index:
        self.tables.cache()
        return self

    def search(self, text: str, match_data: bool = False, limit: int | None = None) -> DataFrame:
        return search(self.tables, text, match_data, limit)

    def query(self, make: Callable[[Query], object], match_data: bool = False, limit: int | None = None) -> DataFrame:
        return search(self.tables, make, match_data, limit)

    def search_many(self, queries: Mapping[str, str], match_data: bool = False) -> DataFrame:
        return search_many(self.tables, queries, match_data)

    @contextmanager
    def cancellable(self, tag: str) -> Iterator[Index]:
        """Searches that run in this thread while the context is open end with an error once ``cancel`` is called with the tag, from any thread."""
        context = self.spark.sparkContext
        context.addJobTag(tag)
        try:
            yield self
        finally:
            context.removeJobTag(tag)

    def cancel(self, tag: str) -> None:
        self.spark.sparkContext.cancelJobsWithTag(tag)
