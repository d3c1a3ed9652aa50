"""Building an index: a bundle of DataFrames.

docs(doc_ref, doc_order, boost)
field_lengths(doc_ref, field, length): tokens after the pipeline, 0 kept
field_stats(field, ordinal, boost, avg_length)
terms(term, df, idf, term_index)
postings(term, field, doc_ref, tf, weight, metadata): a posting is also an
    entry of its document's field vector, so scoring needs no further join

Texts are shuffled once, by document and field, before they are cut into tokens: term
frequencies, lengths and boosts need no other shuffle. Python workers, as for stemming, make Spark
forget a partitioning, so behind them it is the tokens that are shuffled. The term statistics and
the join of the postings with them go by term. Field statistics have a row a
field and are broadcast. All tables come from the counted terms; ``cache``
and stores keep these while they are read (``holding``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.functions import text as X
from lexweave.operators.pipeline import Pipeline, indexing, searching

Tokenizer = Callable[[Column], Column]


@dataclass(frozen=True)
class FieldSpec:
    """A field of the index: its value (default: the column of its name, nested ones too) and its boost."""

    name: str
    boost: float = 1.0
    value: Column | None = None

    def __post_init__(self):
        if not self.name or "/" in self.name:
            raise ValueError(f"{self.name!r} can't name a field: it is empty or has a /")


def fields_of(fields: Iterable[FieldSpec | str]) -> list[FieldSpec]:
    found = [f if isinstance(f, FieldSpec) else FieldSpec(f) for f in fields]
    if len({f.name for f in found}) < len(found):
        raise ValueError("a field is declared twice")
    return found


def field_ref(name: str, doc_ref: str) -> str:
    return f"{name}/{doc_ref}"


def parse_field_ref(ref: str) -> tuple[str, str]:
    """A document's reference can have a / itself: the first one counts."""
    name, slash, doc = ref.partition("/")
    if not slash:
        raise ValueError(f"{ref!r} is no field reference")
    return name, doc


@dataclass
class IndexTables:
    """What search needs, from wherever it comes."""

    docs: DataFrame
    field_lengths: DataFrame
    field_stats: DataFrame
    terms: DataFrame
    postings: DataFrame
    fields: list[str]
    search_pipeline: Pipeline = field(default_factory=searching)
    #: What the tables are computed from, if they are.
    counted: DataFrame | None = None
    #: Whether the tables are read from files, so that looking into the vocabulary beforehand is cheap.
    stored: bool = False
    #: The postings that a filter on term lets through, by way of the tokens alone; for tables that are neither stored nor cached.
    matching: Callable[[Column], DataFrame] | None = None

    def postings_where(self, condition: Column) -> DataFrame:
        computed = self.matching is not None and StorageLevel.NONE == self.postings.storageLevel == self.counted.storageLevel
        return self.matching(condition) if computed else self.postings.where(condition)

    @contextmanager
    def holding(self) -> Iterator[IndexTables]:
        """Counted terms are computed once while several tables are written."""
        held = self.counted is not None and self.counted.storageLevel == StorageLevel.NONE
        if held:
            self.counted.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield self
        finally:
            if held:
                self.counted.unpersist()

    def cache(self) -> IndexTables:
        if self.counted is not None:
            self.counted.persist(StorageLevel.MEMORY_AND_DISK)
        for t in (self.docs, self.field_lengths, self.field_stats, self.terms, self.postings):
            t.cache()
        return self

    def unpersist(self) -> None:
        if self.counted is not None:
            self.counted.unpersist()
        for t in (self.docs, self.field_lengths, self.field_stats, self.terms, self.postings):
            t.unpersist()

    def vocabulary(self) -> DataFrame:
        return self.terms.select("term")

    def field_vectors(self) -> DataFrame:
        """(field, doc_ref, vector): every (field, document), with the (index, value) pairs of its terms in order."""
        pairs = self.postings.join(self.terms.select("term", "term_index"), "term").groupBy("field", "doc_ref").agg(F.sort_array(F.collect_list(F.struct(F.col("term_index").alias("index"), F.col("weight").alias("value")))).alias("vector"))
        empty = F.array().cast("array<struct<index:int,value:double>>")
        return self.field_lengths.select("field", "doc_ref").join(pairs, ["field", "doc_ref"], "left").withColumn("vector", F.coalesce("vector", empty))


def documents(df: DataFrame, ref: str, fields: Sequence[FieldSpec], boost: Column | None = None, order: Column | None = None) -> DataFrame:
    """doc_ref, doc_order, boost, one text column a field (f0, f1, ...), and the tokens (t0, t1, ...) of fields that are arrays, whose text is empty."""
    values = []
    for i, f in enumerate(fields):
        value = f.value if f.value is not None else F.col(f.name)
        kind = df.select(value.alias("v")).schema[0].dataType
        if isinstance(kind, T.ArrayType):
            values += [F.when(value.isNotNull(), F.lit("")).alias(f"f{i}"), X.array_tokens(value).alias(f"t{i}")]
        else:
            values.append(X.as_text(value, kind).alias(f"f{i}"))
    return df.select(F.col(ref).cast("string").alias("doc_ref"), (order if order is not None else F.monotonically_increasing_id()).alias("doc_order"), (F.lit(1.0) if boost is None else F.coalesce(boost.cast("double"), F.lit(1.0))).alias("boost"), *values)


def field_texts(docs: DataFrame, fields: Sequence[FieldSpec]) -> DataFrame:
    """A row for each (document, field) that has a value; with array fields, items are their tokens."""
    arrays = any(c.startswith("t") for c in docs.columns)
    items = [F.col(f"t{i}") if f"t{i}" in docs.columns else F.lit(None).cast("array<string>") for i in range(len(fields))]
    each = F.array(*(F.struct(F.lit(f.name).alias("field"), F.lit(i).alias("ordinal"), F.col(f"f{i}").alias("text"), *([items[i].alias("items")] if arrays else [])) for i, f in enumerate(fields)))
    return docs.select("doc_ref", "doc_order", "boost", F.explode(each).alias("x")).select("doc_ref", "doc_order", "boost", "x.*").where("text IS NOT NULL")


def tokenized(texts: DataFrame, separator: str = X.SEPARATOR, tokenizer: Tokenizer | None = None, places: bool = False) -> DataFrame:
    """A row for each token: token, token_index, start and length (null unless ``places``).

    ``tokenizer`` takes the text column and gives an array of tokens or of (token, start, length).
    """
    if tokenizer is None:
        tokenizer = X.placed_tokens(separator) if places else lambda c: X.tokens(c, separator)
    keys = [c for c in texts.columns if c not in ("text", "items")]
    found = tokenizer(F.col("text"))
    if "items" in texts.columns:
        placed = isinstance(texts.select(found.alias("t")).schema["t"].dataType.elementType, T.StructType)
        none = F.lit(None).cast("int")
        items = F.transform("items", lambda t: F.struct(t.alias("token"), none.alias("start"), none.alias("length"))) if placed else F.col("items")
        found = F.when(F.col("items").isNotNull(), items).otherwise(found)
    out = texts.select(*keys, F.posexplode(found).alias("token_index", "token"))
    if isinstance(out.schema["token"].dataType, T.StructType):
        return out.select(*keys, "token_index", F.col("token.token").alias("token"), F.col("token.start").alias("start"), F.col("token.length").alias("length"))
    return out.select(*keys, "token_index", "token", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length"))


def _metadata(keys: Sequence[str], extra: Sequence[str]) -> list[Column]:
    """Lists in token order of the allowed metadata."""
    sources = {"position": lambda: F.struct("start", "length"), "index": lambda: F.col("token_index"), "fieldName": lambda: F.col("field")}
    out = []
    for k in keys:
        if k not in sources and k not in extra:
            continue
        value = sources[k]() if k in sources else F.col(k)
        listed = F.sort_array(F.collect_list(F.struct(F.col("token_index").alias("i"), value.alias("v"))))
        out.append(F.transform(listed, lambda x: x["v"]).alias(k))
    return out


def idf(df: Column, n: Column) -> Column:
    return F.log(F.lit(1.0) + F.abs((n - df + 0.5) / (df + 0.5)))


def bm25(tf: Column, idf_: Column, length: Column, average: Column, boost: Column, k1: float, b: float) -> Column:
    """The weight of a term, rounded half-even to three digits."""
    score = idf_ * ((k1 + 1) * tf) / (k1 * (1 - b + b * (length / average)) + tf) * boost
    return F.rint(score * 1000) / 1000


def build_index(
    df: DataFrame,
    ref: str,
    fields: Iterable[FieldSpec | str],
    *,
    b: float = 0.75,
    k1: float = 1.2,
    boost: Column | None = None,
    order: Column | None = None,
    pipeline: Pipeline | None = None,
    search_pipeline: Pipeline | None = None,
    separator: str = X.SEPARATOR,
    tokenizer: Tokenizer | None = None,
    metadata: Sequence[str] = (),
    check_refs: bool = False,
) -> IndexTables:
    """Index a DataFrame of documents.

    ``boost``: a document's boost; ``order``: its place, for term ids (only exports need them);
    ``metadata``: what postings keep of their tokens (position, index, fieldName, columns that steps add).
    A null field value is no field; a declared field without any value has a null average.
    References must be unique: ``check_refs`` raises ValueError if they aren't (one more pass).
    """
    specs = fields_of(fields)
    b = max(0.0, min(1.0, b))
    docs = documents(df, ref, specs, boost, order)
    if check_refs and (twice := docs.groupBy("doc_ref").count().where("count > 1").take(1)):
        raise ValueError(f"the reference {twice[0]['doc_ref']!r} isn't unique")
    texts = field_texts(docs, specs)
    steps = pipeline or indexing()
    dealt = texts if steps.python else texts.repartition("doc_ref", "field")
    tokens = tokenized(dealt, separator, tokenizer, "position" in metadata)
    before = set(tokens.columns)
    tokens = steps.run(tokens)
    extra = [c for c in tokens.columns if c not in before]
    kept = _metadata(metadata, extra)
    seen = F.min(F.struct("doc_order", "ordinal", "token_index")).alias("first_seen")
    counts = (tokens.repartition("doc_ref", "field") if steps.python else tokens).groupBy("doc_ref", "field", F.col("token").alias("term")).agg(F.count("*").cast("int").alias("tf"), seen, F.first("boost").alias("doc_boost"), *kept)
    counted = counts.withColumn("length", F.sum("tf").over(Window.partitionBy("doc_ref", "field")))
    declared = _rows(df, [(f.name, i, float(f.boost)) for i, f in enumerate(specs)], "field string, ordinal int, boost double")
    n = docs.agg(F.countDistinct("doc_ref").cast("double").alias("n")).scalar()
    named = F.struct(*(F.col(c) for c in metadata if c in [*("position", "index", "fieldName"), *extra])) if kept else F.lit(None).cast("string")
    weight = bm25(F.col("tf"), F.col("idf"), F.col("length"), F.col("avg_length"), F.col("boost") * F.col("doc_boost"), k1, b)

    def every_length(found: DataFrame) -> DataFrame:
        return texts.select("doc_ref", "field").join(found, ["doc_ref", "field"], "left").withColumn("length", F.coalesce("length", F.lit(0)).cast("long"))

    def averages(lengths: DataFrame) -> DataFrame:
        return declared.join(lengths.groupBy("field").agg(F.avg("length").alias("avg_length")), "field", "left").select("field", "ordinal", "boost", "avg_length")

    def weighed(rows: DataFrame, stats: DataFrame, terms: DataFrame) -> DataFrame:
        joined = rows.join(F.broadcast(stats), "field").join(terms.select("term", "idf"), "term")
        return joined.select("term", "field", "doc_ref", "tf", weight.alias("weight"), named.alias("metadata"))

    def matching(condition: Column) -> DataFrame:
        """Lengths are counts of tokens, so only matching terms are told apart; the average and the postings read the same shuffle."""
        found = tokens.groupBy("doc_ref", "field").agg(F.count("*").alias("length")).repartition("doc_ref", "field")
        rows = counts.where(condition).join(found.hint("shuffle_hash"), ["doc_ref", "field"])
        return weighed(rows, averages(every_length(found)), terms.where(condition))

    lengths = every_length(counted.groupBy("doc_ref", "field").agg(F.sum("tf").alias("length")))
    stats = averages(lengths)
    terms = counted.groupBy("term").agg(F.count("*").alias("df"), F.min("first_seen").alias("first_seen")).select("term", "df", idf(F.col("df"), n).alias("idf"), "first_seen")
    postings = weighed(counted, stats, terms)
    return IndexTables(docs.select("doc_ref", "doc_order", "boost"), lengths, stats, terms, postings, [f.name for f in specs], search_pipeline or searching(), counted, matching=matching)


def with_term_ids(tables: IndexTables) -> IndexTables:
    """Dense term ids by first appearance. A total order has no other plan than one task over the vocabulary, so only exports ask for it."""
    ranked = tables.terms.withColumn("term_index", (F.row_number().over(Window.orderBy("first_seen")) - 1).cast("int"))
    return replace(tables, terms=ranked)


def _rows(df: DataFrame, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few literal rows, made on the JVM side."""
    return literal_rows(df.sparkSession, rows, schema)


def literal_rows(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    kinds = T._parse_datatype_string(schema)
    if not rows:
        return spark.createDataFrame([], schema)
    each = F.array(*(F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, kinds.fields, strict=True))) for r in rows))
    return spark.range(1).select(F.explode(each).alias("r")).select("r.*")
