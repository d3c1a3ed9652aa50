"""An index as a bundle of Parquet tables.

A bundle is a folder with one folder a table and in it one a version. A change
writes new versions of the tables it touches and then, as its last step, a new
version of ``meta``, which names the version of every table. So a change of
several tables takes effect at once or not at all: readers see the newest
complete ``meta`` and the tables it names, and a failed write leaves the bundle as it
was. ``vacuum`` deletes versions that the newest ``meta`` doesn't name.

Terms and postings are ordered by term, so exact terms and prefixes read few row
groups; ``vectors`` is a copy of the postings ordered by (field, doc_ref).
A change of single entries rewrites the tables it touches: it is meant for
corrections; many changes belong into one build.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators.index import IndexTables, idf, literal_rows
from lexweave.operators.pipeline import Pipeline, Registry
from lexweave.plans.search import Index

FORMAT = 2
TABLES = ("docs", "field_lengths", "field_stats", "terms", "postings")
VECTOR = ["field", "doc_ref", "term", "tf", "weight"]
ORDER = {"docs": ["doc_ref"], "field_lengths": ["field", "doc_ref"], "field_stats": ["ordinal"], "terms": ["term"], "postings": ["term", "field", "doc_ref"], "vectors": ["field", "doc_ref", "term"]}
RANGED = ("terms", "postings", "field_lengths", "vectors")


class IndexStore:
    """Reads and changes a bundle at ``path``."""

    def __init__(self, spark: SparkSession, path: str, registry: Registry | None = None):
        self.spark, self.path, self.registry = spark, path.rstrip("/"), registry

    # -- versions ---------------------------------------------------------

    def _folder(self, name: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self, table: str, complete: bool = True) -> list[int]:
        folder, fs = self._folder(table)
        if not fs.exists(folder):
            return []
        made = [str(s.getPath().getName()) for s in fs.listStatus(folder)]
        return sorted(int(v[1:]) for v in made if v[:1] == "v" and (not complete or fs.exists(self._folder(f"{table}/{v}/_SUCCESS")[0])))

    def _write(self, table: str, df: DataFrame) -> int:
        version = max(self._versions(table, complete=False), default=0) + 1
        order = [c for c in ORDER.get(table, []) if c in df.columns]
        if order and table in RANGED:
            df = df.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
        df.write.parquet(f"{self.path}/{table}/v{version}")
        return version

    def _meta(self) -> dict:
        versions = self._versions("meta")
        if not versions:
            raise FileNotFoundError(f"{self.path} has no index")
        meta = json.loads(self.spark.read.parquet(f"{self.path}/meta/v{versions[-1]}").first()["json"])
        if meta["format"] != FORMAT:
            raise ValueError(f"{self.path} has format {meta['format']}; this version reads format {FORMAT}")
        return meta

    def _publish(self, changes: dict[str, DataFrame], meta: dict | None = None) -> None:
        meta = meta or self._meta()
        versions = meta["versions"] | {name: self._write(name, df) for name, df in changes.items()}
        self._write("meta", literal_rows(self.spark, [(json.dumps(meta | {"versions": versions}),)], "json string"))

    def table(self, name: str) -> DataFrame:
        return self._reader()(name)

    def _reader(self) -> Callable[[str], DataFrame]:
        """Reads tables of one and the same state."""
        versions = self._meta()["versions"]
        return lambda name: self.spark.read.parquet(f"{self.path}/{name}/v{versions[name]}")

    def vacuum(self) -> int:
        """Delete what the newest state doesn't name; readers of older states fail from then on. The number of versions deleted."""
        versions = self._meta()["versions"] | {"meta": self._versions("meta")[-1]}
        gone = [f"{name}/v{v}" for name, kept in versions.items() for v in self._versions(name, complete=False) if v < kept]
        for name in gone:
            folder, fs = self._folder(name)
            fs.delete(folder, True)
        return len(gone)

    # -- whole indexes ----------------------------------------------------

    def save(self, tables: IndexTables) -> None:
        with tables.holding():
            changes = {name: getattr(tables, name) for name in TABLES}
            changes["vectors"] = tables.postings.select(*VECTOR)
            self._publish(changes, {"format": FORMAT, "pipeline": tables.search_pipeline.save(), "versions": {}})

    def open(self) -> Index:
        meta, read = self._meta(), self._reader()
        pipeline = Pipeline.load(meta["pipeline"], self.registry)
        return Index(IndexTables(*(read(t) for t in TABLES), fields=self.fields(), search_pipeline=pipeline, stored=True))

    # -- single entries ---------------------------------------------------

    def fields(self) -> list[str]:
        return [r["field"] for r in self.table("field_stats").orderBy("ordinal").collect()]

    def add_field(self, name: str, boost: float = 1.0) -> None:
        old = self.table("field_stats")
        if name not in self.fields():
            last = old.agg(F.max("ordinal")).first()[0]
            new = literal_rows(self.spark, [(name, 0 if last is None else last + 1, boost, None)], "field string, ordinal int, boost double, avg_length double")
            self._publish({"field_stats": old.unionByName(new).coalesce(1)})

    def remove_field(self, name: str) -> bool:
        found = name in self.fields()
        if found:
            self._publish({"field_stats": self.table("field_stats").where(F.col("field") != name)})
        return found

    def vector_keys(self, field: str | None = None) -> DataFrame:
        keys = self.table("field_lengths").select("field", "doc_ref")
        return keys if field is None else keys.where(F.col("field") == field)

    def vector(self, field: str, doc_ref: str) -> DataFrame:
        return self.table("vectors").where((F.col("field") == field) & (F.col("doc_ref") == doc_ref)).select("term", "tf", "weight")

    def put_vector(self, field: str, doc_ref: str, entries: DataFrame) -> None:
        """``entries``: term, tf, weight. Replaces the vector of (field, doc_ref); terms that are new join the vocabulary."""
        own = (F.col("field") == field) & (F.col("doc_ref") == doc_ref)
        read = self._reader()
        new = entries.select("term", F.lit(field).alias("field"), F.lit(doc_ref).alias("doc_ref"), F.col("tf").cast("int"), F.col("weight").cast("double"))
        length = new.groupBy("field", "doc_ref").agg(F.sum("tf").alias("length"))
        terms = read("terms")
        rows = self._terms(read, new.join(terms.select("term"), "term", "left_anti"))
        self._publish(
            {
                "postings": read("postings").where(~own).unionByName(new, allowMissingColumns=True),
                "vectors": read("vectors").where(~own).unionByName(new.select(*VECTOR)),
                "field_lengths": read("field_lengths").where(~own).unionByName(length),
                "terms": terms.unionByName(rows, allowMissingColumns=True),
            }
        )

    def remove_vector(self, field: str, doc_ref: str) -> bool:
        own = (F.col("field") == field) & (F.col("doc_ref") == doc_ref)
        read = self._reader()
        if not read("field_lengths").where(own).take(1):
            return False
        self._publish({name: read(name).where(~own) for name in ("postings", "vectors", "field_lengths")})
        return True

    def entry(self, term: str) -> DataFrame:
        """The postings of one term."""
        return self.table("postings").where(F.col("term") == term)

    def put_entry(self, term: str, postings: DataFrame, idf: float | None = None) -> None:
        """Replaces the postings of a term (field, doc_ref, tf, weight); the vocabulary gets the term as well, with ``idf`` or the one that follows from its postings."""
        read, other = self._reader(), F.col("term") != term
        new = postings.withColumn("term", F.lit(term))
        row = self._terms(read, new)
        if idf is not None:
            row = row.withColumn("idf", F.lit(float(idf)))
        self._publish(
            {
                "postings": read("postings").where(other).unionByName(new, allowMissingColumns=True),
                "vectors": read("vectors").where(other).unionByName(new.select(*VECTOR)),
                "terms": read("terms").where(other).unionByName(row, allowMissingColumns=True),
            }
        )

    @staticmethod
    def _terms(read: Callable[[str], DataFrame], postings: DataFrame) -> DataFrame:
        n = read("docs").agg(F.countDistinct("doc_ref").cast("double")).scalar()
        return postings.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", idf(F.col("df"), n))

    def vocabulary(self, prefix: str = "") -> DataFrame:
        words = self.table("terms").select("term")
        return words.where(F.col("term").startswith(prefix)) if prefix else words

    def scan(self, table: str, *conditions: Column) -> DataFrame:
        found = self.table(table)
        for c in conditions:
            found = found.where(c)
        return found


def save_index(index: Index, path: str) -> None:
    IndexStore(index.spark, path).save(index.tables)


def open_index(spark: SparkSession, path: str, registry: Registry | None = None) -> Index:
    return IndexStore(spark, path, registry).open()
