"""Documents that arrive as a stream.

Term and length statistics are global, so an index is immutable once built; a
stream therefore feeds a table of documents, micro-batch by micro-batch, and
the index is built over it when asked for. Batches are written under their
number, so one that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexweave.operators.index import build_index
from lexweave.plans.search import Index


class DocumentStream:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def start(self, documents: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

        return documents.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def documents(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("batch")

    def index(self, ref: str, fields, **options) -> Index:
        return Index(build_index(self.documents(), ref, fields, **options))
