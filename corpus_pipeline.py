"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet into the folder executors share and read again as the next one's
input; a stage's folder is deleted when the next one is written, the last one's stays for its reader. All but the last return the columns of ``documents`` for the documents
they keep: those with a clear language, then those drawn by the quality
classifier, then one of each group of near duplicates. The last returns the
sequences the remaining documents are packed into.

An empty table passes through every stage and gives no sequences; rows with a
null or wordless text go at the first stage; columns that documents has besides
doc_id, text, lang, source and n_chars are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm import common
from lexweave.llm.langid import keep_identified
from lexweave.llm.ngram_join import keep_first
from lexweave.llm.packing import pack_documents
from lexweave.llm.quality import keep_selected

STAGES = [
    ("language_id", keep_identified),
    ("quality", keep_selected),
    ("near_duplicates", keep_first),
    ("packing", pack_documents),
]

#: Models that are learnt and a greedy packing aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = common.table(spark, sf_dir, "documents")
    base = f"{common.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            common.delete(spark, before)
        before = f"{base}/{name}"
    return docs
