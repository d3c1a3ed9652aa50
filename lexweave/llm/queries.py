"""The registered queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chroma, fingerprints, langid, licenses, ngram_join, packing, pieces, quality, toxicity, warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        licenses.op1_licenses,
        ngram_join.op2_near_duplicates,
        packing.op3_packing,
        langid.op4_language_id,
        warc.op5_warc,
        chroma.op6_chroma,
        chroma.op6_chroma_members,
        chroma.op6_chroma_best,
        toxicity.op7_toxicity,
        fingerprints.op8_fingerprint,
        pieces.op9_sentencepiece,
        quality.op10_quality,
        pipeline,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": licenses.OP1_SQL, "op2_near_duplicates": ngram_join.OP2_SQL}
