"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import ann, bpe, exactdup, hmm, mixing, pii, quality, simhash, spelling, suffix, topk, toxicity, whitening
from .common import table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix": lambda s, d: suffix.repeat_digests(_documents(s, d)),
        "op2_byte_bpe": lambda s, d: bpe.token_digests(bpe.public_bpe(s), _documents(s, d)),
        "op3_pii": lambda s, d: pii.pii_digests(_documents(s, d)),
        "op4_mixing": lambda s, d: mixing.mix_report(_documents(s, d)),
        "op5_toxicity": lambda s, d: toxicity.toxicity_scores(_documents(s, d), _labels(s, d)),
        "op6_topk": lambda s, d: topk.top_k(table(s, d, "embeddings")),
        "op7_ann": lambda s, d: ann.nearest(table(s, d, "embeddings")),
        "op8_simhash": lambda s, d: simhash.simhash_components(_documents(s, d)),
        "op9_quality": lambda s, d: quality.quality_scores(_documents(s, d), _labels(s, d)),
        "op10_hmm": lambda s, d: hmm.language_scores(_documents(s, d)),
        "op11_whitening": lambda s, d: whitening.whiten(table(s, d, "embeddings")),
        "op12_exact_dedup": lambda s, d: exactdup.exact_duplicates(_documents(s, d)),
        "op13_spelling": lambda s, d: spelling.variant_groups(_documents(s, d)),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": mixing.ORACLE, "op6_topk": topk.ORACLE, "op12_exact_dedup": exactdup.ORACLE, "op13_spelling": spelling.ORACLE} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
