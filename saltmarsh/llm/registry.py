"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, langid, media, mixing, secrets, sharding, simhash, tokens, topk, toxicity


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_simhash": simhash.op2_simhash,
        "op3_sharding": sharding.op3_sharding,
        "op4_token_counts": tokens.op4_token_counts,
        "op5_bpe": bpe.op5_bpe,
        "op6_language_id": langid.op6_language_id,
        "op7_topk": topk.op7_topk,
        "op8_secrets": secrets.op8_secrets,
        "op9_mixing": mixing.op9_mixing,
        "op10_media": media.op10_media,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_sharding": sharding.SQL, "op7_topk": topk.SQL, "op9_mixing": mixing.SQL}
