"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from arcweft.llm import chat, decontam, neardup, pieces, pii, quality, repeats, shards, topk, warc


ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers on this machine find the package whatever folder the driver runs in; elsewhere it comes by --py-files
    there = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in there.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, there]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_top_k": lambda s, d: topk.op1_exact_top_k(table(s, d, "embeddings")),
        "op2_benchmark_decontamination": lambda s, d: decontam.op2_benchmark_decontamination(table(s, d, "documents"), table(s, d, "benchmark")),
        "op3_quality_classifier": lambda s, d: quality.op3_quality_classifier(table(s, d, "documents"), table(s, d, "labels")),
        "op4_warc": lambda s, d: warc.op4_warc(table(s, d, "pages")),
        "op5_minhash_near_dedup": lambda s, d: neardup.op5_minhash_near_dedup(table(s, d, "documents")),
        "op10_pii": lambda s, d: pii.op10_pii(table(s, d, "documents")),
        "op6_sentencepiece": lambda s, d: pieces.op6_sentencepiece(table(s, d, "documents")),
        "op7_sharding": lambda s, d: shards.op7_sharding(table(s, d, "documents")),
        "op9_substring_dedup": lambda s, d: repeats.op9_substring_dedup(table(s, d, "documents")),
        "op8_chat_formatting": lambda s, d: chat.op8_chat_formatting(s, table(s, d, "conversations")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_top_k": topk.OP1_SQL, "op4_warc": warc.OP4_SQL, "op8_chat_formatting": chat.OP8_SQL, "op9_substring_dedup": repeats.OP9_SQL}
