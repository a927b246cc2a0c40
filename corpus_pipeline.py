"""A corpus pipeline of five stages over the documents table.

quality: documents that the line classifier rejects go. near_dedup: of each group of near-copies the smallest id stays.
decontaminate: documents that leak a benchmark item go. pii: personal data becomes pseudonyms. encode: texts become ids.
Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Filters return rows as they are, with all
columns, whatever their names.

Null or empty texts: the classifier gives them the share of good documents, near-duplicates link them with nothing, no item leaks,
they encode to null or to no ids. Rows with a null doc_id are kept by the near-duplicate stage, which cannot group them. Repeated
rows of one id stay or go together. Texts of any length are read whole. Empty documents: every stage returns no rows; without
labels every text scores 0.5 and none is kept; without benchmark items nothing leaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweft.llm import decontam, neardup, pieces, pii, quality
from arcweft.llm.queries import table
from arcweft.shared import cut


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = "_quality"
    while score in docs.columns:
        score += "_"
    return quality.scored(docs, model, score_col=score).where(quality.predicted(score) == 1).drop(score)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more."""
    table(spark, sf_dir, "documents")  # workers find the package
    dropped = neardup.near_duplicates(docs, shingle=5, percent=80).where("not kept").select("doc_id")
    dropped = cut(dropped.distinct(), "dropped")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymized(docs, pii.session_key(spark))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding gives the text back."""
    table(spark, sf_dir, "documents")
    out = pieces.encode(docs.select("doc_id", "text"), check_col="decoded_equal", keep=["doc_id"])
    return out.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "decoded_equal")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("encode", encode_stage),
]

#: A trained classifier and a merge order are not SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again. ids come as text, so that rows compare."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs.withColumn("ids", F.concat_ws(",", "ids"))
