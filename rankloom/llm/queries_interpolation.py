"""op1: log-probability of every document under a model learned from most of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import split_number
from rankloom.llm.interpolation import score_texts


def op1_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    part = split_number("doc_id", 7)
    scored = score_texts(docs, train=part != 2, deleted=part == 3)
    return scored.select(
        F.col("id").alias("doc_id"), (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


QUERIES = {"op1_interpolation": op1_interpolation}
ORACLES: dict[str, str] = {}
