"""op9: components of near-duplicate documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.hyperminhash import near_duplicates


def op9_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


QUERIES = {"op9_hyperminhash": op9_hyperminhash}
ORACLES: dict[str, str] = {}
