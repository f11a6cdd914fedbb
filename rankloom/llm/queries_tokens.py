"""op12: two tokenizers' tokens of every document, aligned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm.alignment import align_documents, read_vocabularies

TOKENIZERS = "/opt/tokenizers"


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align_documents(docs, read_vocabularies(TOKENIZERS))


QUERIES = {"op12_token_alignment": op12_token_alignment}
ORACLES: dict[str, str] = {}
