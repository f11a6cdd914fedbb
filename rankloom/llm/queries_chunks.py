"""op3: fingerprints of every document and of its edited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm.chunks import fingerprint_edits


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op3_fingerprints": op3_fingerprints}
ORACLES: dict[str, str] = {}
