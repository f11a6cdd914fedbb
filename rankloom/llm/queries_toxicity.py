"""op5: toxicity of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm.common import split_number
from rankloom.llm.toxicity import learn, with_toxicity


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    part = split_number("doc_id", 5)
    model = learn(docs, labels, part != 0)
    return with_toxicity(docs.withColumn("held_out", part == 0), model).drop("text")


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}
