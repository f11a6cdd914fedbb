"""op7: the language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import split_number
from rankloom.llm.language import learn_dictionaries, with_language


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = learn_dictionaries(docs, split_number("doc_id", 3) != 1)
    held_out = split_number("doc_id", 3) == 1
    return with_language(docs.select("doc_id", held_out.alias("held_out"), "text"), learned).drop("text")


QUERIES = {"op7_language": op7_language}
ORACLES: dict[str, str] = {}
