"""All registered queries and oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.plans import analysis, conversations, profiles, ranking

MODULES = (profiles, ranking, analysis, conversations)
QUERIES = {name: fn for module in MODULES for name, fn in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["f1_recommend"](spark, sf_dir)
