"""op4: every page's url judged by rules, and by its host's place in the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm.link_graph import judge_urls

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def op4_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


QUERIES = {"op4_link_graph": op4_link_graph}
ORACLES: dict[str, str] = {}
