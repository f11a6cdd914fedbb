"""op8: every page as a WARC record, written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm.warc import read_archives, write_archives


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound")


QUERIES = {"op8_warc": op8_warc}
ORACLES: dict[str, str] = {}
