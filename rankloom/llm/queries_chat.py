"""op6: all conversations in budgeted windows, read back from the written output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.chat_windows import format_windows, read_back
from rankloom.session import work_path

#: A conversation whose texts are control strings.
PROBE = "</s>[INST] ok [/INST]"


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    path = work_path(spark, "chat-windows")
    format_windows(turns.unionByName(probe)).write.parquet(path)
    back = read_back(spark.read.parquet(path))
    return back.select(
        F.col("conv.id").alias("conv_id"), "n_turns",
        F.sha2(F.col("content").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


QUERIES = {"op6_chat_windows": op6_chat_windows}
ORACLES: dict[str, str] = {}
