"""Catalog files, page listings and dataset splits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions import fixed
from rankloom.operators.chatlog import strip

CATALOG = T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("experience", T.IntegerType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("settlements", T.LongType()),
    T.StructField("satisfaction", T.DoubleType()),
])


def scan_catalog(spark: SparkSession, path: str, schema: T.StructType = CATALOG) -> DataFrame:
    """A CSV catalog with header under a declared schema; a missing path gives an empty table."""
    try:
        return spark.read.schema(schema).option("header", True).option("multiLine", False).csv(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def sink_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_splits(df: DataFrame, split: Column, path: str) -> None:
    """Store a dataset by split, so that one split reads only its own files."""
    df.withColumn("split", split).write.partitionBy("split").parquet(path)


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")


def page_requests(spark: SparkSession, base: str, n: int = 72) -> DataFrame:
    """URLs of pages 1..n."""
    return spark.range(1, n + 1).select(
        F.col("id").alias("page"), F.concat(F.lit(base), F.col("id").cast("string")).alias("url")
    )


def pages_to_fetch(stored: DataFrame, n: int = 72, url: str = "url") -> DataFrame:
    """(base, page, url, stored): pages 1..n below the folder of every stored url, and whether that very url is stored.

    A url's folder is what stands before its last path segment; its query and fragment do not count.
    """
    plain = F.regexp_extract(url, r"^([^?#]*)", 1)
    seen = stored.select(plain.alias("url")).where(F.col("url") != "").distinct()
    bases = seen.select(F.regexp_extract("url", r"^([^:/]+://[^/]+/(?:[^/]+/)*)", 1).alias("base")).where(F.col("base") != "").distinct()
    wanted = bases.withColumn("page", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))))
    wanted = wanted.withColumn("url", F.concat("base", F.col("page").cast("string")))
    return wanted.join(seen.withColumn("stored", F.lit(True)), "url", "left").select("base", "page", "url", F.coalesce("stored", F.lit(False)).alias("stored"))


def plain_text(html: Column) -> Column:
    """Tags dropped, the common entities decoded, ends trimmed."""
    text = F.regexp_replace(html, "<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return strip(text)


def listing_fields() -> dict[str, str]:
    labelled = {f: fixed.LISTING_LABELLED.replace("{label}", f.title()) for f in ("experience", "specialization", "location")}
    return {"name": fixed.LISTING_NAME, **labelled, "rating": fixed.LISTING_RATING}


def extract_listings(pages: DataFrame, base_url: str, block: str = fixed.LISTING_BLOCK,
                     fields: Mapping[str, str] | None = None, link: str = fixed.LISTING_LINK) -> DataFrame:
    """One row per listing block of ``pages(page_id, html)``, with its position, fields and profile URL.

    A block runs from its opening tag to the next block's. A missing rating reads ``No rating``.
    """
    fields = dict(listing_fields() if fields is None else fields)
    blocks = pages.select("page_id", F.posexplode(F.split("html", block)).alias("pos", "_b")).where("pos > 0")
    cols = {name: plain_text(F.regexp_extract("_b", pattern, 1)) for name, pattern in fields.items()}
    if "rating" in cols:
        cols["rating"] = F.coalesce(F.nullif(cols["rating"], F.lit("")), F.lit(fixed.NO_RATING))
    url = F.concat(F.lit(base_url), F.regexp_extract("_b", link, 1))
    return blocks.select("page_id", F.col("pos").cast("bigint").alias("pos"), *[v.alias(n) for n, v in cols.items()], url.alias("profile_url"))
