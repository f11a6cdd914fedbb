"""op10: all documents mixed to their sources' targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from rankloom.llm.mixing import mix, word_count
from rankloom.session import cut_lineage


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = cut_lineage(docs.select("doc_id", "source", word_count(F.col("text")).alias("n_words")))
    return mix(counted, size_col="n_words").select("doc_id", "size", "source_size", "target", "taken", "copies")


SQL = r"""
WITH d AS (
  SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (CAST(CAST(concat('0x', substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) AS DOUBLE) + 0.5)
      / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
      - coalesce(CAST(sum(source_size) OVER (ORDER BY source_size / weight, source ASC NULLS LAST
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0) * 2.0)
    / CAST(sum(weight) OVER (ORDER BY source_size / weight, source ASC NULLS LAST
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM w),
c AS (SELECT *, level * weight > source_size * 2.0 AS capped FROM l),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN source_size * 2.0 ELSE weight *
    (SELECT level FROM c WHERE NOT capped ORDER BY source_size / weight, source ASC NULLS LAST LIMIT 1) END AS target FROM c),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS certain FROM t),
e AS (
  SELECT d.*, source_size, target, certain, greatest(target - certain * source_size, 0) AS wanted,
    CASE WHEN size > 0 THEN CAST(1 AS BIGINT) << (length(bin(size)) - 1) ELSE 0 END AS class
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
k AS (SELECT source, class, any_value(wanted) AS wanted, CAST(sum(size) AS BIGINT) AS words FROM e GROUP BY source, class),
f AS (
  SELECT *, (wanted - CAST(coalesce(sum(words) OVER (PARTITION BY source ORDER BY class DESC
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / nullif(CAST(sum(CAST(words AS HUGEINT) * class) OVER (PARTITION BY source ORDER BY class DESC
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE), 0) AS rate
  FROM k),
g AS (
  SELECT source, class, CASE WHEN rate * class >= 1 THEN 1.0::DOUBLE ELSE coalesce(least(class * first_value(greatest(rate, 0))
    OVER (PARTITION BY source, coalesce(rate * class >= 1, false) ORDER BY class DESC), 1.0), 0.0) END AS p
  FROM f),
q AS (
  SELECT e.*, p, u * (1 - p) / (u * (1 - p) + p * (1 - u)) AS rank
  FROM e JOIN g ON e.source IS NOT DISTINCT FROM g.source AND e.class = g.class),
r AS (
  SELECT *, CASE WHEN p > 0 THEN sum(size) OVER (PARTITION BY source, p > 0 ORDER BY
      CASE WHEN p < 1 THEN rank ELSE -1 END, coalesce(CAST(doc_id AS VARCHAR), ''), size ROWS UNBOUNDED PRECEDING) END AS upto
  FROM q),
z AS (SELECT *, CAST(certain + CASE WHEN p >= 1 OR p > 0 AND 2 * upto - size <= 2 * wanted THEN 1 ELSE 0 END AS BIGINT) AS copies FROM r)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies FROM z
"""

QUERIES = {"op10_mix_sources": op10_mix_sources}
ORACLES = {"op10_mix_sources": SQL}
